"""Labels by a language model: payloads, the call in batches, and checks of what comes back.

The model is a function of the caller's; a row whose call or answer fails keeps its reason, and the others go on. Answers
are stored before they are judged, so nothing asks twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import counted, ship
from .report import none
from .store import LABELS

#: An item's fields in a payload, what the labels mean, and errors that are kept.
FIELDS = ("provider", "title", "abstract", "journal", "concepts", "mesh_terms", "doi", "pmid", "pmcid", "arxiv_id", "year", "relevance_score", "relevance_reason", "query_variant", "query_intent")
RULES = {
    "relevant": "Strong title, abstract, journal, MeSH, or concept match to the scholarly query.",
    "maybe": "Partial or ambiguous match that should remain eligible for review.",
    "irrelevant": "Wrong domain, weak match, or no substantive metadata support.",
}
KEPT_ERRORS, BATCH = 10, 32


def label_payload(query: Column, plan: Column, columns: list[str]) -> Column:
    """The JSON that a model is asked with: query, its plan (a struct), the item's fields among ``columns``, choices and rules."""
    item = F.struct(*[(F.col(c) if c in columns else F.lit(None).cast("string")).alias(c) for c in FIELDS])
    rules = F.struct(*[F.lit(v).alias(k) for k, v in RULES.items()])
    return F.to_json(F.struct(F.coalesce(query, F.lit("")).alias("query"), plan.alias("query_plan"), item.alias("candidate"), F.array(*[F.lit(x) for x in LABELS]).alias("label_choices"), rules.alias("rules")), {"ignoreNullFields": "false"})


def asked(df: DataFrame, payload: str, call: Callable[[list[str]], list], batch: int = BATCH) -> DataFrame:
    """df with answer and call_error. ``call`` takes payloads and gives as many texts, or an exception in a text's place; if it raises, its batch's rows have that error."""
    ship(df.sparkSession)
    at = df.columns.index(payload)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                texts = part.column(at).to_pylist()
                try:
                    got = list(call(texts))
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} answers to {len(texts)} payloads")
                except Exception as e:  # what a service does is no reason to lose the other rows
                    got = [e] * len(texts)
                errors = [f"call_failed: {x}" if isinstance(x, Exception) else "no_answer" if x is None else None for x in got]
                answers = [None if isinstance(x, Exception) or x is None else str(x) for x in got]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "answer", "call_error"])

    names = [f"c{k}" for k in range(len(df.columns))]
    plain = df.toDF(*names)
    out = type(plain.schema)(plain.schema.fields[:]).add("answer", "string").add("call_error", "string")
    return plain.mapInArrow(step, out).toDF(*df.columns, "answer", "call_error")


def response_text(response: Column) -> Column:
    """struct(text, error) of a service's response: its output_text, else the first text among its parts; a refusal before it is an error."""
    parts = F.from_json(response, "struct<output:array<struct<content:array<struct<type:string,text:string,refusal:string>>>>>")["output"]
    flat = F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<struct<content:array<struct<type:string,text:string,refusal:string>>>>")), lambda p: F.coalesce(p["content"], F.array().cast("array<struct<type:string,text:string,refusal:string>>"))))
    first = F.get(F.filter(flat, lambda c: (c["type"] == "refusal") | ((c["type"] == "output_text") & c["text"].isNotNull())), 0)
    v = F.try_parse_json(response)
    whole = F.when(F.schema_of_variant(F.try_variant_get(v, "$.output_text", "variant")) == "STRING", F.try_variant_get(v, "$.output_text", "string"))
    text = F.coalesce(whole, F.when(first["type"] == "output_text", first["text"]))
    error = F.when(text.isNotNull(), None).when(first["type"] == "refusal", F.concat(F.lit("refused: "), F.coalesce(first["refusal"], F.lit("refusal")))).otherwise("no_output_text")
    return F.struct(text.alias("text"), error.alias("error"))


def checked(answer: Column) -> Column:
    """struct(label, confidence, rationale, evidence_terms, exclusion_reason, error) of a model's JSON; the first rule that it breaks is the error, and the rest null."""
    v = F.try_parse_json(answer)
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), F.lit("VOID"))
    value = lambda f, t: F.try_variant_get(v, f"$.{f}", t)
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    terms = value("evidence_terms", "array<string>")
    number = kind("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & value("confidence", "double").between(0, 1)
    texts = F.when(kind("evidence_terms") == "ARRAY<STRING>", F.forall(terms, lambda t: t.isNotNull() & (tidy(t) != ""))).otherwise((kind("evidence_terms") == "ARRAY<VOID>") & (F.size(terms) == 0))
    ok = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(~ok(F.schema_of_variant(v).startswith("OBJECT")), "not_an_object").when(~ok((kind("label") == "STRING") & value("label", "string").isin(*LABELS)), "invalid_label").when(~ok(number), "invalid_confidence")
        .when(~ok((kind("rationale") == "STRING") & (tidy(value("rationale", "string")) != "")), "empty_rationale").when(~ok(texts), "invalid_evidence_terms").when(~ok(kind("exclusion_reason").isin("STRING", "VOID")), "invalid_exclusion_reason")
    )
    fine = lambda c: F.when(error.isNull(), c)
    return F.struct(
        fine(value("label", "string")).alias("label"), fine(F.round(value("confidence", "double"), 3)).alias("confidence"), fine(tidy(value("rationale", "string"))).alias("rationale"),
        fine(F.transform(F.coalesce(terms, none()), tidy)).alias("evidence_terms"), fine(F.nullif(tidy(value("exclusion_reason", "string")), F.lit(""))).alias("exclusion_reason"), error.alias("error"),
    )


@dataclass(frozen=True)
class ModelLabels:
    """decisions: keys, outcome and the label's columns; counts of applied, skipped_human, skipped_low_confidence, skipped_error; the first errors in order."""

    decisions: DataFrame
    counts: dict
    errors: list[str]


def label_items(items: DataFrame, keys: list[str], call: Callable[[list[str]], list], payload: str = "payload", order: list[str] | None = None, least: float = 0.0, batch: int = BATCH) -> ModelLabels:
    """Labels of items by a model. items: keys, payload, and label_source, by whom an item is labelled (null: by none).

    An item that a human labelled isn't asked about (``skipped_human``). What fails in the call or the checks is
    ``skipped_error``, what is less sure than ``least`` ``skipped_low_confidence``; the rest is ``applied``.
    """
    human = F.col("label_source").eqNullSafe("human")
    answered = asked(items.where(~human), payload, call, batch).withColumn("d", checked(F.col("answer")))
    answered = answered.withColumn("error", F.coalesce("call_error", "d.error"))
    outcome = F.when(F.col("error").isNotNull(), "skipped_error").when(F.col("d.confidence") < least, "skipped_low_confidence").otherwise("applied")
    extra = [c for c in order or keys if c not in keys]
    columns = ["label", "confidence", "rationale", "evidence_terms", "exclusion_reason"]
    done = answered.withColumn("outcome", outcome).select(*keys, *extra, "outcome", *[F.col(f"d.{c}").alias(c) for c in columns], "error")
    kept = items.where(human).select(*keys, *extra, F.lit("skipped_human").alias("outcome"))
    names = ("applied", "skipped_human", "skipped_low_confidence", "skipped_error")
    stored, counts = counted(done.unionByName(kept, allowMissingColumns=True), **{n: (F.col("outcome") == n).cast("long") for n in names})
    first = stored.where("error IS NOT NULL").orderBy(*(order or keys)).limit(KEPT_ERRORS)
    return ModelLabels(stored.select(*keys, "outcome", *columns, "error"), {n: counts[n] for n in names}, [r.error for r in first.collect()])
