"""Checks of corpora of cases: rules as data, violations as rows with file and place.

Each file is read once. A case breaks at most one rule, the first in order; what can't be read is a violation like any
other, and a case named before, in whichever file, is a duplicate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The kinds of case and the version of a corpus.
CASE_TYPES = ("query_plan", "source_policy", "ranking", "screening_label", "topic_curation")
VERSION = "1.0"


@dataclass(frozen=True)
class Rule:
    """``holds`` of a case, a variant column; where it isn't true, the case breaks the rule."""

    name: str
    holds: Callable[[Column], Column]


def kind(v: Column, path: str = "$") -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, BIGINT ...; VOID where there is nothing."""
    whole = F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))
    return F.coalesce(F.regexp_extract(whole, "^[A-Z]+", 0), F.lit("VOID"))


def named(prefix: str) -> Rule:
    return Rule("bad_case_id", lambda v: (kind(v, "$.case_id") == "STRING") & F.try_variant_get(v, "$.case_id", "string").startswith(prefix))


def case_rules(types: tuple[str, ...] = CASE_TYPES) -> tuple[Rule, ...]:
    """What a case with a good and new id needs."""
    return (
        Rule("unsupported_type", lambda v: (kind(v, "$.type") == "STRING") & F.try_variant_get(v, "$.type", "string").isin(*types)),
        Rule("no_description", lambda v: (kind(v, "$.description") == "STRING") & F.try_variant_get(v, "$.description", "string").rlike(r"\S")),
        Rule("no_expected", lambda v: kind(v, "$.expected") == "OBJECT"),
    )


def violations(cases: DataFrame, prefix: str, order: list[str], rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The columns of ``order``, rule, case_id of each case that breaks a rule. cases: the columns of ``order``, which place it, and ``json``, its text.

    First come unreadable, not_an_object, bad_case_id and duplicate_case_id; of equal ids the first by ``order`` is none.
    """
    v, ok = F.col("v"), lambda c: F.coalesce(c, F.lit(False))
    rows = cases.select(*order, F.try_parse_json("json").alias("v"))
    good = ok(kind(v) == "OBJECT") & ok(named(prefix).holds(v))
    rows = rows.withColumn("case_id", F.when(good, F.try_variant_get(v, "$.case_id", "string")))
    again = F.col("case_id").isNotNull() & (F.row_number().over(W.partitionBy("case_id").orderBy(*order)) > 1)
    # cases without an id would all be one group of the window: they can't be duplicates and go round it
    told = rows.where("case_id IS NOT NULL").withColumn("again", again).unionByName(rows.where("case_id IS NULL").withColumn("again", F.lit(False)))
    first = F.when(v.isNull(), "unreadable").when(kind(v) != "OBJECT", "not_an_object").when(F.col("case_id").isNull(), "bad_case_id").when(F.col("again"), "duplicate_case_id")
    for r in case_rules() if rules is None else rules:
        first = first.when(~ok(r.holds(v)), r.name)
    return told.select(*order, first.alias("rule"), "case_id").where("rule IS NOT NULL")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases (file, place, json) of JSON corpus files, one corpus a file, and violations (file, place null, rule) of whole files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    version = (kind(F.col("v"), "$.schema_version") == "STRING") & (F.try_variant_get("v", "$.schema_version", "string") == VERSION)
    rule = F.when(F.col("v").isNull(), "unreadable_file").when(~F.coalesce(version, F.lit(False)), "bad_schema_version").when(kind(F.col("v"), "$.cases") != "ARRAY", "no_cases")
    marked = files.withColumn("rule", rule)
    cases = marked.where("rule IS NULL").select("file", F.posexplode(F.try_variant_get("v", "$.cases", "array<variant>")).alias("place", "c")).select("file", "place", F.coalesce(F.to_json("c"), F.lit("null")).alias("json"))
    return cases, marked.where("rule IS NOT NULL").select("file", F.lit(None).cast("int").alias("place"), "rule")
