"""Relevance of candidates to a planned query, their order, and whether a topic lets them be read in full.

Candidates have the columns provider, title, abstract, journal, concepts, mesh_terms, doi, pmid and year. The query is planned
on the driver; its terms reach the rows as literals, so scoring is one narrow pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.planning import Plan, Topic, focus_terms, holds, phrase
from ..functions.text import normalize_phrase


@dataclass(frozen=True)
class Weights:
    """Term weights of the score. The defaults are fixed values."""

    biomedical: dict[str, int] = field(default_factory=lambda: {
        "antimicrobial": 18, "antibiotic": 14, "antifungal": 14, "resistance": 16, "resistant": 14, "susceptibility": 14, "pathogen": 10, "bacterial": 10, "bacteria": 10, "clinical": 8, "isolate": 8, "isolates": 8, "infection": 8,
        "pseudomonas": 10, "aeruginosa": 6, "staphylococcus": 8, "enterobacteriaceae": 8, "klebsiella": 8, "escherichia": 8, "fungal": 8,
    })
    maldi: dict[str, int] = field(default_factory=lambda: {"maldi": 16, "maldi tof": 18, "maldi-tof": 18, "mass spectrometry": 12, "spectrometry": 8, "spectra": 6})
    nlp: dict[str, int] = field(default_factory=lambda: {"abstract meaning representation": 70, "amr parsing": 50, "amr parser": 50, "amr-to-text": 50, "semantic graph": 32, "semantic graphs": 32, "natural language": 26, "text generation": 22, "neural machine translation": 22})
    mathematics: dict[str, int] = field(default_factory=lambda: {"mathematical linguistics": 50, "formal language theory": 44, "formal language": 28, "automata": 24, "grammar": 16, "grammars": 16, "syntax": 16, "semantics": 12, "algebra": 14, "algebraic": 14, "information theory": 8, "language acquisition": 12, "natural language": 10})
    medicine: dict[str, int] = field(default_factory=lambda: {"biomedical": 20, "clinical": 22, "disease": 16, "health": 16, "medical": 16, "medicine": 16, "patient": 16, "patients": 16})
    generic: dict[str, int] = field(default_factory=lambda: {"chatgpt": 20, "large language model": 18, "large language models": 18, "llm": 16, "llms": 16, "homework": 14, "classroom": 14, "education": 12})
    metadata: dict[str, int] = field(default_factory=lambda: {"drug resistance microbial": 28, "antimicrobial resistance": 28, "mass spectrometry": 18, "microbiology": 12, "clinical microbiology": 16, "anti bacterial agents": 12})
    provider: dict[str, int] = field(default_factory=lambda: {"pubmed": 14, "openalex": 8, "arxiv": 0})
    amr: tuple[str, ...] = ("antimicrobial", "antibiotic", "antifungal", "resistance", "resistant", "susceptibility")


PROVIDER_RANK = {"pubmed": 0, "openalex": 1, "arxiv": 2}
HIT = "array<struct<term:string,weight:int>>"


def hits(padded: Column, terms: dict[str, int]) -> Column:
    """struct(term, weight) of each term that a normalised text between blanks holds, in the order of the terms."""
    if not terms:
        return F.array().cast(HIT)
    return F.array_compact(F.array(*[F.when(padded.contains(f" {phrase(t)} "), F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight"))) for t, w in terms.items()]))


def matched(padded: Column, terms: tuple[str, ...]) -> Column:
    """The terms found, in order."""
    return F.transform(hits(padded, dict.fromkeys(terms, 1)), lambda h: h["term"])


def weight(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, h: a + h["weight"])


def named(label: str, found: Column, most: int) -> Column:
    return F.when(F.size(found) > 0, F.concat(F.lit(label + "="), F.array_join(F.transform(F.slice(found, 1, most), lambda h: h["term"]), ",")))


def padded(*columns: str) -> Column:
    """Normalised text of columns between blanks; nulls add nothing."""
    return F.concat(F.lit(" "), normalize_phrase(F.concat_ws(" ", *columns)), F.lit(" "))


def score(df: DataFrame, query: str, plan: Plan, topic: Topic, weights: Weights = Weights()) -> DataFrame:
    """``df`` with relevance_score (0 to 100) and relevance_reason ("; "-joined, hit names cut to the first few)."""
    groups = {"bio": weights.biomedical, "maldi": weights.maldi, "nlp": weights.nlp, "math": weights.mathematics, "wrong": weights.medicine, "generic": weights.generic}
    groups |= {"core": dict.fromkeys(topic.core, 36), "positive": dict.fromkeys(topic.positive, 16), "negative": dict.fromkeys(topic.negative, 18)}
    own = df.columns
    df = df.withColumn("_text", padded("title", "abstract", "journal", "concepts", "mesh_terms", "doi", "provider")).withColumn("_meta", padded("concepts", "mesh_terms", "journal"))
    df = df.withColumns({f"_{k}": hits(F.col("_text"), v) for k, v in groups.items()} | {"_m": hits(F.col("_meta"), weights.metadata)})
    n = {k: F.size(f"_{k}") > 0 for k in [*groups, "m"]}
    w = {k: weight(F.col(f"_{k}")) for k in [*groups, "m"]}
    amr = holds(phrase(query), "amr") or holds(phrase(query), "antimicrobial resistance")
    nothing = F.lit(None).cast("string")
    parts: list[tuple[Column, Column]] = [(F.lit(5) + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.provider.items() for x in kv]), F.coalesce("provider", F.lit(""))), F.lit(0)), F.concat(F.lit("provider="), F.coalesce("provider", F.lit(""))))]
    parts += [(w["bio"], named("biomedical_terms", F.col("_bio"), 5)), (w["m"], named("metadata_terms", F.col("_m"), 5)), (w["maldi"], named("maldi_context", F.col("_maldi"), 3))]
    if amr:
        has = F.size(hits(F.col("_text"), dict.fromkeys(weights.amr, 1))) > 0
        parts.append((F.when(has, 18).otherwise(0), F.when(has, "amr_context")))
    if plan.intent == "mathematical_linguistics":
        off, chat = n["wrong"] & ~n["math"], n["generic"] & ~n["math"]
        parts += [(w["math"], named("math_language_context", F.col("_math"), 5)), (F.when(off, -F.least(F.lit(80), w["wrong"] + 18)).otherwise(0), F.when(off, "math_language_wrong_domain_penalty")), (F.when(chat, -F.least(F.lit(60), w["generic"])).otherwise(0), F.when(chat, "generic_language_model_penalty"))]
    if topic.domain != "unknown":
        collides = n["negative"] & ~n["core"] & ~n["positive"]
        parts += [(w["core"] + w["positive"], named("topic_terms", F.concat("_core", "_positive"), 6)), (F.when(collides, -F.least(F.lit(80), w["negative"] + 18)).otherwise(0), F.when(collides, named("topic_collision_penalty", F.col("_negative"), 4)))]
    known = (F.coalesce("doi", F.lit("")) != "") | (F.coalesce("pmid", F.lit("")) != "")
    parts.append((F.when(known, 4).otherwise(0), F.when(known, "identifier_bonus")))
    if plan.intent == "nlp":
        clash = w["bio"] + w["m"] + w["maldi"]
        parts += [(w["nlp"], named("nlp_amr_context", F.col("_nlp"), 4)), (F.when(clash > 0, -F.least(F.lit(200), clash + F.when(n["nlp"], 20).otherwise(80))).otherwise(0), F.when(clash > 0, "non_nlp_collision_penalty"))]
    elif amr:
        parts.append((-w["nlp"], named("nlp_amr_penalty", F.col("_nlp"), 4)))
    parts.append((F.lit(0), F.when(~n["bio"] & ~n["maldi"] & ~n["m"], "not_biomedical").otherwise(nothing)))
    total = parts[0][0]
    for p, _ in parts[1:]:
        total = total + p
    kept = [c for c in own if c not in ("relevance_score", "relevance_reason")]
    return df.select(*kept, F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("relevance_score"), F.array_join(F.array_compact(F.array(*[r for _, r in parts])), "; ").alias("relevance_reason"))


def ranked(scored: DataFrame, k: int, ordinal: str, ranks: dict[str, int] | None = None) -> DataFrame:
    """The k best candidates with their rank from 1: by score, provider, newest year, then ``ordinal``, a unique column."""
    ranks = PROVIDER_RANK if ranks is None else ranks
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.coalesce("provider", F.lit(""))), F.lit(99))
    order = [F.desc(F.coalesce("relevance_score", F.lit(0))), place, F.desc(F.coalesce("year", F.lit(0))), F.col(ordinal)]
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def curate(df: DataFrame, topic: Topic) -> DataFrame:
    """``df`` with a struct ``curation``: status, eligible, score, reason, and the terms and components found and missing."""
    empty = F.array().cast("array<string>")
    if topic.domain == "unknown":
        names = ("query_terms", "core_terms", "positive_terms", "negative_terms", "components", "missing")
        return df.withColumn("curation", F.struct(F.lit("unknown_topic").alias("status"), F.lit(True).alias("eligible"), F.lit(0).alias("score"), F.lit("no_topic_profile").alias("reason"), *[empty.alias(x) for x in names]))
    own = df.columns
    text = F.col("_text")
    df = df.withColumn("_text", padded("title", "abstract", "journal", "concepts", "mesh_terms"))
    found = [F.when(F.size(matched(text, terms)) > 0, F.lit(name)) for name, terms in topic.components.items()]
    df = df.withColumns({"_q": matched(text, focus_terms(topic.query)), "_c": matched(text, topic.core), "_p": matched(text, topic.positive), "_n": matched(text, topic.negative), "_k": F.array_compact(F.array(*found)) if found else empty})
    missing = F.array_except(F.array(*[F.lit(x) for x in topic.needed]), "_k") if topic.needed else empty
    df = df.withColumn("_x", missing)
    size = {c: F.size(f"_{c}") for c in "qcpnkx"}
    points = 12 * size["q"] + 10 * size["c"] + 4 * size["p"] + 6 * size["k"] - 20 * size["x"] - 10 * size["n"]
    evidence, focus = (size["c"] > 0) | (size["p"] > 0), size["q"] > 0
    reason = F.when(size["x"] > 0, "missing_topic_component").when((size["n"] > 0) & ~evidence & ~focus, "negative_terms_without_topic_evidence").when(~focus, "missing_query_focus").when(~evidence, "missing_profile_terms").otherwise("query_and_profile_terms_matched")
    status = F.when((size["x"] > 0) | ~focus, "topic_mismatch").when(~evidence, "weak_topic_match").otherwise("topic_match")
    out = F.struct(status.alias("status"), (status == "topic_match").alias("eligible"), points.alias("score"), reason.alias("reason"), F.col("_q").alias("query_terms"), F.col("_c").alias("core_terms"), F.col("_p").alias("positive_terms"), F.col("_n").alias("negative_terms"), F.col("_k").alias("components"), F.col("_x").alias("missing"))
    return df.select(*[c for c in own if c != "curation"], out.alias("curation"))
