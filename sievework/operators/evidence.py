"""Page text to typed, flagged, gated and trusted evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import sentences

#: Instruction patterns, and front-matter patterns.
INJECTION = (r"\bignore (all )?(previous|prior|above) instructions\b", r"\bsystem prompt\b", r"\bdeveloper message\b", r"\breveal .*secret", r"\bexfiltrat", r"\bexecute (a )?(command|script)\b", r"\brun (bash|sh|python|curl|wget)\b")
FRONT_MATTER = (r"\bdepartment of\b", r"\bfaculty of\b", r"\borcid\.org\b", r"\bcorresponding author\b", r"\bavailability of data and materials\b", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", r"\bkeywords?\s*:", r"\bspecialty section\b", r"\bcorrespondence\b", r"\breceived\s*:|\baccepted\s*:|\bpublished\s*:", r"\boriginal research\s+published\s*:", r"\bdetection method advantages disadvantages\b", r"\badvantages disadvantages\b")
#: Lower-case letters without which no injection or front-matter pattern is found.
INJECTION_SIGNS = ("instructions", "system prompt", "developer message", "reveal ", "exfiltrat", "execute ", "run ")
FRONT_MATTER_SIGNS = ("department of", "faculty of", "orcid.org", "corresponding author", "availability of data", "@", "keyword", "specialty section", "correspondence", "received", "accepted", "published", "advantages disadvantages")
#: Flags that quarantine.
QUARANTINE = ("column_stitching", "document_parse_quality", "embedded_heading", "formula_fragment", "front_matter", "hyphenation_break", "instruction_injection", "low_page_parse_confidence", "page_parse_quality", "reference_section", "sentence_fragment", "short_fragment", "symbol_loss", "table_fragment")


def to_sentences(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each sentence with its place ``seq`` from 0."""
    return pages.select(*keys, F.posexplode(sentences(F.col(text))).alias("seq", "sentence"))


def either(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found, whatever the case: one scan of the text."""
    return c.rlike("(?i)(?:" + "|".join(patterns) + ")")


def guarded(c: Column, signs: tuple[str, ...], patterns: tuple[str, ...]) -> Column:
    """``either``, tried only on texts that hold one of the signs."""
    low = F.lower(c)
    return F.when(reduce(lambda a, b: a | b, [low.contains(s) for s in signs]), either(c, patterns)).otherwise(False)


def fewer_words(c: Column, n: int) -> Column:
    """Whether a text has fewer than n words; no more than n are looked at."""
    return ~c.rlike(rf"^\s*(?:\S+\s+){{{n - 1}}}\S")


def words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))


def flags(c: Column, least_words: int = 5) -> Column:
    """The flags of a sentence, in a fixed order. Without a function over the array, so that all conditions are compiled and share their lower-case text."""
    return F.array_except(F.array(
        F.when(fewer_words(c, least_words), F.lit("short_fragment")),
        F.when(guarded(c, INJECTION_SIGNS, INJECTION), F.lit("instruction_injection")),
        F.when(guarded(c, FRONT_MATTER_SIGNS, FRONT_MATTER), F.lit("front_matter")),
        F.when(F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit(""))) >= 2, F.lit("table_fragment")),
        F.when(c.rlike(r"^[a-z]"), F.lit("sentence_fragment")),
        F.when(c.contains("- ") & c.rlike(r"[A-Za-z]- [a-z]"), F.lit("hyphenation_break")),
    ), F.array(F.lit(None).cast("string")))


def classify(c: Column, patterns: dict[str, str]) -> Column:
    """The first type whose pattern is found, else null."""
    out = None
    for name, p in patterns.items():
        hit = c.rlike("(?i)" + p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def quota(df: DataFrame, doc: str, kind: str, order: list[str], per_kind: int = 8, most: int = 40) -> DataFrame:
    """At most ``per_kind`` rows of a type and ``most`` rows of a document, the first by ``order``."""
    kept = df.withColumn("k", F.row_number().over(W.partitionBy(doc, kind).orderBy(*order))).where(F.col("k") <= per_kind)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy(*order))).where(F.col("place") <= most).drop("k")


def ratio_gate(df: DataFrame, keys: list[str], blocked: Column, least: int, share: float) -> DataFrame:
    """Counts of each group and whether ``least`` or more and at least ``share`` of its rows are blocked: one aggregate, no window."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_items"), F.count_if(blocked).alias("n_blocked"))
    return out.withColumn("gated", (F.col("n_blocked") >= least) & (F.col("n_blocked") >= share * F.col("n_items")))


def trust(quality: Column, parse: Column, flags_: Column, parse_flags: Column, page: Column, n_words: Column, label: Column | None = None, found: Column | None = None) -> Column:
    """struct(score, label, reasons): a product of qualities under caps, the label by score and reasons.

    ``label`` is the stored quality label (default clean); ``found`` are the flags that the text has when it is looked at again:
    a text stored as clean that has some now is quarantined.
    """
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    quality, parse, strings = unit(quality), unit(parse), "array<string>"
    label = F.lit("clean") if label is None else label
    found = F.array().cast(strings) if found is None else found
    severe = F.array(*[F.lit(x) for x in QUARANTINE])
    unclean, stale = label != "clean", (label == "clean") & (F.size(found) > 0)
    fixed = [
        F.when(unclean, F.array(F.concat(F.lit("quality_label:"), label))).when(stale, F.concat(F.array(F.lit("legacy_quality_filter")), found)),
        *[F.when(hit, F.array(F.lit(name))) for name, hit in (("lower_quality_score", quality < 0.9), ("lower_parse_confidence", parse < 0.9), ("low_parse_confidence", parse < 0.6), ("missing_page_anchor", page <= 0), ("sentence_incomplete", n_words <= 4))],
        F.transform(flags_, lambda f: F.when(F.array_contains(severe, f), f).otherwise(F.concat(F.lit("quality_flag:"), f))),
        F.transform(parse_flags, lambda f: F.concat(F.lit("parse_flag:"), f)),
    ]
    reasons = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.coalesce(x, F.array().cast(strings)) for x in fixed]))))
    bad = unclean | stale | (F.size(F.array_intersect(flags_, severe)) > 0)
    caps = [F.when(parse < 0.6, 0.3).otherwise(1.0), F.when(page <= 0, 0.4).otherwise(1.0), F.when(n_words <= 4, 0.45).otherwise(1.0), F.when(bad, 0.2).when((F.size(flags_) > 0) | (F.size(parse_flags) > 0), 0.78).otherwise(1.0)]
    score = F.round(F.least(quality * parse, *caps), 3)
    quarantined = bad | (parse < 0.6) | (page <= 0) | (n_words <= 4) | (score < 0.55)
    return F.struct(score.alias("score"), F.when(quarantined, "quarantined").when((score < 0.8) | (F.size(reasons) > 0), "review").otherwise("trusted").alias("label"), reasons.alias("reasons"))


def repeated_edge_lines(pages: DataFrame, doc: str, lines: str = "lines", edge: int = 2, least: int = 2) -> DataFrame:
    """Lines among the first or last ``edge`` of at least ``least`` pages of a document."""
    n = F.size(lines)
    ends = F.array_distinct(F.concat(F.slice(lines, 1, edge), F.slice(lines, F.greatest(n - edge + 1, F.lit(1)), edge)))
    return pages.where(n > 0).select(doc, F.explode(ends).alias("line")).where("line <> ''").groupBy(doc, "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)
