"""Claims, evidence tables, drafts and reports, and the audits that decide whether a report may be published.

A report is a row with a key and markdown text. Sentences and lines are exploded rows; windows are per report, so their size is
that of one text. Calls of a language model are left to the caller: its answers come in as columns, and the gates judge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.durable import durable
from ..functions.text import citations, display_citations, sort_citations, strip_citations

#: Words that carry no claim, phrases that overstate, and sections without prose.
EMPTY_WORDS = (
    "a", "an", "and", "are", "as", "at", "available", "background", "batch", "by", "citation", "citations", "claim", "claims", "described", "did", "draws", "evidence", "finding", "findings", "for", "from", "gap", "gaps", "had", "has", "in",
    "is", "it", "limitations", "method", "methods", "no", "noted", "of", "on", "one", "page", "page-anchored", "paper", "papers", "reported", "results", "same", "second", "section", "source", "status", "study", "supported", "that", "the",
    "this", "to", "two", "unknown", "used", "was", "were", "with",
)
OVERSTATED = (
    r"\bprove[sd]?\b", r"\bproven\b", r"\bestablish(?:ed|es)?\b", r"\bdefinitive\b", r"\bclinically definitive\b", r"\bstandard of care\b", r"\bmortality benefit\b", r"\bsurvival benefit\b", r"\bcausal(?:ity)?\b", r"\bcaused\b",
    r"\bguarantee[sd]?\b", r"\bglobal hospital deployment\b", r"\bclinical deployment\b", r"\bvalidated for deployment\b", r"\bready for clinical use\b", r"\broutine clinical use\b", r"\bpractice[- ]changing\b",
)
#: Lower-case letters without which no overstating phrase, no front matter and no formula is found.
OVERSTATED_SIGNS = ("prove", "establish", "definitive", "standard of care", "benefit", "caus", "guarantee", "deployment", "clinical use", "practice")
FRONT_SIGNS = ("keyword", "published", "received", "accepted")
#: Without i, k and s, which letters of other scripts may stand for.
FORMULA_SIGNS = ("=", "formall", "learn", "funct", "ℒ", "∑", "𝜆", "𝛼", "𝛽", "µ", "μ")
APPENDED = ("evidence table", "literature", "citation audit")
SECTIONS = ("background", "methods", "results", "limitations")
INTRODUCTIONS = tuple(f"The {s} section draws on " for s in SECTIONS)
#: The table, role and wording of an evidence type.
TABLES = {"claim": "claims", "method": "methods", "result": "results", "dataset_population": "populations", "limitation": "limitations"}
ROLES = ("claim", "method", "result", "limitation", "dataset_population", "method_detail", "formula_detail", "front_matter", "metadata_noise")
VERBS = {"claim": "argued that", "dataset_population": "described that", "method": "described that", "result": "reported that", "limitation": "noted that"}
#: Fixed values.
NEGATIVE = ("no improvement", "not improve", "did not improve", "failed to improve", "decreased", "reduced", "lower", "worse")
#: Fixed values.
POSITIVE = ("improved", "increased", "higher", "outperformed", "achieved", "detected")
STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(STRINGS)


def choose(key: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit(""))), F.lit(default))


def holds_any(low: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


# --- columns ----------------------------------------------------------------------------------------------------------


def terms(c: Column) -> Column:
    """Distinct words of a sentence that can support a claim: lower-case, over two characters or a number, without empty words."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]+\]", " "), "[^A-Za-z0-9 βµ-]+", " "))
    words = F.transform(F.split(bare, " +"), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*EMPTY_WORDS) & ((F.length(w) > 2) | w.rlike(r"^\d+$"))))


def terms_support(claim: Column, evidence: Column) -> Column:
    """Whether evidence shares enough of a claim's terms: one of up to three, two of more; a claim without terms needs none."""
    return (F.size(claim) == 0) | (F.size(F.array_intersect(claim, evidence)) >= F.when(F.size(claim) <= 3, 1).otherwise(2))


def overstatements(c: Column) -> Column:
    """Overstating phrases, each once, in the order of the patterns; they are tried one by one only where one of them is found."""
    each = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.lower(c), F.lit(p), 0), lambda x: F.regexp_replace(x, r"\s+", " ")) for p in OVERSTATED]))
    return F.when(holds_any(F.lower(c), OVERSTATED_SIGNS) & F.lower(c).rlike("|".join(OVERSTATED)), F.array_distinct(each)).otherwise(none())


def unsupported_overstatements(claim: Column, cited: Column, evidence: Column) -> Column:
    """Those not found in the evidence; without citations there is nothing to compare."""
    low = F.lower(F.coalesce(evidence, F.lit("")))
    proof = ("prove", "proved", "proves", "proven")
    backed = lambda t: (low != "") & (low.contains(t) | (t.isin(*proof) & holds_any(low, proof)))
    return F.when(F.size(cited) > 0, F.filter(overstatements(claim), lambda t: ~backed(t))).otherwise(none())


def claim_quality(c: Column) -> Column:
    """How well a claim reads: up to 46, and -1 under six words."""
    n = F.regexp_count(c, F.lit(r"\S+"))
    upper = F.regexp_count(c, F.lit(r"\p{Lu}"))
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    value = F.least(n, F.lit(40)) + F.when(holds_any(F.lower(c), ("achieved", "show", "identified", "agreement", "sensitivity")), 6).otherwise(0)
    return F.when(n < 6, -1).otherwise(value - F.when(count("[") != count("]"), 2).otherwise(0) - F.when(upper > F.greatest(F.lit(12), F.floor(F.length(c) / 3)), 1).otherwise(0)).cast("int")


def stance(c: Column) -> Column:
    low = F.lower(c)
    return F.when(holds_any(low, NEGATIVE), "negative").when(holds_any(low, POSITIVE), "positive").otherwise("neutral")


def group_label(topic: Column, kind: Column, c: Column) -> Column:
    """A paragraph's group: its topic, else by type, and for results by what they tell."""
    low = F.lower(c)
    result = F.when(holds_any(low, ("detect", "resistant-isolate", "resistant isolate", "resistance")), "Resistance detection").when(holds_any(low, ("auroc", "auc", "accuracy", "sensitivity", "specificity", "performance")), "Model performance").when(holds_any(low, ("susceptibility", "antibiotic", "antimicrobial")), "Antimicrobial susceptibility").otherwise("Result evidence")
    named = choose(kind, {"method": "Methods", "dataset_population": "Dataset and population", "limitation": "Limitations"}, "Claims")
    return F.coalesce(F.nullif(F.trim(topic), F.lit("")), F.when(kind == "result", result).otherwise(named))


def role(kind: Column, c: Column) -> Column:
    """struct(role, action, reason) of an evidence row in a plan: include, appendix or exclude."""
    front = r"(?i)\b(?:keywords?\s*:|original research\s+published\s*:|received\s*:|accepted\s*:|published\s*:)"
    formula = r"(?iu)(?:\bformally\b|\blearning objective\b|\bloss function\b|[ℒ∑𝜆𝛼𝛽µμ]|(?:^|\s)[A-Z]\s*=|=\s*[A-Z_a-z(])"
    low = F.lower(c)
    r = F.when(holds_any(low, FRONT_SIGNS) & c.rlike(front), "front_matter").when(holds_any(low, FORMULA_SIGNS) & c.rlike(formula), "formula_detail").when(kind.isin(*ROLES), kind).otherwise("claim")
    actions = {"front_matter": "exclude", "metadata_noise": "exclude", "formula_detail": "appendix", "method_detail": "appendix"}
    reasons = {"front_matter": "front matter is not evidentiary prose", "formula_detail": "formula details belong outside narrative prose", "method_detail": "technical method details belong outside main prose", "metadata_noise": "metadata noise is not evidence"}
    # through an array, so that the patterns are tried once and not for each field that is read
    return F.get(F.transform(F.array(r), lambda x: F.struct(x.alias("role"), choose(x, actions, "include").alias("action"), choose(x, reasons, "usable evidence for narrative prose").alias("reason"))), 0)


def draft_sentences(c: Column) -> Column:
    """Sentences of a draft, without headings and rules; an initial such as "E. coli" doesn't end one."""
    kept = F.regexp_replace(c, r"(?<![A-Za-z])([A-Z])\.\s+(?=[a-z])", "$1\x01 ")
    parts = F.transform(F.split(kept, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("\x01"), F.lit(".")), r"\s+", " ")))
    return F.filter(parts, lambda s: ~s.rlike("^(#|-*$)"))


def bare_sentence(c: Column) -> Column:
    """A sentence without its bullet and bold section label."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[-*] \s*", ""), r"(?i)^\*\*(Background|Methods|Results|Limitations):?\*\*:?\s*", ""))


def section_key(c: Column) -> Column:
    low = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "^[# ]+", ""), r"\s+", " ")))
    return F.when(low.contains("background"), "background").when(low.contains("method"), "methods").when(holds_any(low, ("result", "finding", "model performance")), "results").when(holds_any(low, ("limitation", "material gap")), "limitations").otherwise(F.replace(low, F.lit(" "), F.lit("_")))


# --- claims and evidence tables ---------------------------------------------------------------------------------------


def numbered(df: DataFrame, group: str, order: list, prefix: str, name: str) -> DataFrame:
    """``df`` with ids such as C1, C2 in each group, by ``order``, which must be unique. A group is one report or batch."""
    return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("string")))


def claim_support(claims: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Claims (evidence_type, citation, page_number) with claim_id, by type and ``order``, and support_status."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("claim", "method", "result", "dataset_population", "limitation")]), F.col("evidence_type"))
    anchored = (F.col("page_number") > 0) & (F.coalesce("citation", F.lit("")) != "")
    known = claims.where(place > 0)
    return numbered(known, group, [place, *order], "C", "claim_id").withColumn("support_status", F.when(anchored, "SUPPORTED").otherwise("MISSING_PAGE_ANCHOR"))


def support_summary(audited: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Counts and status of each group's claims: pass if some are supported and none lacks its page; a group without claims has one gap."""
    n = audited.groupBy(group).agg(F.count_if(F.col("support_status") == "SUPPORTED").alias("supported"), F.count_if(F.col("support_status") != "SUPPORTED").alias("missing_page_anchor"))
    out = groups.select(group).distinct().join(n, group, "left").na.fill(0, ["supported", "missing_page_anchor"])
    total = F.col("supported") + F.col("missing_page_anchor")
    return out.withColumns({"material_gaps": F.when(total == 0, 1).otherwise(0), "total_checked": total, "status": F.when((F.col("supported") > 0) & (F.col("missing_page_anchor") == 0), "pass").otherwise("gaps")})


def evidence_tables(claims: DataFrame, references: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Claims with row_id, their table, and their paper's title, year, journal, doi and source (references has ``group`` and label)."""
    kind = F.coalesce(F.nullif("evidence_type", F.lit("")), F.lit("claim"))
    refs = references.select(group, F.col("label").alias("paper"), F.col("title").alias("paper_title"), "year", "journal", "doi", "source").dropDuplicates([group, "paper"])
    rows = numbered(claims, group, order, "E", "row_id").withColumn("table", choose(kind, TABLES, "claims"))
    return rows.join(refs, [group, "paper"], "left")


def clusters(claims: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Of each group and type: counts of claims and papers, the papers, the citations in order, and a paragraph of the first three claims."""
    row = F.struct(*order, F.col("citation").alias("_c"), F.col("text").alias("_t"))
    agg = claims.groupBy(group, "evidence_type").agg(F.count("*").alias("claim_count"), F.array_sort(F.collect_set("paper")).alias("papers"), F.array_sort(F.collect_list(row)).alias("_r"))
    cited = F.transform("_r", lambda r: r["_c"])
    said = F.array_join(F.transform(F.slice("_r", 1, 3), lambda r: r["_t"]), "; ")
    text = F.concat(F.lit("Across "), F.size("papers").cast("string"), F.when(F.size("papers") == 1, " paper, ").otherwise(" papers, "), F.col("evidence_type"), F.lit(" evidence includes "), said, F.lit(" ["), F.array_join(cited, "; "), F.lit("]."))
    return agg.select(group, "evidence_type", "claim_count", F.size("papers").alias("paper_count"), "papers", cited.alias("citations"), text.alias("paragraph"))


def paragraph_audit(blocks: DataFrame) -> DataFrame:
    """Paragraphs of blocks (block_id, status, paragraph, citations): support_status and the first reason against it."""
    parts = F.filter(F.transform(F.split(F.trim(F.coalesce("paragraph", F.lit(""))), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    out = blocks.withColumn("_p", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))))
    rest = [c for c in blocks.columns if c not in ("paragraph", "citations")]
    out = out.select(*rest, F.coalesce("citations", none()).alias("available_citations"), F.posexplode("_p").alias("_i", "paragraph"))
    keys = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("paragraph", F.lit(r"\[([^\]]+)\]"), 1), lambda g: F.transform(F.regexp_extract_all(g, F.lit(r"\bP\d+\s+p\d+\b"), 0), lambda x: F.regexp_replace(x, r"\s+", " ")))))
    out = out.withColumn("citations", keys).withColumn("unknown_citations", F.array_except("citations", "available_citations"))
    reason = (
        F.when(~F.col("status").eqNullSafe("SUPPORTED"), "unsupported_block_status").when(F.col("paragraph") == "", "empty_paragraph").when(F.size("available_citations") == 0, "no_page_anchored_evidence")
        .when(F.size("citations") == 0, "missing_page_citation").when(F.size("unknown_citations") > 0, "unknown_page_citation").otherwise("page_anchored")
    )
    ok = F.col("reason") == "page_anchored"
    return out.withColumn("reason", reason).withColumns({"paragraph_id": F.concat("block_id", F.lit("."), (F.col("_i") + 1).cast("string")), "support_status": F.when(ok, "SUPPORTED").otherwise("MATERIAL_GAP"), "evidence_count": F.when(ok, F.size("citations")).otherwise(0)}).drop("_i")


def usable_paragraph(status: Column, paragraph: Column, cited: Column) -> Column:
    """Whether a paragraph is supported and holds each of its citations literally."""
    return status.eqNullSafe("SUPPORTED") & (F.trim(paragraph) != "") & (F.size(cited) > 0) & F.forall(cited, lambda x: paragraph.contains(x))


def material_gaps(gaps: DataFrame, group: str, order: str) -> DataFrame:
    """The first gap of each message; empty messages go."""
    return gaps.where("message <> ''").groupBy(group, "message").agg(F.min_by("reason", order).alias("reason"), F.min(order).alias(order))


def groups_of(paragraphs: DataFrame, package: str) -> DataFrame:
    """Groups of paragraphs (ordinal, topic, evidence_type, paragraph, citations) by label, largest first, with their stances and whether they conflict."""
    p = paragraphs.withColumn("_l", group_label(F.col("topic"), F.col("evidence_type"), F.col("paragraph"))).withColumn("_s", stance(F.col("paragraph")))
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "citations", "_s")))
    agg = p.groupBy(package, F.lower("_l").alias("_k")).agg(F.max_by("_l", "ordinal").alias("group_label"), F.min_by("evidence_type", "ordinal").alias("evidence_type"), F.count("*").alias("paragraph_count"), rows.alias("_r"))
    agg = agg.withColumns({"citations": F.array_distinct(F.flatten(F.transform("_r", lambda r: r["citations"]))), "stances": F.array_sort(F.array_distinct(F.filter(F.transform("_r", lambda r: r["_s"]), lambda s: s != "neutral")))})
    agg = agg.withColumns({"citation_count": F.size("citations"), "papers": F.array_distinct(F.transform("citations", lambda c: F.substring_index(c, " ", 1))), "conflict": F.size("stances") == 2})
    agg = agg.withColumn("conflict_citations", F.when(F.col("conflict"), F.array_distinct(F.flatten(F.transform(F.filter("_r", lambda r: r["_s"] != "neutral"), lambda r: r["citations"])))).otherwise(none()))
    return numbered(agg, package, [F.desc("paragraph_count"), F.desc("citation_count"), F.col("group_label"), F.col("_k")], "G", "group_id").drop("_r", "_k")


def evidence_index(rows: DataFrame, report: str) -> DataFrame:
    """One row for each citation of usable evidence (text, citation, support_status, quality_label, ordinal and scores): joined texts, types, ids and least scores."""
    ok = F.coalesce(F.nullif("support_status", F.lit("")), F.lit("SUPPORTED")) == "SUPPORTED"
    r = rows.where(ok & ~F.col("quality_label").eqNullSafe("blocked") & (F.trim("text") != "") & (F.trim("citation") != ""))
    r = r.withColumn("_k", citations(F.concat(F.lit("["), "citation", F.lit("]")))).withColumn("citation", F.explode("_k"))
    listed = lambda c: F.array_distinct(F.filter(F.transform("_r", lambda x: x[c]), lambda x: x != ""))
    agg = r.groupBy(report, "citation").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.trim("text").alias("text"), F.coalesce("evidence_type", F.lit("")).alias("evidence_type"), F.coalesce("row_id", F.lit("")).alias("row_id")))).alias("_r"), *[F.round(F.min(c), 6).alias(f"min_{c}") for c in ("quality_score", "parse_confidence", "trust_score")])
    return agg.select(report, "citation", F.array_join(listed("text"), " ").alias("evidence"), listed("evidence_type").alias("evidence_types"), listed("row_id").alias("evidence_row_ids"), "min_quality_score", "min_parse_confidence", "min_trust_score")


# --- reports ----------------------------------------------------------------------------------------------------------


def report_lines(reports: DataFrame, report: str, text: str = "report") -> DataFrame:
    """Content lines, squeezed, with their section; headings, rules and tables left out."""
    raw = reports.select(report, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "_x")).withColumn("line", F.trim(F.regexp_replace("_x", r"\s+", " "))).where("line <> ''")
    head = F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", "^#+", "")))
    w = W.partitionBy(report).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    out = raw.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("")))
    return out.where(~F.col("line").rlike(r"^[#|]|^[|:\-\s]+$")).select(report, "line_no", "section", "line")


def report_sentences(reports: DataFrame, report: str, text: str = "report") -> DataFrame:
    """Prose sentences with section and place; a line with citations, or of a material gap or source, is one sentence."""
    own = report_lines(reports, report, text).where(~F.lower("section").isin(*APPENDED))
    whole = (F.size(citations(F.col("line"))) > 0) | F.col("line").rlike("^(- )?MATERIAL GAP:|^Source:")
    parts = F.when(whole, F.array("line")).otherwise(F.filter(F.split("line", r"(?<=[.!?])\s+(?=[A-Z*-])"), lambda s: F.trim(s) != ""))
    return own.select(report, "line_no", "section", F.posexplode(parts).alias("part", "sentence"))


def claim_units(reports: DataFrame, index: DataFrame, gaps: DataFrame, report: str, text: str = "report") -> DataFrame:
    """A report's claims with id, type, citations, support, verdict, and what their evidence amounts to.

    ``index`` is of evidence_index, ``gaps`` has ``report`` and message. Support is material_gap, uncited, unknown_citation,
    supported or weak_support; the verdict is material_gap, overstated, supported, weak or unsupported. Sentences that state
    nothing are left out.
    """
    s = report_sentences(reports, report, text)
    bare = bare_sentence(F.col("sentence"))
    s = s.withColumns({"_b": bare, "citations": sort_citations(citations(F.col("sentence")))}).withColumn("_n", F.size("citations"))
    stated = F.trim(F.regexp_replace(F.regexp_replace(strip_citations(F.regexp_replace("_b", r"^MATERIAL GAP:\s*", "")), r"\.+$", ""), r"\s+", " "))
    s = s.withColumns({"text": stated, "_t": terms(strip_citations(F.col("_b")))})
    low, where = F.lower("_b"), F.lower("section")
    gap = F.col("_b").startswith("MATERIAL GAP:") | (low.startswith("no ") & low.contains("evidence") & low.contains("available"))
    kind = (
        F.when(F.col("_b").startswith("Source:"), "structural").when(gap, "material_gap").when((F.col("_n") == 0) & (F.size(terms(F.col("_b"))) < 3), "structural").when(F.col("_n") == 0, "factual")
        .when((F.col("_n") > 1) | low.rlike(r"\b(across|both|combined|collectively|multiple|several|two|three|four|five|\d+\s+papers?)\b"), "synthesis").when(where.contains("limitation") | low.rlike(r"\blimitations?\b"), "limitation")
        .when(where.contains("method") | low.rlike(r"\b(method|using|used|classifier|model|assay|protocol)\b"), "method").when(where.contains("result") | low.rlike(r"\b(reported|found|showed|achieved|sensitivity|specificity|auc|auroc)\b"), "result").otherwise("factual")
    )
    s = numbered(s.withColumn("claim_type", kind).where("claim_type <> 'structural' and text <> ''"), report, ["line_no", "part"], "C", "claim_unit_id")
    key = [report, "claim_unit_id"]
    cited = s.select(*key, F.posexplode("citations").alias("_i", "citation")).join(index, [report, "citation"], "left")
    each = F.array_sort(F.collect_list(F.struct("_i", "citation", "evidence", F.coalesce("evidence_types", none()).alias("ty"), F.coalesce("evidence_row_ids", none()).alias("id"))))
    e = cited.groupBy(*key).agg(each.alias("_e"), *[F.min(c).alias(c) for c in ("min_quality_score", "min_parse_confidence", "min_trust_score")])
    e = e.select(*key, F.transform(F.filter("_e", lambda x: x["evidence"].isNull()), lambda x: x["citation"]).alias("unknown_citations"), F.array_join(F.transform("_e", lambda x: x["evidence"]), " ").alias("evidence"), F.array_distinct(F.flatten(F.transform("_e", lambda x: x["ty"]))).alias("evidence_types"), F.array_distinct(F.flatten(F.transform("_e", lambda x: x["id"]))).alias("evidence_row_ids"), "min_quality_score", "min_parse_confidence", "min_trust_score")
    out = s.join(e, key, "left").withColumns({c: F.coalesce(c, none()) for c in ("unknown_citations", "evidence_types", "evidence_row_ids")})
    known = gaps.select(report, F.trim(F.regexp_replace("message", r"\s+", " ")).alias("text")).distinct().withColumn("_g", F.lit(True))
    out = out.join(known, [report, "text"], "left").withColumn("gap_allowed", F.when(F.col("claim_type") == "material_gap", F.coalesce("_g", F.lit(False)) | F.lower("text").rlike("^no .*evidence.*available|^no .*available.*evidence")))
    enough = terms_support(F.col("_t"), terms(F.coalesce("evidence", F.lit(""))))
    out = out.withColumn("support_status", F.when(F.col("claim_type") == "material_gap", "material_gap").when(F.col("_n") == 0, "uncited").when(F.size("unknown_citations") > 0, "unknown_citation").when(enough, "supported").otherwise("weak_support"))
    out = out.withColumn("risk_terms", unsupported_overstatements(F.col("text"), F.col("citations"), F.col("evidence")))
    verdict = F.when(F.col("support_status") == "material_gap", "material_gap").when(F.size("risk_terms") > 0, "overstated").when(F.col("support_status") == "supported", "supported").when(F.col("support_status") == "weak_support", "weak").otherwise("unsupported")
    return out.withColumns({"verdict": verdict, "evidence_count": F.col("_n"), "section": F.coalesce(F.nullif("section", F.lit("")), F.lit("unknown"))}).drop("_b", "_n", "_t", "_g")


def faithfulness(reports: DataFrame, units: DataFrame, report: str) -> DataFrame:
    """Of each report: tier A (all cited, citations known), tier B (evidence overlaps, nothing overstated), counts by verdict; no claims pass."""
    first = F.count_if(F.col("support_status").isin("uncited", "unknown_citation") & ~F.col("sentence").rlike("^(?:" + "|".join(INTRODUCTIONS) + ")"))
    n = units.groupBy(report).agg(first.alias("a"), F.count_if(F.col("verdict").isin("weak", "overstated")).alias("b"), F.count_if(F.col("verdict") != "material_gap").alias("checked_claim_unit_count"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("supported", "weak", "overstated", "unsupported", "material_gap")])
    out = reports.select(report).join(n, report, "left").na.fill(0)
    word = lambda c: F.when(c == 0, "pass").otherwise("fallback")
    return out.withColumns({"tier_a_status": word(F.col("a")), "tier_b_status": word(F.col("b")), "status": word(F.col("a") + F.col("b"))}).drop("a", "b")


def plan_adherence(moves: DataFrame, units: DataFrame, report: str) -> DataFrame:
    """Issues of a report against its plan: missing_planned_move, partial_planned_move, out_of_order_planned_move, unplanned_claim.

    moves: section, ordinal, label, citations. A move that lacks citations of its section's claims is missing or partial and has
    no place in the order; the others must come in the plan's order of their first claims.
    """
    moves = moves.where(F.size("citations") > 0).select(report, "section", "ordinal", "label", "citations")
    own = units.select(report, section_key(F.col("section")).alias("section"), F.struct("line_no", "part").alias("_at"), "claim_unit_id", F.explode("citations").alias("citation"))
    said = durable(own)  # read twice: what finds the units, patterns over whole texts among it, runs once
    first = said.groupBy(report, "section", "citation").agg(F.min("_at").alias("_at"))
    m = moves.select(report, "section", "ordinal", "label", F.posexplode("citations").alias("_i", "citation")).join(first, [report, "section", "citation"], "left")
    key = [report, "section", "ordinal", "label"]
    m = m.groupBy(*key).agg(F.min("_at").alias("_at"), F.count("_at").alias("_n"), F.count("*").alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_at").isNull(), F.struct("_i", "citation")))).alias("_m"))
    m = m.withColumn("_whole", F.when(F.col("_n") == F.col("_all"), F.col("_at")))
    before = F.last("_whole", ignorenulls=True).over(W.partitionBy(report, "section").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1))
    m = m.withColumn("_before", before)
    rule = F.when(F.col("_n") == 0, "missing_planned_move").when(F.col("_n") < F.col("_all"), "partial_planned_move").when(F.col("_whole") < F.col("_before"), "out_of_order_planned_move")
    bad = m.withColumn("rule", rule).where("rule is not null").select(report, "rule", "section", F.col("label").alias("item"), F.transform("_m", lambda x: x["citation"]).alias("citations"))
    planned = moves.select(report, "section", F.explode("citations").alias("citation")).distinct()
    some = planned.select(report, "section").distinct()
    loose = said.join(some, [report, "section"], "left_semi").join(planned, [report, "section", "citation"], "left_anti")
    loose = loose.groupBy(report, "section", "claim_unit_id").agg(F.array_sort(F.collect_set("citation")).alias("citations"))
    return bad.unionByName(loose.select(report, F.lit("unplanned_claim").alias("rule"), "section", F.col("claim_unit_id").alias("item"), "citations"))


def prose_issues(reports: DataFrame, report: str, headings: tuple[str, ...] = (), blocked: DataFrame | None = None, text: str = "report", most_phrases: int = 5_000, most_bytes: int = 4_000_000) -> DataFrame:
    """Issues of a report's prose, one row for each rule (and blocked phrase), with up to five examples in order.

    ``blocked`` holds learned phrases in a column ``phrase``. They are counted and meet the lines in blocks of up to ``most_phrases``
    phrases and ``most_bytes`` bytes on average, so what is broadcast doesn't grow with them; each block is a pass over the lines.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    missing = F.filter(F.array(*[F.lit(h) for h in headings]) if headings else none(), lambda h: ~F.array_contains(F.transform(F.split(t, r"\r?\n"), lambda x: F.rtrim(x)), h))
    groups = F.transform(F.regexp_extract_all(t, F.lit(r"\[[^\]]+\]"), 0), lambda g: F.struct(g.alias("g"), F.size(F.filter(F.transform(F.split(F.regexp_replace(g, r"[\[\]]", ""), ";"), lambda x: F.trim(x)), lambda x: x.rlike(r"^P\d+\s+p\d+$|^\d+,?\s+[pP]\.?\s*\d+$"))).alias("n")))
    inner = F.transform(F.filter(groups, lambda g: (g["n"] > 0) & g["g"].rlike(r"P\d+\s+p\d+")), lambda g: g["g"])
    large = F.transform(F.filter(groups, lambda g: g["n"] > 4), lambda g: g["g"])
    wide = reports.select(report, F.explode(F.array(F.struct(F.lit("missing_required_heading").alias("rule"), missing.alias("x")), F.struct(F.lit("internal_citation_syntax").alias("rule"), inner.alias("x")), F.struct(F.lit("oversized_citation_bundle").alias("rule"), large.alias("x")))).alias("r")).select(report, "r.rule", F.array_distinct("r.x").alias("x")).where(F.size("x") > 0)
    wide = wide.select(report, "rule", F.lit(None).cast("string").alias("phrase"), F.when(F.col("rule") == "missing_required_heading", F.col("x")).otherwise(F.slice("x", 1, 5)).alias("examples"))
    rules = {
        "raw_evidence_dump_phrase": r"(?i)\bevidence\s+includes\b|\bAcross\s+\d+\s+papers?,\s+[^.]*\bevidence\b", "source_author_voice": r"(?i)\bin this work\b|\bin this paper\b|\bwe present\b|\bwe developed\b|\bwe demonstrate\b|\bour study\b",
        "awkward_report_phrase": r"(?i)study's study|\bsupported rows\b|\brow dump\b",
    }
    lines = report_lines(reports, report, text)
    hit = lines.select(report, "line_no", "line", F.explode(F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(k)) for k, p in rules.items()]))).alias("rule")).withColumn("phrase", F.lit(None).cast("string"))
    five = lambda df: df.groupBy(report, "rule", "phrase", "line").agg(F.min("line_no").alias("line_no")).groupBy(report, "rule", "phrase").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "line"))), 1, 5), lambda x: x["line"]).alias("examples"))
    out = wide.unionByName(five(hit))
    if blocked is not None:
        raw = reports.select(report, F.posexplode(F.split(t, r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
        phrases = blocked.select("phrase").where("trim(phrase) <> ''").distinct()
        size = phrases.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("b")).first()
        blocks = max(1, -(-size.n // most_phrases), -(-size.b // most_bytes))
        for i in range(blocks):
            block = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == i) if blocks > 1 else phrases
            learned = raw.join(F.broadcast(block), F.lower("line").contains(F.lower("phrase")))
            out = out.unionByName(five(learned.withColumn("rule", F.lit("feedback_blocked_phrase"))))
    return out


def report_trust(status: dict[str, Column]) -> Column:
    """struct(score, verdict, action, reasons) under the caps of failed audits.

    ``status`` holds citation, faithfulness, tier_a, tier_b, plan_adherence, semantic_faithfulness, prose_quality and critic.
    """
    lenient = lambda c: ~c.isin("pass", "unknown")
    s = {k: F.coalesce(v, F.lit("unknown")) for k, v in status.items()}
    semantic = s["semantic_faithfulness"]
    ladder = [
        (s["citation"] != "pass", 40, "citation_audit_failed", True), (s["faithfulness"] != "pass", 45, "faithfulness_failed", True), (lenient(s["tier_a"]), 45, "tier_a_failed", True), (lenient(s["tier_b"]), 55, "tier_b_failed", False),
        (lenient(s["plan_adherence"]), 50, "plan_adherence_failed", True), (semantic == "fallback", 45, "semantic_faithfulness_failed", True), (~semantic.isin("pass", "fallback"), 85, "semantic_verifier_not_run", False), (s["prose_quality"] != "pass", 70, "prose_quality_failed", False),
    ]
    blocked = F.lit(False)
    for hit, _, _, stops in ladder:
        blocked = blocked | hit if stops else blocked
    good = ~blocked & (s["critic"] == "pass") & (semantic == "pass")
    end = F.when(good, "critic_passed").when(~blocked, F.when(s["critic"] == "not_run", "critic_not_run").otherwise("critic_not_passed"))
    score = F.least(F.lit(100), *[F.when(hit, cap).otherwise(100) for hit, cap, _, _ in ladder], F.when(~blocked & ~good, 85).otherwise(100))
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, _, name, _ in ladder], end))
    return F.struct(score.alias("score"), F.when(blocked, "blocked").when(good, "publishable").otherwise("needs_review").alias("verdict"), F.when(blocked, "block").when(good, "publish").otherwise("human_review").alias("action"), reasons.alias("reasons"))


# --- gates over answers of a language model ---------------------------------------------------------------------------


def draft_issues(draft: Column, gaps: Column) -> Column:
    """struct(reason, sentence) of uncited factual sentences, then of lines that say more than a known gap.

    Drafts cite as ``[P1 p2]``: sentences are cut after a full stop, so one cited as ``[1, p. 2]`` counts as uncited.
    """
    bare = lambda s: F.trim(F.regexp_replace(s, "^[-* ]+", ""))
    gap_text = lambda s: F.trim(F.regexp_replace(bare(s), "^MATERIAL GAP:", ""))
    is_gap = lambda s: bare(s).startswith("MATERIAL GAP:")
    allowed = lambda s: (bare(s) == "") | F.when(is_gap(s), F.array_contains(gaps, gap_text(s))).otherwise(F.array_contains(gaps, bare(s)) | bare(s).rlike("^(Source|Claim audit):"))
    loose = F.filter(draft_sentences(draft), lambda s: (F.size(citations(s)) == 0) & ~allowed(s) & (F.size(F.regexp_extract_all(s, F.lit("[A-Za-z]{3,}"), 0)) >= 3))
    parts = F.split(F.concat(F.lit("\n"), draft), r"\n\s*(?=#)")
    tidy = lambda part: F.filter(F.transform(F.split(part, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.startswith("#"))
    within = lambda part: F.lower(F.substring_index(part, "\n", 1)).rlike("^#.*material gap")
    more = F.flatten(F.transform(parts, lambda p: F.filter(tidy(p), lambda x: F.when(is_gap(x), ~F.array_contains(gaps, gap_text(x))).otherwise(within(p) & ~F.array_contains(gaps, bare(x))))))
    more = F.when(F.size(gaps) > 0, more).otherwise(none())
    named = lambda arr, reason: F.transform(arr, lambda s: F.struct(F.lit(reason).alias("reason"), s.alias("sentence")))
    return F.concat(named(loose, "uncited_factual_sentence"), named(more, "material_gap_expansion"))


def composer_gate(success: Column, draft: Column, required: Column, gaps: Column) -> Column:
    """struct(status, reason) of a drafted section: the first rule that it breaks, else evidence_bound."""
    text, used = F.trim(F.coalesce(draft, F.lit(""))), citations(F.coalesce(draft, F.lit("")))
    issues = draft_issues(text, gaps)
    reason = F.when(~F.coalesce(success, F.lit(False)), "model_unavailable").when(text == "", "empty_model_output").when(F.size(F.array_except(used, required)) > 0, "unknown_citation").when((F.size(required) > 0) & (F.size(used) == 0), "missing_citations").when(F.size(issues) > 0, F.get(issues, 0)["reason"]).otherwise("evidence_bound")
    return F.struct(F.when(reason == "evidence_bound", "pass").otherwise("fallback").alias("status"), reason.alias("reason"))


def json_text(c: Column) -> Column:
    """The JSON object in a model's answer: without code fence and prose around it; null if there is none."""
    body = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), c)
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def verifier_gate(success: Column, answer: Column, draft: Column, required: Column) -> Column:
    """struct(status, reason, verdict) of a verifier's answer to a draft."""
    schema = "struct<verdict:string,status:string,unsupported_claims:array<string>,citation_errors:array<string>,missing_material_gaps:array<string>>"
    used, parsed = citations(draft), F.from_json(json_text(answer), schema, {"mode": "PERMISSIVE"})
    verdict = F.lower(F.trim(F.coalesce(F.nullif(parsed["verdict"], F.lit("")), parsed["status"], F.lit(""))))
    clean = F.lit(True)
    for k in ("unsupported_claims", "citation_errors", "missing_material_gaps"):
        clean = clean & (F.size(F.filter(F.coalesce(parsed[k], none()), lambda x: F.trim(x) != "")) == 0)
    readable = F.coalesce(F.try_parse_json(json_text(answer)).isNotNull(), F.lit(False))
    reason = F.when(F.size(F.array_except(used, required)) > 0, "unknown_citation").when((F.size(required) > 0) & (F.size(used) == 0), "missing_citations").when(~F.coalesce(success, F.lit(False)), "verifier_unavailable").when(~readable, "verifier_unparseable").when((verdict == "pass") & clean, "verified").otherwise("verifier_rejected")
    return F.struct(F.when(reason == "verified", "pass").otherwise("fallback").alias("status"), reason.alias("reason"), F.when(reason.isin("verified", "verifier_rejected"), F.coalesce(F.nullif(verdict, F.lit("")), F.lit("unknown"))).otherwise("fail").alias("verdict"))


def candidate_gate(success: Column, report: Column, audits: dict[str, Column], critic: Column) -> Column:
    """struct(status, reason) of a full report by a model: the first audit of citation, prose, faithfulness, plan and semantics that fails, then the critics."""
    names = {"citation": "citation_audit_failed", "prose_quality": "prose_quality_failed", "faithfulness": "faithfulness_failed", "plan_adherence": "plan_adherence_failed", "semantic_faithfulness": "semantic_faithfulness_failed"}
    reason = F.when(~F.coalesce(success, F.lit(False)), "model_unavailable").when(F.trim(F.coalesce(report, F.lit(""))) == "", "empty_model_output")
    for k, name in names.items():
        reason = reason.when((audits[k] == "fallback") if k == "semantic_faithfulness" else (audits[k] != "pass"), name)
    reason = reason.when(critic == "fallback", "critic_rejected").otherwise("candidate_accepted")
    return F.struct(F.when(reason == "candidate_accepted", "pass").otherwise("fallback").alias("status"), reason.alias("reason"))


def critic_panel(critics: DataFrame, report: str) -> DataFrame:
    """Critics (kind, verdict, issue_count) of a report: each passes with the verdict pass and no issue, the panel if all do."""
    ok = F.col("verdict").eqNullSafe("pass") & (F.col("issue_count") == 0)
    out = critics.groupBy(report).agg(F.count("*").alias("critic_count"), F.sum("issue_count").alias("issue_count"), F.array_sort(F.collect_set(F.when(~ok, F.col("kind")))).alias("failed_critic_kinds"))
    good = F.size("failed_critic_kinds") == 0
    return out.withColumns({"status": F.when(good, "pass").otherwise("fallback"), "reason": F.when(good, "critic_panel_passed").otherwise("critic_panel_rejected")})


def body_sentences(rows: DataFrame, move: str, order: list[str], most: int = 4) -> DataFrame:
    """The first ``most`` rows (text, citation, paper, evidence_type) of each move as reader-facing sentences."""
    w = W.partitionBy(move).orderBy(*order)
    r = rows.withColumns({"_i": F.row_number().over(w), "_before": F.lag("paper").over(w)}).where(F.col("_i") <= most)
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), r"\.+$", ""), r"\s+", " "))
    for old, new in (("^Our study did have its limitations$", "the study had limitations"), ("^Our study has (several )?limitations$", "the study has $1limitations"), (r"^In this (?:work|paper),\s+we present\s+", "the authors presented "), (r"^Here,\s+we demonstrate\s+", "the authors demonstrated "), (r"^We present\s+", "the authors presented "), (r"^We\s+", "the authors "), (r"^Our findings suggest\s+", "the findings suggest "), (r"^Our\s+", "the study's ")):
        t = F.regexp_replace(t, old, new)
    t = F.when(F.length(t) > 260, F.concat(F.regexp_replace(F.regexp_replace(F.substring(t, 1, 260), r" [^ ]*$", ""), "[ ,;:]+$", ""), F.lit("..."))).otherwise(t)
    r = r.withColumn("_b", t).withColumn("_b", F.when(F.col("_b").rlike(r"^\p{Lu}\p{Ll}"), F.concat(F.lower(F.substring("_b", 1, 1)), F.expr("substring(_b, 2)"))).otherwise(F.col("_b")))
    lead = F.when(F.col("_i") == 1, "One paper").when((F.col("paper") != "") & (F.col("paper") == F.col("_before")), "The same paper also").when(F.col("_i") == 2, "A second paper").otherwise("Another paper")
    shown = display_citations(citations(F.concat(F.lit("["), F.regexp_replace("citation", r"[\[\]]", ""), F.lit("]"))))
    return r.where((F.col("_b") != "") & (shown != "")).withColumn("sentence", F.concat_ws(" ", lead, choose(F.col("evidence_type"), VERBS, "reported that"), "_b", F.concat(shown, F.lit(".")))).drop("_b", "_before").withColumnRenamed("_i", "place")
