"""Review of drafts: issues of all audits with severity and prompt, next actions, report tables and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that block, and rules that are important whatever the audit's default.
BLOCKING = ("citation_audit_failed", "faithfulness_failed", "semantic_faithfulness_failed", "tier_a_failed", "unknown_citation", "uncited_factual_sentence", "overstated", "unsupported", "causal_overreach", "citation_mismatch")
IMPORTANT = ("tier_b_failed", "weak_evidence_overlap", "prose_quality_failed", "critic_not_run", "critic_not_passed", "critic_rejected", "critic_unavailable")
#: What a reviewer is asked for each rule, and for all others.
PROMPTS = {
    "critic_not_run": "No independent critic approved this report; review readability and faithfulness before publishing.",
    "critic_not_passed": "The critic did not approve this report; inspect the critic findings before reuse.",
    "critic_rejected": "The critic rejected the draft; decide whether the issue is evidence, prose, or both.",
    "citation_audit_failed": "Citation checks failed; verify every factual sentence has a valid paper/page marker.",
    "unknown_citation": "A citation marker was not found in the evidence map; repair or remove the sentence.",
    "faithfulness_failed": "The report contains claims that may not be supported by cited evidence.",
    "semantic_faithfulness_failed": "The semantic verifier rejected one or more report claims.",
    "overstated": "A claim may be broader than the cited evidence supports.",
    "unsupported": "A report claim may not be supported by its cited evidence.",
    "causal_overreach": "A causal claim may go beyond the cited evidence.",
    "citation_mismatch": "A claim may be attached to a citation that does not support it.",
    "tier_a_failed": "A hard citation or material-gap rule failed; do not publish without repair.",
    "tier_b_failed": "A cited sentence has weak overlap with its evidence; verify the claim manually.",
    "weak_evidence_overlap": "Check whether this sentence is actually supported by the cited evidence.",
    "prose_quality_failed": "The report failed readability/prose-quality checks; rewrite before sharing.",
    "raw_evidence_dump_phrase": "Rewrite table-like evidence fragments into reader-facing synthesis.",
    "internal_citation_syntax": "Replace internal P/page syntax with reader-facing citations.",
    "source_author_voice": "Rewrite extracted paper voice into neutral report prose.",
    "awkward_report_phrase": "Revise the sentence so it reads naturally.",
}
OTHER_PROMPT = "Inspect this item and decide whether the draft should be approved, revised, or blocked."
#: What to do next, by the reviewer's decision, else by the draft's state.
DECISIONS = {"approve": "Record the approved package as a benchmark candidate."} | dict.fromkeys(("reject", "bad_evidence", "citation_issue"), "Do not publish this draft; fix evidence/citation issues and rerun the report gates.") | dict.fromkeys(("needs_rewrite", "too_confusing"), "Revise the draft for readability, then rerun prose and faithfulness gates.")
OTHER_DECISION = "Use the captured feedback to decide whether to revise, block, or approve the draft."
BLOCKED = "Review blocking evidence/citation issues before sharing this report."
QUEUE = "Complete the review queue, then capture a decision with {}."
SKIM = "Complete a final human skim and capture the decision if the draft will be reused."
FINAL_CHECK = "Skim the report for readability, citation clarity, and unsupported claims before sharing."


def severity(rule: Column, default: Column) -> Column:
    return F.when(rule.isin(*BLOCKING), "blocking").when(rule.isin(*IMPORTANT), "important").otherwise(default)


def prompt(rule: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])
    return F.coalesce(F.element_at(table, rule), F.lit(OTHER_PROMPT))


def review_items(audits: list[tuple[str, str, DataFrame]], packages: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """One row for each issue of all audits: (source, default severity, issues with key, rule and ``order``), numbered R1, R2, ... in each package.

    A package without issues gets one low item, the final check by a reader. A package's issues are the lines of one
    draft, so its window is small.
    """
    from .report import numbered

    rows = None
    for place, (source, default, issues) in enumerate(audits):
        own = issues.select(key, F.lit(place).alias("place"), F.col(order).alias("ordinal"), F.lit(source).alias("source"), "rule", severity(F.col("rule"), F.lit(default)).alias("severity"), prompt(F.col("rule")).alias("prompt"))
        rows = own if rows is None else rows.unionByName(own)
    clean = packages.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti")
    last = clean.select(key, F.lit(len(audits)).alias("place"), F.lit(0).cast("long").alias("ordinal"), F.lit("draft_review").alias("source"), F.lit("final_human_check").alias("rule"), F.lit("low").alias("severity"), F.lit(FINAL_CHECK).alias("prompt"))
    return numbered(rows.unionByName(last), key, [F.col("place"), F.col("ordinal"), F.col("rule")], "R", "id")


def next_action(decision: Column, action: Column, blocking: Column, command: str = "review-draft") -> Column:
    """A reviewer's decision decides (an empty one counts as given), else blocking issues, else the trust action. ``command`` captures decisions."""
    said = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair]), decision), F.lit(OTHER_DECISION))
    return F.when(decision.isNotNull(), said).when((action == "block") | blocking, BLOCKED).when(action == "human_review", QUEUE.format(command)).otherwise(SKIM)


def escape_cell(c: Column) -> Column:
    """A text as a cell of a Markdown table."""
    return F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit(r"\|"))


def markdown_table(df: DataFrame, columns: list[str], order: list[Column], most: int = 30) -> list[str]:
    """Lines of a table of the first rows by ``order``, which a report shows; files hold all rows."""
    rows = df.orderBy(*order).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[escape_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |")).alias("line")).collect()
    return [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}", *[r.line for r in rows]]


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """All rows as CSV with a header; null is empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
