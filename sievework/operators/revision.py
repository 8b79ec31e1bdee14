"""Bounded revision: rejected drafts go round again with what failed, until they pass, stop or have no attempt left.

A round is a join of the drafts still open with their answers and a verdict on each. It is stored, and only rows that may
go on enter the next, so a round's work is that of its open drafts; no round runs once none is open. Answers come from the
caller: from a table of recorded ones (``recorded``), or from a step that asks a model.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import counted
from .repair import ordered_unique, repair_context
from .report import STRINGS, composer_gate, json_text, none, verifier_gate

#: Attempts at a section and at a report.
SECTION_ATTEMPTS, REPORT_ATTEMPTS = 3, 2


def recorded(answers: DataFrame, keys: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """Answers from a table of keys, attempt and the answer's columns; a draft without one has nulls."""

    def answer(open_: DataFrame, attempt: int) -> DataFrame:
        return open_.join(answers.where(F.col("attempt") == attempt).drop("attempt"), keys, "left")

    return answer


def bounded_rounds(open_: DataFrame, keep: list[str], answer: Callable[[DataFrame, int], DataFrame], verdict: Callable[[DataFrame], DataFrame], next_: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """A row for each draft and attempt: ``keep``, attempt, last (whether it ended there) and what ``verdict`` adds.

    ``verdict`` adds again, whether a rejected row may try once more; ``next_`` makes of such rows the drafts of the next
    round. Keys of open_ are to be distinct.
    """
    rounds = []
    for attempt in range(1, max(most, 1) + 1):
        judged = verdict(answer(open_, attempt)).withColumn("attempt", F.lit(attempt))
        judged = judged.withColumn("last", ~F.coalesce("again", F.lit(False)) | (F.lit(attempt) >= most))
        judged, seen = counted(judged, going=(~F.col("last")).cast("long"))
        rounds.append(judged.select(*keep, "attempt", "last", *[c for c in judged.columns if c not in {*keep, "attempt", "last", "again"}]))
        if not seen["going"]:
            break
        open_ = next_(judged.where(~F.col("last")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rounds)


def verifier_failures(answer: Column) -> Column:
    """What a verifier's answer complains of: its summary, claims, citations and gaps, each text once."""
    parsed = F.from_json(json_text(answer), "struct<summary:string,unsupported_claims:array<string>,citation_errors:array<string>,missing_material_gaps:array<string>>", {"mode": "PERMISSIVE"})
    lists = [F.coalesce(parsed[k], none()) for k in ("unsupported_claims", "citation_errors", "missing_material_gaps")]
    return ordered_unique(F.concat(F.array(parsed["summary"]), *lists))


def section_revisions(drafts: DataFrame, answer: Callable[[DataFrame, int], DataFrame], keys: list[str], most: int = SECTION_ATTEMPTS) -> DataFrame:
    """Rejected sections, revised up to ``most`` times; a row for each attempt.

    drafts: keys, draft (the rejected one), failures (texts), allowed (citations), gaps (texts). ``answer`` adds success,
    text, verifier_success and verifier_text to them; it is given repair columns level, failed_sentences and implicated. A text passes the composer's
    gate, then the verifier's. Only a text that the verifier rejects is tried again, itself being the draft, and the
    verifier's complaints what failed. Returned: keys, attempt, last, status, reason, composer_reason, verifier_reason,
    revised, accepted (the text if it passed), level, failed_sentences, implicated.
    """

    def asked(rows: DataFrame, attempt: int) -> DataFrame:
        fails = rows.select(*keys, F.posexplode(F.coalesce("failures", none())).alias("ordinal", "text"))
        return answer(rows.join(repair_context(rows, fails, keys), keys), attempt)

    def verdict(rows: DataFrame) -> DataFrame:
        text = F.trim(F.coalesce("text", F.lit("")))
        allowed, gaps = F.coalesce("allowed", none()), F.coalesce("gaps", none())
        rows = rows.withColumns({"revised": text, "composer": composer_gate(F.col("success"), text, allowed, gaps)})
        rows = rows.withColumn("verifier", F.when(F.col("composer.status") == "pass", verifier_gate(F.col("verifier_success"), F.col("verifier_text"), F.col("revised"), allowed)))
        rejected = F.col("verifier.reason").eqNullSafe("verifier_rejected")
        passed = F.col("verifier.status").eqNullSafe("pass")
        reason = F.when(passed, "revision_verified").when(rejected, "revision_rejected").otherwise(F.coalesce("verifier.reason", F.lit("revision_not_trusted")))
        return rows.withColumns({"again": rejected, "status": F.when(passed, "pass").otherwise("fallback"), "reason": reason, "accepted": F.when(passed, F.col("revised")), "composer_reason": F.col("composer.reason"), "verifier_reason": F.col("verifier.reason"), "complaints": verifier_failures(F.col("verifier_text"))})

    def next_(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, F.col("revised").alias("draft"), F.col("complaints").alias("failures"), "allowed", "gaps")

    out = bounded_rounds(drafts.select(*keys, "draft", F.col("failures").cast(STRINGS).alias("failures"), "allowed", "gaps"), keys, asked, verdict, next_, most)
    return out.select(*keys, "attempt", "last", "status", "reason", "composer_reason", "verifier_reason", "revised", "accepted", "level", "failed_sentences", "implicated")


#: The audits that a revised report must pass before the critics see it.
REPORT_AUDITS = ("citation", "prose_quality", "faithfulness", "plan_adherence")


def report_revisions(reports: DataFrame, answer: Callable[[DataFrame, int], DataFrame], keys: list[str], most: int = REPORT_ATTEMPTS) -> DataFrame:
    """Reports that the critics rejected, revised up to ``most`` times; a row for each attempt.

    reports: keys, report. ``answer`` adds success, text, the states of ``REPORT_AUDITS``, semantic and critic. A report
    goes round again only if all audits pass and the critics alone reject it; a failed audit ends it. Returned: keys,
    attempt, last, status, reason, accepted (the text if it passed).
    """

    def verdict(rows: DataFrame) -> DataFrame:
        text = F.trim(F.coalesce("text", F.lit("")))
        audits = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe("pass") for k in REPORT_AUDITS]) & ~F.col("semantic").eqNullSafe("fallback")
        critics = F.col("critic").isNull() | (F.col("critic") == "pass")
        reason = F.when(~F.coalesce("success", F.lit(False)), "revision_unavailable").when(text == "", "empty_revision").when(audits & critics, "revision_accepted").otherwise("revision_rejected")
        again = (reason == "revision_rejected") & audits
        return rows.withColumns({"again": again, "status": F.when(reason == "revision_accepted", "pass").otherwise("fallback"), "reason": reason, "revised": text, "accepted": F.when(reason == "revision_accepted", text)})

    out = bounded_rounds(reports.select(*keys, "report"), keys, answer, verdict, lambda rows: rows.select(*keys, F.col("revised").alias("report")), most)
    return out.select(*keys, "attempt", "last", "status", "reason", "accepted")


def final_drafts(drafts: DataFrame, attempts: DataFrame, keys: list[str], draft: str = "draft") -> DataFrame:
    """keys, final (the accepted revision, else the draft as it was), attempts, status, reason of each draft."""
    ends = attempts.where("last").select(*keys, "accepted", F.col("attempt").alias("attempts"), "status", "reason")
    return drafts.select(*keys, draft).join(ends, keys, "left").select(*keys, F.coalesce("accepted", draft).alias("final"), "attempts", "status", "reason")
