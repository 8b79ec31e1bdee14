"""Gated appends: rows join a stored table only after gates pass over them, all at once or not at all, and never twice.

A batch is staged below ``<table>/batches/batch_id=<id>``, judged, and published by renaming one small file into
``<table>/published``; readers see published batches alone. A run that is lost before the rename leaves nothing that is read,
and a run repeated after it finds the batch published and does nothing. The rename is one step where the file system has
one (HDFS, local disks); on others two runs of one batch at once are not kept apart, but a batch is still read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import digest
from .report import none

#: The gates of a proposal that names none, and the rule file of each target.
GATES = ("gold", "real-smoke")
RULE_FILES = {"report_prose_quality": "prose_quality.json", "report_faithfulness_audit": "faithfulness.json", "citation_audit": "citation.json", "topic_routing": "topic_routing.json", "topic_profile": "topic_routing.json", "benchmark_pack": "benchmark.json"}


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _system(spark, path)
    return system.exists(at)


def published(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of all published batches, with batch_id. Batches are partitions, so those not published aren't read."""
    if not _exists(spark, f"{table}/published"):
        return spark.createDataFrame([], f"{schema}, batch_id string")
    marks = spark.read.schema("batch_id string, rows long, digest string").json(f"{table}/published/*").select("batch_id").distinct()
    rows = spark.read.schema(f"{schema}, batch_id string").parquet(f"{table}/batches")
    return rows.join(F.broadcast(marks) if marks.count() <= 1_000_000 else marks, "batch_id").select(*[c for c in rows.columns if c != "batch_id"], "batch_id")


@dataclass(frozen=True)
class Appended:
    """status: applied, blocked (by failed gates) or already_applied; rows: how many are new."""

    status: str
    rows: int
    failed: tuple[str, ...] = ()


def append_gated(rows: DataFrame, table: str, batch_id: str, gates: Callable[[DataFrame], DataFrame], required: tuple[str, ...] = GATES) -> Appended:
    """Appends rows as one batch if every required gate passes. ``gates`` of the staged rows: gate, status.

    A gate that is missing, fails or has several statuses of which one isn't ``pass`` blocks the batch, and its stage is deleted. What
    ``gates`` raises goes to the caller, nothing being published; the stage is written anew by the next run.
    """
    spark = rows.sparkSession
    mark, stage = f"{table}/published/{batch_id}", f"{table}/batches/batch_id={batch_id}"
    if _exists(spark, mark):
        return Appended("already_applied", 0)
    rows.write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(rows.schema).parquet(stage)
    found = gates(staged).groupBy("gate").agg(F.bool_and(F.col("status").eqNullSafe("pass")).alias("ok")).where(F.col("gate").isin(*required))
    good = {r.gate for r in found.where("ok").collect()}  # at most one row for each required gate
    if failed := tuple(g for g in required if g not in good):
        system, at = _system(spark, stage)
        system.delete(at, True)
        return Appended("blocked", 0, failed)
    whole = digest(staged).first()
    text = spark.createDataFrame([(batch_id, whole["rows"], whole["digest"])], "batch_id string, rows long, digest string")
    draft = f"{table}/drafts/{batch_id}"
    text.coalesce(1).write.mode("overwrite").json(draft)
    system, at = _system(spark, draft)
    jvm = spark.sparkContext._jvm
    part = next(f.getPath() for f in system.listStatus(at) if f.getPath().getName().startswith("part-"))
    system.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{table}/published"))
    moved = system.rename(part, jvm.org.apache.hadoop.fs.Path(mark))
    system.delete(at, True)
    return Appended("applied", whole["rows"]) if moved else Appended("already_applied", 0)


def tuning_outcomes(proposals: DataFrame, decisions: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """key, outcome (applied, blocked or refused), reason, gates, failed_gates of each proposal.

    proposals: key, required (gates). decisions: key, decision, apply_status, required. reports: key, gate, status; a report that
    is missing has failed. Gates are the decision's, else the proposal's, else ``GATES``. Only what is approved and not applied is tried.
    """
    some = lambda c: F.filter(F.coalesce(c, none()), lambda g: F.trim(g) != "")
    both = proposals.select(key, some(F.col("required")).alias("_own")).join(decisions.select(key, "decision", "apply_status", some(F.col("required")).alias("_named")), key, "left")
    gates = F.when(F.size("_named") > 0, F.col("_named")).when(F.size("_own") > 0, F.col("_own")).otherwise(F.array(*[F.lit(g) for g in GATES]))
    both = both.withColumn("gates", gates)
    passed = reports.groupBy(key, "gate").agg(F.bool_and(F.col("status").eqNullSafe("pass")).alias("ok")).where("ok").groupBy(key).agg(F.collect_set("gate").alias("_passed"))
    out = both.join(passed, key, "left").withColumn("failed_gates", F.array_except("gates", F.coalesce("_passed", none())))
    reason = F.when(~F.col("decision").eqNullSafe("approved"), "not_approved").when(~F.col("apply_status").eqNullSafe("not_applied"), "not_applyable").when(F.size("failed_gates") > 0, "eval_gate_failed")
    outcome = F.when(reason.isNull(), "applied").when(reason == "eval_gate_failed", "blocked").otherwise("refused")
    return out.select(key, outcome.alias("outcome"), reason.alias("reason"), "gates", "failed_gates")


def tuning_rules(outcomes: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """The rules of applied proposals: key, ordinal, target, action, value, reason, file. actions: key, ordinal, target, action, value, reason."""
    named = F.create_map(*[F.lit(x) for kv in RULE_FILES.items() for x in kv])
    target = F.coalesce(F.nullif("target", F.lit("")), F.lit("general"))
    own = actions.join(outcomes.where("outcome = 'applied'").select(key), key, "left_semi")
    return own.select(key, "ordinal", target.alias("target"), F.coalesce(F.nullif("action", F.lit("")), F.lit("review")).alias("action"), F.coalesce("value", F.lit("")).alias("value"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(F.try_element_at(named, target), F.lit("general.json")).alias("file"))
