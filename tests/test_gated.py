"""Gated appends: blocked, published once, lost half-way and repeated; outcomes of tuning proposals."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import gated

SCHEMA = "k int, v string"


def gates(**states):
    return lambda df: df.sparkSession.createDataFrame([(g.replace("_", "-"), s) for g, s in states.items()], "gate string, status string")


def test_a_batch_is_published_once(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], SCHEMA)
    read = lambda: sorted(((r.k, r.v, r.batch_id) for r in gated.published(spark, table, SCHEMA).collect()), key=repr)
    assert read() == []
    assert gated.append_gated(rows, table, "b1", gates(gold="pass")) == gated.Appended("blocked", 0, ("real-smoke",))
    assert gated.append_gated(rows, table, "b1", gates(gold="pass", real_smoke="fail")) == gated.Appended("blocked", 0, ("real-smoke",))
    assert gated.append_gated(rows, table, "b1", gates(gold=None, real_smoke="pass")).failed == ("gold",) and read() == []
    assert gated.append_gated(rows, table, "b1", gates(gold="pass", real_smoke="pass", core="fail")) == gated.Appended("applied", 3)
    assert gated.append_gated(rows, table, "b1", gates(gold="pass", real_smoke="pass")) == gated.Appended("already_applied", 0)
    assert read() == [(1, "a", "b1"), (1, "a", "b1"), (2, None, "b1")]
    assert gated.append_gated(rows.limit(0), table, "b2", gates(gold="pass"), ("gold",)) == gated.Appended("applied", 0)
    assert len(read()) == 3


def test_a_run_lost_half_way_leaves_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], SCHEMA)

    def lost(_):
        raise RuntimeError("lost")

    ok = gates(gold="pass", real_smoke="pass")
    assert gated.append_gated(rows, table, "b1", ok).rows == 1
    with pytest.raises(RuntimeError):
        gated.append_gated(rows, table, "b2", lost)
    assert gated.published(spark, table, SCHEMA).count() == 1
    assert gated.append_gated(rows.withColumn("v", F.lit("b")), table, "b2", ok).rows == 1
    assert sorted(r.v for r in gated.published(spark, table, SCHEMA).collect()) == ["a", "b"]


def test_gates_see_the_staged_rows(spark, tmp_path):
    judge = lambda df: df.agg(F.count("*").alias("n")).select(F.lit("gold").alias("gate"), F.when(F.col("n") < 2, "pass").otherwise("fail").alias("status"))
    one, two = spark.createDataFrame([(1, "a")], SCHEMA), spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert [gated.append_gated(x, str(tmp_path / "t"), b, judge, ("gold",)).status for x, b in ((one, "x"), (two, "y"))] == ["applied", "blocked"]


def test_outcomes_and_rules(spark):
    p = spark.createDataFrame([("a", None), ("b", ["core"]), ("c", [" "]), ("d", []), ("e", []), ("f", ["core"])], "k string, required array<string>")
    d = spark.createDataFrame([("a", "approved", "not_applied", None), ("b", "approved", "not_applied", []), ("c", "approved", "applied", None), ("d", "rejected", "not_applicable", None), ("f", "approved", "not_applied", ["gold"])], "k string, decision string, apply_status string, required array<string>")
    r = spark.createDataFrame([("a", "gold", "pass"), ("a", "real-smoke", "pass"), ("a", "real-smoke", "fail"), ("b", "core", "pass"), ("f", "gold", "pass")], "k string, gate string, status string")
    out = gated.tuning_outcomes(p, d, r, "k")
    got = {x.k: (x.outcome, x.reason, x.failed_gates) for x in out.collect()}
    assert got["a"] == ("blocked", "eval_gate_failed", ["real-smoke"]) and got["b"] == ("applied", None, []) and got["f"] == ("applied", None, [])
    assert got["c"][:2] == ("refused", "not_applyable") and got["d"][:2] == ("refused", "not_approved") and got["e"][:2] == ("refused", "not_approved")
    acts = spark.createDataFrame([("a", 1, "x", "y", "z", "w"), ("b", 1, "topic_profile", "add", "v", None), ("b", 2, "", None, None, "r")], "k string, ordinal int, target string, action string, value string, reason string")
    assert sorted(tuple(x) for x in gated.tuning_rules(out, acts, "k").collect()) == [("b", 1, "topic_profile", "add", "v", "", "topic_routing.json"), ("b", 2, "general", "review", "", "r", "general.json")]
