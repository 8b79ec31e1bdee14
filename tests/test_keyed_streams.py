"""Streams with keyed state: label events against the batch operator over restarts, late and repeated events, first arrivals."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import store
from sievework.streaming import keyed

EVENTS = "b string, k string, label string, label_source string, confidence double, overwrite_human boolean, at timestamp, ordinal long, note string"
SETTING, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(SETTING)
    spark.conf.set(SETTING, ROCKS)
    yield spark
    spark.conf.set(SETTING, before)


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def drain(df, checkpoint, mode="update", **trigger):
    rows = []
    df.writeStream.outputMode(mode).foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return rows


def test_labels(rocks, tmp_path):
    data, check = str(tmp_path / "in"), tmp_path / "check"
    add = lambda rows: rocks.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(data)
    run = lambda: drain(keyed.label_stream(rocks.readStream.schema(EVENTS).parquet(data), ["b", "k"]), check)
    shown = lambda rows: sorted((r.k, r.kind, r.reason or r.label, r.label_source, r.created_at, r.updated_at) for r in rows)
    human = ("x", "a", " Relevant ", "HUMAN", None, True, at(1), 1, "why")
    add([human, ("x", "b", "maybe", "agent", 0.5, False, at(1), 2, None), ("x", "c", "include", "human", None, True, at(1), 3, None), ("x", "c", "maybe", "robot", None, True, at(1), 4, None), ("x", "c", "maybe", "agent", 1.5, True, at(1), 5, None), ("x", "c", "maybe", "agent", None, True, None, 6, None)])
    got = run()
    assert shown(r for r in got if r.kind == "label") == [("a", "label", "relevant", "human", at(1), at(1)), ("b", "label", "maybe", "agent", at(1), at(1))]
    assert sorted(r.reason for r in got if r.kind == "refused") == ["confidence_out_of_range", "no_place", "unknown_label", "unknown_label_source"]
    assert [r.note for r in got if r.k == "a"] == ["why"]
    # an agent leaves the human's label alone, another label moves; a repeated event changes nothing
    add([("x", "a", "irrelevant", "agent", 0.9, False, at(5), 7, None), ("x", "b", "relevant", "agent", 0.9, False, at(5), 8, None), human])
    assert shown(run()) == [("b", "label", "relevant", "agent", at(1), at(5))]
    # a late event of a human binds what stood since, and moves the time of creation
    add([("x", "b", "irrelevant", "human", None, False, at(0), 0, None)])
    assert shown(run()) == [("b", "label", "irrelevant", "human", at(0), at(0))]
    # an agent that may overwrite does
    add([("x", "a", "maybe", "agent", 0.7, True, at(9), 9, None)])
    assert shown(run()) == [("a", "label", "maybe", "agent", at(1), at(9))]
    assert run() == []


def test_labels_equal_the_batch_operator_in_any_order(rocks, tmp_path):
    rng, data = random.Random(5), str(tmp_path / "in")
    events = [("x", "k%d" % rng.randrange(6), rng.choice(["relevant", "maybe", "irrelevant", "no"]), rng.choice(["human", "agent", "agent"]), 0.5, rng.random() < 0.3, at(rng.randrange(40)), i, None) for i in range(120)]
    want = {r.k: (r.label, r.label_source, r.created_at, r.updated_at) for r in store.apply_labels(rocks.createDataFrame(events, EVENTS), ["b", "k"]).collect()}
    rng.shuffle(events)
    got = {}
    for lo in (0, 50, 90):
        rocks.createDataFrame(events[lo : lo + 60], EVENTS).coalesce(1).write.mode("append").parquet(data)  # parts overlap: some events come twice
        for r in drain(keyed.label_stream(rocks.readStream.schema(EVENTS).parquet(data), ["b", "k"]), tmp_path / "check"):
            if r.kind == "label":
                got[r.k] = (r.label, r.label_source, r.created_at, r.updated_at)
    assert got == want


def test_a_key_is_forgotten_after_its_time(rocks, tmp_path):
    data, check = str(tmp_path / "in"), tmp_path / "check"
    add = lambda n: rocks.createDataFrame([("x", "a", "maybe", "agent", None, False, at(n), n, None)], EVENTS).coalesce(1).write.mode("append").parquet(data)
    run = lambda: drain(keyed.label_stream(rocks.readStream.schema(EVENTS).parquet(data), ["b", "k"], keep_ms=1), check, once=True)
    add(5)
    assert [r.created_at for r in run()] == [at(5)]
    add(3)
    assert [(r.created_at, r.updated_at) for r in run()] == [(at(3), at(3))]


def test_first_arrivals(rocks, tmp_path):
    schema, data, check = "k string, n int", str(tmp_path / "in"), tmp_path / "check"
    add = lambda rows: rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
    run = lambda: sorted(((r.k, r.n) for r in drain(keyed.first_arrivals(rocks.readStream.schema(schema).parquet(data), ["k"], ["n"]), check, "append")), key=repr)
    add([("a", 3), ("a", 1), ("b", None), ("b", 0), (None, 7), (None, 6)])
    assert run() == [("a", 1), ("b", None), (None, 6)]
    add([("a", 0), ("c", 2), (None, 1)])
    assert run() == [("c", 2)]
    assert rocks.read.parquet(data).where(F.col("k") == "a").count() == 3
