"""Streams of label events and run states in update mode, stopped and started again from their checkpoint."""

from sievework.streaming import incremental


def drain(df, checkpoint):
    """The rows that a run over all input not yet read puts out."""
    rows = []
    query = df.writeStream.outputMode("update").foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows


def test_label_state_keeps_the_human_label_over_a_restart(spark, tmp_path):
    schema, data, check = "k string, label string, label_source string, at int, ordinal int", str(tmp_path / "in"), tmp_path / "check"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
    run = lambda: {r.k: (r.label, r.label_source, r.created_at, r.updated_at, r.n_events) for r in drain(incremental.label_state(spark.readStream.schema(schema).parquet(data), ["k"]), check)}
    add([("a", "relevant", "human", 1, 1), ("b", "maybe", "agent", 1, 2), (None, "maybe", "agent", 1, 3)])
    assert run() == {"a": ("relevant", "human", 1, 1, 1), "b": ("maybe", "agent", 1, 1, 1), None: ("maybe", "agent", 1, 1, 1)}
    add([("a", "irrelevant", "agent", 5, 4), ("b", "relevant", "agent", 5, 5)])
    assert run() == {"a": ("relevant", "human", 1, 1, 2), "b": ("relevant", "agent", 1, 5, 2)}
    add([("b", "irrelevant", "human", 6, 6), ("b", "maybe", "human", 6, 7)])
    assert run() == {"b": ("maybe", "human", 1, 6, 4)}
    assert run() == {}


def test_run_status_is_the_last_over_a_restart(spark, tmp_path):
    schema, data, check = "run string, status string, at int", str(tmp_path / "in"), tmp_path / "check"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(data)
    run = lambda: {r.run: (r.status, r.at) for r in drain(incremental.run_status(spark.readStream.schema(schema).parquet(data), "run", "status", "at"), check)}
    add([("r", "running", 2), ("r", "created", 1), ("s", "created", 1)])
    assert run() == {"r": ("running", 2), "s": ("created", 1)}
    add([("r", "created", 1), ("s", "done", 9)])
    assert run() == {"r": ("running", 2), "s": ("done", 9)}
