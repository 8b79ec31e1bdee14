"""Incremental forms of the store's operators for Structured Streaming: each micro-batch is a set operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import append_new, fold_labels


def append_items(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Append to a Parquet table the rows whose key it lacks; a batch that runs again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            have = spark.read.schema(df.schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = spark.createDataFrame([], df.schema)
        append_new(have, df, keys, order).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_state(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The current label of each key over a stream of label events (complete or update mode)."""
    return fold_labels(stream, keys)


def run_status(stream: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The last status of each run."""
    return stream.groupBy(key).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))
