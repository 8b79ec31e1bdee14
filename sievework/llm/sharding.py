"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards.

Each shard's score for a key is -weight / ln(u), u being a hash of key and shard in (0, 1); the highest
score wins, the smaller shard on a tie. Only key, shard and weight decide, so one more shard takes rows
into itself and moves no others, and a changed weight moves rows to or from that shard alone.

A null key is replaced by a hash of the text. Null texts have no bytes and the check sum of an empty text.
Repeated rows and equal keys share a shard and get slots of their own. Very long texts count whole. An empty table gives an empty result.
Other columns than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

SHARDS = 8


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) shards; a weight of 0 takes a shard out."""
    best = None
    for s, w in enumerate(weights):
        if w <= 0:
            continue
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        here = F.struct((F.lit(-float(w)) / F.ln(unit)).alias("score"), F.lit(-s).alias("minus"))
        best = here if best is None else F.greatest(best, here)
    if best is None:
        raise ValueError("no shard has a weight")
    return (-best["minus"]).cast("int")


def shard(docs: DataFrame, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document; slots count each shard's rows from 0.

    Rows are numbered within each stored partition and shard, then moved up by the counts of the partitions
    before, so no shard passes through one task.
    """
    weights = weights or [1.0] * SHARDS
    bytes_ = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit("id"), F.col(id_col).cast("long"))).otherwise(F.xxhash64(F.lit("text"), F.col(text_col).cast("string")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), key.alias("key"))
    rows = rows.select("doc_id", "size", "text_crc32", rendezvous(F.col("key"), weights).alias("shard"), rendezvous(F.col("key"), [*weights, 1.0]).alias("grown_shard"))
    stored = cut(rows).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    counts = stored.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    numbered = stored.withColumn("own", F.row_number().over(W.partitionBy("shard", "part").orderBy("at")) - 1)
    return numbered.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"), "grown_shard")
