"""Importance resampling towards a target corpus, by inverted postings that are partitioned by bucket.

Features are runs of one and of two consecutive words, hashed into buckets. Each corpus is indexed as postings: a row for
each bucket and slice of documents holds the slice's documents with that bucket and their counts. Postings are shuffled
by bucket. What both corpora hold of a bucket is grouped together and gives its gain, the logarithm of how much likelier
the target has it; a bucket's task multiplies gain and counts and emits what it adds to each document. These
contributions are summed by document. A common bucket's postings are dealt over many tasks by slice; each has the
bucket's gain beside it, so no task holds all of a bucket.

The draw is without replacement: a document's mean gain plus Gumbel noise from a hash of its id, highest first. Ranks come
from sorted ranges and their counts, so no task sorts all documents.

Null and empty texts have no features and weight 0, and with fewer than ``least_words`` words are never drawn. Repeated
rows are documents of their own; ties go to the smaller doc_id, null last, then to the earlier place in storage. The
noise of a null doc_id is that of an empty id. Very long texts are read whole, as slices of their own. Empty documents give
an empty result; an empty target gives gains that favour rare features. Columns other than the two named are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, cut, map_text, shared_folder

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Bytes of one bucket's postings in a task, and slices whose sums a task holds before it hands them on.
DEAL_BYTES, HELD = 32 << 20, 4096
#: Words are what stands between ASCII characters other than digits and letters.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_POSTINGS = "slice long, size int, bucket int, n long, places binary, counts binary, ids array<long>, words array<long>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def feature_buckets(words: list[bytes], buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """The bucket of each run of 1 to ``run`` words, repeats included."""
    crc, sums, out = zlib.crc32, list(map(zlib.crc32, words)), []
    spaced = [b" " + w for w in words]
    for k in range(1, run + 1):
        out.append(np.array(sums, np.uint32))
        sums = list(map(crc, spaced[k:], sums))  # a run's checksum goes on from that of its beginning
    return (np.concatenate(out) % np.uint32(buckets)).astype(np.int64)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings: values cut at ends."""
    offsets = np.r_[0, ends].astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _index(buckets: int, run: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for b in batches:
            own, words = [], []
            for text in b.column(1).to_pylist():
                ws = words_of(text)
                words.append(len(ws))
                own.append(feature_buckets(ws, buckets, run))
            size, slice_ = len(own), first + made
            made += 1
            place = np.repeat(np.arange(size), [len(x) for x in own])
            code, count = np.unique(np.concatenate(own) * TEXT_ROWS + place, return_counts=True) if size else (np.zeros(0, np.int64),) * 2
            bucket = code // TEXT_ROWS
            ends = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)][: len(bucket)] if len(bucket) else np.zeros(0, np.int64)
            width = np.uint8 if not len(count) or count.max() < 256 else np.uint32
            rows = len(ends)
            sums = np.add.reduceat(count, np.r_[0, ends[:-1]]) if rows else np.zeros(0, np.int64)
            nulls = pa.nulls(rows, pa.list_(pa.int64()))
            posts = [pa.array(np.full(rows, slice_, np.int64)), pa.array(np.full(rows, size, np.int32)), pa.array(bucket[ends - 1].astype(np.int32)), pa.array(sums.astype(np.int64)), _binary((code % TEXT_ROWS).astype("<u2"), ends), _binary(count.astype(width), ends), nulls, nulls]
            names = ["slice", "size", "bucket", "n", "places", "counts", "ids", "words"]
            yield pa.RecordBatch.from_arrays(posts, names=names)
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (b.column(0).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int64()), pa.array([size], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *lists], names=names)

    return step


@dataclass(frozen=True)
class Postings:
    """posts: slice, size (its documents), bucket, n (its features here), places (16 bits each), counts (equally many). heads: slice, ids, words."""

    posts: DataFrame
    heads: DataFrame


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> Postings:
    """The inverted postings of a corpus, in a Parquet folder in the shared folder: a slice's number holds whatever is read again."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    map_text(rows, _index(buckets, run), _POSTINGS).write.parquet(folder)
    table = spark.read.schema(_POSTINGS).parquet(folder)
    return Postings(table.where("bucket >= 0").drop("ids", "words"), table.where("bucket = -1").select("slice", "ids", "words"))


def gains(source: Postings, target: Postings, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for each bucket of the source, from what both corpora hold of it; and bytes, those of its postings."""
    one = source.posts.select("bucket", "n", F.lit(0).cast("long").alias("t"), (F.octet_length("places") + F.octet_length("counts")).cast("long").alias("b"))
    both = one.unionByName(target.posts.select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("t"), F.lit(0).cast("long").alias("b")))
    sums = cut(both.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("t").alias("t"), F.sum("b").alias("bytes")))
    s, t = sums.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    odds = (F.col("t") + 1).cast("double") * F.lit(float(s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(t + buckets)))
    return sums.where("s > 0").select("bucket", F.floor(1000 * F.ln(odds)).cast("long").alias("gain"), "bytes")


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's buckets add to each document of a slice."""
    held: dict[int, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        places = [np.flatnonzero(v) for v in held.values()]
        columns = [pa.array(list(held), pa.int64()), pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()), pa.array([v[p].astype("<i8").tobytes() for p, v in zip(places, held.values())], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "places", "sums"])

    for b in batches:
        for slice_, size, gain, places, counts in zip(*(c.to_pylist() for c in b.columns)):
            if slice_ not in held:
                if len(held) >= HELD:
                    yield out()
                    held.clear()
                held[slice_] = np.zeros(size, np.int64)
            at = np.frombuffer(places, "<u2")
            held[slice_][at] += gain * np.frombuffer(counts, np.uint8 if len(counts) == len(at) else np.uint32).astype(np.int64)
    if held:
        yield out()


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by slice, its head first: each document with its sum."""
    head: list = []

    def out() -> pa.RecordBatch:
        slice_, ids, words, total = head
        return pa.RecordBatch.from_arrays([pa.array([slice_] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(total)], names=["slice", "place", "doc_id", "n_words", "total"])

    for b in batches:
        for slice_, ids, words, places, sums in zip(*(c.to_pylist() for c in b.columns)):
            if ids is not None:
                if head:
                    yield out()
                head = [slice_, ids, words, np.zeros(len(ids), np.int64)]
            else:
                head[3][np.frombuffer(places, "<u2")] += np.frombuffer(sums, "<i8")
    if head:
        yield out()


def document_gains(source: Postings, target: Postings, buckets: int = BUCKETS) -> DataFrame:
    """slice, place, doc_id, n_words, total (the sum of its features' gains) for each document of the source."""
    each = cut(gains(source, target, buckets))
    deals = 1 + (each.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0] // DEAL_BYTES)
    # every bucket is dealt by slice into equally many parts, beside a copy of its gain
    dealt = source.posts.withColumn("deal", F.pmod(F.xxhash64("slice"), F.lit(deals)).cast("int")).select("bucket", "deal", "slice", "size", "places", "counts")
    beside = each.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(deals - 1).cast("int"))).alias("deal"), "gain")
    met = dealt.hint("merge").join(beside, ["bucket", "deal"]).select("slice", "size", "gain", "places", "counts")
    parts = map_text(met, _contributions, "slice long, places binary, sums binary")
    both = parts.unionByName(source.heads, allowMissingColumns=True).select("slice", "ids", "words", "places", "sums")
    ordered = both.repartition("slice").sortWithinPartitions("slice", F.col("ids").isNull())
    return map_text(ordered, _reduced, "slice long, place int, doc_id long, n_words long, total long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        numbers = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n + 1, n + 1 + b.num_rows))]
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, *numbers], names=[*b.schema.names, "part", "k"])


def ranked(rows: DataFrame, order: list, schema: str) -> DataFrame:
    """rows with rank, their place in ``order`` from 1: sorted ranges are numbered each and moved up by the ranges before."""
    parts = cut(map_text(rows.repartitionByRange(*order).sortWithinPartitions(*order), _numbered, f"{schema}, part int, k long"))
    before, sums = 0, []
    for part, n in sorted((r.part, r.n) for r in parts.groupBy("part").agg(F.max("k").alias("n")).collect()):  # a row a range
        sums.append((part, before))
        before += n
    moved = parts.sparkSession.createDataFrame(sums, "part int, before long")
    return parts.join(F.broadcast(moved), "part").withColumn("rank", F.col("k") + F.col("before")).drop("part", "k", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) for each document; ``percent`` of those with enough words are drawn."""
    no_id = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text"))
    own = document_gains(postings(docs, id_col, text_col, buckets, run), postings(no_id, "id", "text", buckets, run), buckets)
    n = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, run)), F.col("n_words"))
    rows = own.withColumn("n_features", n.cast("long"))
    rows = rows.withColumn("weight", F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long")).select("doc_id", "n_features", "weight", "score", "n_words", "slice", "place")
    columns = "doc_id long, n_features long, weight long, score long, n_words long, slice long, place int"
    # those with too few words come last and are not counted
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "slice", "place"]
    placed = ranked(rows, order, columns)
    drawn = percent * placed.agg(F.count(F.when(F.col("n_words") >= least_words, 1))).first()[0] // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
