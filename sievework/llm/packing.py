"""Best-fit packing of documents into sequences of a fixed length, by hierarchical residual packing.

Each task cuts its own documents into pieces and packs them best-fit, longest first. Bins that are nearly
full are final. The others become items, carrying where their own parts lie, and go through rounds of a
merge tree: groups of a round pack the items best-fit again, emit what became nearly full and pass on the
rest. Only descriptions of bins are shuffled, never texts or ids.

Null and empty texts: one piece that holds the end id alone. Repeated rows and equal doc_ids are packed
each for itself. An empty table gives an empty result. Other columns than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import default_path, word_ids
from .common import cut, map_text

SEQUENCE = 2048
END_ID = 0
#: A bin with no more than this share of its length free is final.
NEARLY_FULL = 0.99
#: Pieces that one task packs at once, and items in one group of a round.
BLOCK, GROUP, FAN_IN = 200_000, 50_000, 8
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of each item, and each bin's fill. Open bins are found by a bit set of free lengths."""
    bins, fill = [0] * len(lengths), []
    open_bins: dict[int, list[int]] = defaultdict(list)
    free = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i] = b
        fill[b] += n
        if room > n:
            open_bins[room - n].append(b)
            free |= 1 << (room - n)
    return bins, fill


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def _tokenize_and_pack(path: str, capacity: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, base, used = word_ids(path), TaskContext.get().partitionId() << 36, 0
        cols: list[list] = [[] for _ in range(5)]

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal cols, used
            bins, fill = best_fit(cols[3], capacity)
            at, offset = [0] * len(fill), []
            for b, n in zip(bins, cols[3]):
                offset.append(at[b])
                at[b] += n
            arrays = [*cols, [base + used + b for b in bins], offset, [fill[b] for b in bins]]
            used += len(fill)
            table = pa.table([pa.array(a, f.type) for a, f in zip(arrays, _PIECES)], schema=_PIECES)
            cols = [[] for _ in range(5)]
            yield from table.to_batches(max_chunksize=20_000)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(words.encode(text) + END_ID.to_bytes(4, "little"))
                for k, (start, n) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    for c, v in zip(cols, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))):
                        c.append(v)
            if len(cols[0]) >= BLOCK:
                yield from packed()
        yield from packed()

    return step


def _merge_group(capacity: int):
    def step(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin").reset_index(drop=True)
        bins, fill = best_fit(pdf["fill"].tolist(), capacity)
        at: list[int] = [0] * len(fill)
        parts: list[list] = [[] for _ in fill]
        name: list[int] = [0] * len(fill)
        for b, own, n, members in zip(bins, pdf["bin"], pdf["fill"], pdf["members"]):
            name[b] = name[b] if parts[b] else own
            parts[b] += [{"bin": m["bin"], "shift": m["shift"] + at[b]} for m in members]
            at[b] += n
        return pd.DataFrame({"bin": name, "fill": fill, "members": parts}, columns=["bin", "fill", "members"])

    return step


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, tokenizer: str | None = None, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(map_text(narrow, _tokenize_and_pack(tokenizer or default_path(), capacity), _DDL))
    full = int(capacity * nearly_full)
    items = pieces.where(f"offset = 0 and fill < {full}").select("bin", "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"))
    done, groups = [], max(1, pieces.rdd.getNumPartitions())
    while True:
        items = cut(items)
        n = items.count()
        if n == 0:
            break
        groups = max(-(-groups // FAN_IN), -(-n // GROUP))
        merged = cut(items.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups))).groupBy("g").applyInPandas(_merge_group(capacity), items.schema))
        last = groups == 1 or merged.count() > 0.98 * n and groups == -(-n // GROUP)
        done.append(merged if last else merged.where(f"fill >= {full}"))
        if last:
            break
        items = merged.where(f"fill < {full}")
    out = pieces.where(f"fill >= {full}").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    for moved in done:
        where = moved.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.shift").alias("shift"))
        out = out.unionByName(pieces.where(f"fill < {full}").join(where, "bin").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("offset") + F.col("shift")).alias("offset")))
    return out
