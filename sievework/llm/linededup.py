"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts of lines.

A line's key is the line without blanks (space, tab to carriage return) at both ends and with A-Z in lower case, known by
a 128-bit hash. ``LineIndex.counts`` is the exact table: how many documents hold each key. Each shard, a range of hashes,
has a cuckoo filter of its keys with at least ``at_least`` documents, the lines to drop. ``inserted`` adds documents'
counts and puts keys that reach the bound into their shard's filter; ``deleted`` takes counts back and removes the keys
that fall below it, which a cuckoo filter allows because the table says that they are in it. So an index from which
documents were deleted drops what one drops that never held them. A full filter is built anew from the table, and all
of them once the keys outgrow their shards.

``drop_lines`` asks the filters. They never miss a key; the few keys of the table that one takes for another are found
when it is built and stored beside it, so the answer is exact for documents in the index. Filters within a byte bound
are broadcast and texts never move. Beyond it, lines go to their shards, dealt over tasks by the table's counts, and
the places to drop come back to the texts.

Null and empty texts are one empty line. A line of blanks only has an empty key; keys of fewer than ``shortest`` code
points are never counted or dropped. A line that a document repeats counts once for it. Repeated rows are documents of
their own. Very long texts are read whole. Ties don't arise. An empty table gives an empty result. Columns other than
the two named are not read. Deleting documents that were never inserted raises an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_text, ship

AT_LEAST, SHORTEST = 10, 1
#: Keys in a shard beyond which there are more shards; fingerprints in a bucket; moves before a filter counts as full.
SHARD_KEYS, SLOTS, MOVES = 500_000, 4, 400
#: Keys that a task counts before it hands them on, bytes of filters that are broadcast, line keys in one task beyond it.
HELD, BROADCAST_BYTES, TASK_ROWS = 400_000, 64 << 20, 2_000_000
_BLANKS = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes | None) -> list[bytes]:
    """The key of each line of a UTF-8 text."""
    return [line.strip(_BLANKS) for line in (text or b"").lower().split(b"\n")]


def _long_enough(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (shortest <= 1 or len(key.decode("utf-8", "replace")) >= shortest)


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


# --- the filter -------------------------------------------------------------------------------------------------------


class CuckooFilter:
    """A set of 128-bit keys by 32-bit fingerprints in buckets of four; equal fingerprints are held as often as inserted."""

    def __init__(self, keys: int = 0, slots: bytes | None = None):
        buckets = 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (0.85 * SLOTS)))))
        self.slots = np.frombuffer(slots, np.uint32).copy() if slots else np.zeros(buckets * SLOTS, np.uint32)
        self.mask = np.uint64(len(self.slots) // SLOTS - 1)

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The fingerprint (never 0) and the two buckets of each key; either bucket follows from the other and the fingerprint."""
        print_ = np.maximum(lo & np.uint64(0xFFFFFFFF), np.uint64(1))
        first = hi & self.mask
        return print_, first, first ^ self._step(print_)

    def _step(self, print_):
        return ((print_ * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(31)) & self.mask

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(hi, lo)
        table = self.slots.reshape(-1, SLOTS)
        own = print_.astype(np.uint32)[:, None]
        return (table[first] == own).any(1) | (table[second] == own).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Adds the keys; False if there was no room, and the filter is then to be built anew."""
        slots, rng, mask = self.slots.tolist(), np.random.default_rng(1), int(self.mask)
        for print_, first, second in zip(*(x.tolist() for x in self._places(hi, lo))):
            at = first
            for move in range(MOVES):
                free = next((k for b in ((first, second) if move == 0 else (at,)) for k in range(b * SLOTS, b * SLOTS + SLOTS) if not slots[k]), None)
                if free is not None:
                    slots[free] = print_
                    break
                out = at * SLOTS + int(rng.integers(SLOTS))
                print_, slots[out] = slots[out], print_
                at ^= (((print_ * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 31) & mask
            else:
                return False
        self.slots = np.array(slots, np.uint32)
        return True

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Takes keys out that are known to be in."""
        for print_, first, second in zip(*(x.tolist() for x in self._places(hi, lo))):
            here = next(k for b in (first, second) for k in range(b * SLOTS, b * SLOTS + SLOTS) if self.slots[k] == print_)
            self.slots[here] = 0


# --- the index --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """counts: hi, lo (the key's hash), n (documents that hold it). filters: shard, slots, wrong (keys of the table that the filter takes for held)."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    at_least: int = AT_LEAST
    shortest: int = SHORTEST


def empty_index(spark: SparkSession, at_least: int = AT_LEAST, shortest: int = SHORTEST) -> LineIndex:
    return LineIndex(spark.createDataFrame([], "hi long, lo long, n long"), spark.createDataFrame([], "shard int, slots binary, wrong binary"), 0, at_least, shortest)


def _counted(shortest: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, held = xxhash.xxh3_128_digest, Counter()

        def out() -> pa.RecordBatch:
            halves = [pa.array(x.view(np.int64)) for x in _halves(b"".join(held))]
            return pa.RecordBatch.from_arrays([*halves, pa.array(list(held.values()), pa.int64())], names=["hi", "lo", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update({digest(k) for k in set(keys_of(text)) if _long_enough(k, shortest)})
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return step


def line_counts(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """hi, lo, n: in how many rows of docs each key stands. Tasks count before anything is shuffled, so a common line is one row of each."""
    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_text(texts, _counted(shortest), "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _shard(shards: int):
    bits = max(shards, 1).bit_length() - 1
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


def _refilter(at_least: int):
    """One shard's filter after its counts changed: crossings of the bound are inserted or removed; without room it is built anew."""

    def step(filters: pa.Table, counts: pa.Table) -> pa.Table:
        hi, lo = (counts.column(c).to_numpy().astype("<i8").view(np.uint64) for c in ("hi", "lo"))
        old, new = (counts.column(c).to_numpy() >= at_least for c in ("old", "n"))
        known, done = filters.num_rows and len(filters.column("slots")[0].as_py()), False
        if known:
            own = CuckooFilter(slots=filters.column("slots")[0].as_py())
            own.remove(hi[old & ~new], lo[old & ~new])
            done = new.sum() <= 0.9 * len(own.slots) and own.insert(hi[new & ~old], lo[new & ~old])
        room = int(new.sum())
        while not done:
            own = CuckooFilter(room)
            done = own.insert(hi[new], lo[new])
            room = max(2 * room, SLOTS)
        wrong = ~new & own.holds(hi, lo) & (counts.column("n").to_numpy() > 0)
        pairs = np.stack([hi[wrong], lo[wrong]], 1).astype("<u8").tobytes()
        shard = (counts if counts.num_rows else filters).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([own.slots.tobytes()], pa.binary()), "wrong": pa.array([pairs], pa.binary())})

    return step


def _updated(index: LineIndex, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
    more = line_counts(docs, text_col, index.shortest).select("hi", "lo", F.lit(0).cast("long").alias("old"), (sign * F.col("n")).alias("n"))
    both = more if not index.shards else index.counts.select("hi", "lo", F.col("n").alias("old"), "n").unionByName(more)
    seen = Observation()
    table = both.groupBy("hi", "lo").agg(F.sum("old").alias("old"), F.sum("n").alias("n"))
    table = cut(table.observe(seen, F.count(F.lit(1)).alias("keys"), F.coalesce(F.min("n"), F.lit(0)).alias("least")))
    if seen.get["least"] < 0:
        raise ValueError("documents that are not in the index can't be deleted from it")
    shards = max(index.shards, 1)
    while shards * SHARD_KEYS < seen.get["keys"]:
        shards *= 2
    # more shards have other ranges of keys, so their filters begin empty and take in all keys at or above the bound
    before = index.filters if shards == index.shards else index.filters.limit(0)
    rows = table.withColumn("shard", _shard(shards))
    filters = before.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(_refilter(index.at_least), "shard int, slots binary, wrong binary")
    return LineIndex(table.where("n > 0").select("hi", "lo", "n"), cut(filters), shards, index.at_least, index.shortest)


def inserted(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    """The index with the documents' lines added."""
    return _updated(index, docs, text_col, 1)


def deleted(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    """The index as if the documents had never been inserted."""
    return _updated(index, docs, text_col, -1)


# --- dropping ---------------------------------------------------------------------------------------------------------


class _Shards:
    """Filters of some shards, with the keys that each takes for held."""

    def __init__(self, shards: int):
        self.bits, self.own = max(shards, 1).bit_length() - 1, {}

    def add(self, shard: int, slots: bytes, wrong: bytes) -> None:
        self.own[shard] = (CuckooFilter(slots=slots), {wrong[k : k + 16] for k in range(0, len(wrong), 16)})

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        shard = (hi >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hi), np.int64)
        for s in np.unique(shard).tolist() if len(hi) else ():
            if s in self.own:
                filter_, wrong = self.own[s]
                at = np.flatnonzero(shard == s)
                at = at[filter_.holds(hi[at], lo[at])]
                if wrong:
                    pairs = np.stack([hi[at], lo[at]], 1).astype("<u8")
                    at = at[[p.tobytes() not in wrong for p in pairs]]
                out[at] = True
        return out


def _without(text: bytes, drop) -> bytes:
    """The text without the lines at the places of drop."""
    gone = set(drop)
    return b"\n".join(line for k, line in enumerate(text.split(b"\n")) if k not in gone)


def _keep(blob, shards: int, shortest: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own, digest = _Shards(shards), xxhash.xxh3_128_digest
        for shard, slots, wrong in blob.value:
            own.add(shard, slots, wrong)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            keys = [keys_of(t) for t in texts]
            ends = np.cumsum([len(k) for k in keys])
            every = [k for ks in keys for k in ks]
            hit = own.holds(*_halves(b"".join(map(digest, every)))) & np.array([_long_enough(k, shortest) for k in every], bool)
            kept, dropped = [], []
            for text, hits in zip(texts, np.split(hit, ends[:-1])):
                gone = np.flatnonzero(hits).tolist()
                kept.append(_without(text, gone) if gone else text)
                dropped.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array([len(k) for k in keys], pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "kept", "n_lines", "n_dropped"])

    return step


def _line_keys(shortest: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            marks, places, digests = [[], []], [], []
            for m0, m1, text in zip(*(c.to_pylist() for c in b.columns)):
                own: dict[bytes, list[int]] = {}
                for k, key in enumerate(keys_of(text)):
                    if _long_enough(key, shortest):
                        own.setdefault(key, []).append(k)
                marks[0] += [m0] * len(own)
                marks[1] += [m1] * len(own)
                places += own.values()
                digests += map(xxhash.xxh3_128_digest, own)
            halves = [pa.array(x.view(np.int64)) for x in _halves(b"".join(digests))]
            yield pa.RecordBatch.from_arrays([*(pa.array(m, pa.int64()) for m in marks), *halves, pa.array(places, pa.list_(pa.int32()))], names=["m0", "m1", "hi", "lo", "places"])

    return step


def _probe(shards: int):
    """Of rows sorted by shard, its filter first: the lines that the filter holds."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Shards(shards)
        for b in batches:
            slots = b.column("slots")
            for k in np.flatnonzero(np.asarray(slots.is_valid())).tolist():
                own.add(b.column("shard")[k].as_py(), slots[k].as_py(), b.column("wrong")[k].as_py())
            lines = b.filter(slots.is_null()).select(["m0", "m1", "hi", "lo", "places"])
            if lines.num_rows:
                hi, lo = (lines.column(c).to_numpy().astype("<i8").view(np.uint64) for c in ("hi", "lo"))
                yield lines.filter(pa.array(own.holds(hi, lo))).select(["m0", "m1", "places"])
                last = b.column("shard")[b.num_rows - 1].as_py()
                own.own = {s: f for s, f in own.own.items() if s >= last}

    return step


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, drops = [t or b"" for t in b.column(1).to_pylist()], [sorted(d or ()) for d in b.column(2).to_pylist()]
        columns = [pa.array([_without(t, d) if d else t for t, d in zip(texts, drops)], pa.binary()), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([len(d) for d in drops], pa.int64())]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "kept", "n_lines", "n_dropped"])


def _routed(rows: DataFrame, index: LineIndex) -> DataFrame:
    """Lines go to their shard's filter; the places to drop come back to the text by two hashes of id and text."""
    marks = {"m0": F.xxhash64("doc_id", "text"), "m1": F.xxhash64(F.lit(1), "text", "doc_id")}
    rows = rows.withColumns(marks)
    deals = index.counts.groupBy(_shard(index.shards).alias("shard")).agg(F.ceil(F.sum("n") / TASK_ROWS).cast("int").alias("deals"))
    filters = index.filters.join(deals, "shard").select("shard", "deals", "slots", "wrong")
    lines = map_text(rows.select("m0", "m1", "text").distinct(), _line_keys(index.shortest), "m0 long, m1 long, hi long, lo long, places array<int>").withColumn("shard", _shard(index.shards))
    dealt = lines.join(F.broadcast(deals) if index.shards <= 100_000 else deals, "shard").withColumn("deal", F.pmod("m0", F.col("deals").cast("long")).cast("int"))
    each = filters.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    both = dealt.drop("deals").unionByName(each.drop("deals"), allowMissingColumns=True).repartition("shard", "deal").sortWithinPartitions("shard", "deal", F.col("slots").isNull())
    held = map_text(both.select("shard", "m0", "m1", "hi", "lo", "places", "slots", "wrong"), _probe(index.shards), "m0 long, m1 long, places array<int>")
    drops = held.groupBy("m0", "m1").agg(F.flatten(F.collect_list("places")).alias("drop"))
    return map_text(rows.join(drops, ["m0", "m1"], "left").select("doc_id", "text", "drop"), _cut_out, "doc_id long, kept binary, n_lines long, n_dropped long")


def drop_lines(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, kept (the text without the dropped lines), n_lines, n_dropped for each document; the documents are to be in the index."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = index.filters.agg(F.coalesce(F.sum(F.octet_length("slots") + F.octet_length("wrong")), F.lit(0))).first()[0]
    if total > most_bytes:
        out = _routed(rows, index)
    else:
        ship(spark)
        blob = spark.sparkContext.broadcast([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in index.filters.select("shard", "slots", "wrong").collect()])
        out = map_text(rows, _keep(blob, index.shards, index.shortest), "doc_id long, kept binary, n_lines long, n_dropped long")
    return out.withColumn("kept", F.col("kept").cast("string"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: int = AT_LEAST, shortest: int = SHORTEST) -> DataFrame:
    """``drop_lines`` by an index of the documents themselves."""
    return drop_lines(inserted(empty_index(docs.sparkSession, at_least, shortest), docs, text_col), docs, id_col, text_col)
