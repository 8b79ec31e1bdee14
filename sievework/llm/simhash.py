"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a generalised pigeonhole search.

The bits are grouped into partitions (correlated bits together), and each partition gets its own threshold
t so that the thresholds sum to limit - partitions + 1: two fingerprints within ``limit`` bits then agree
within t on some partition. A dynamic program over estimated candidate counts allots the thresholds; the
estimates come from the bit and bit-pair counts of all fingerprints. Every fingerprint is indexed under
each partition's value and probes all values within that partition's threshold; candidates are verified.

Buckets that hold too many fingerprints are split by further pigeonholes over more and more bits, so no
task compares an unbounded group. A task emits a spanning forest of the links it found,
not all pairs. Components of the forests are found by rounds of star contraction.

Null and empty texts have fingerprint zero and link like any other. Repeated rows keep one row each. A null
doc_id never names a component unless it stands alone (component_id is then null). An empty table gives an
empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, stored

BITS, LIMIT, SHINGLE = 64, 3, 3
#: Fingerprints in one bucket beyond which it is split by its remaining bits.
BUCKET = 2048
#: Cost of writing, sorting and reading one probe, in units of one verified candidate.
PROBE_COST = 20.0
#: Edges that one task joins to components; more go through rounds of star contraction.
ONE_TASK = 500_000


def split_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; fewer words than k are one shingle, none none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), seed)] if words else [], np.uint64)
    return np.fromiter((digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(k))))), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as an unsigned number."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):
            ones += bits[lo : lo + 255].sum(0, dtype=np.uint8)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, as an unsigned number; zero without words."""
    return majority(shingle_hashes(split_words(text), words_in_shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns in ``also``, one row for each document."""
    schema = f"doc_id long, fp long{''.join(f', {c} {docs.schema[c].dataType.simpleString()}' for c in also)}"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words_in_shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *also])

    return map_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also), step, schema)


# --- the plan: partitions of bits and their thresholds ---------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both of each two bits; 4,096 counts whatever the input."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for lo in range(0, len(x), 1 << 16):
                bits = np.unpackbits(x[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                both += bits.T @ bits
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BITS * BITS), -1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = {r.cell: r.n for r in fps.select("fp").mapInArrow(step, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return int(cells.pop(-1, 0)), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def _agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance that two rows agree in a bit, and in two bits at once."""
    one = np.diag(both) / max(n, 1)
    p11 = both / max(n, 1)
    p10 = one[:, None] - p11
    p01 = one[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return one**2 + (1 - one) ** 2, p11**2 + p10**2 + p01**2 + p00**2


def allot(n: int, both: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition with the least estimated cost; partitions that need no probe are left out."""
    single, pair = _agreement(n, both)
    tie = pair / np.maximum(np.outer(single, single), 1e-9)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, limit + 2):
        left, parts = set(range(BITS)), []
        for k in range(m):  # greedily: the bits most correlated with what the partition holds
            size = len(left) // (m - k)
            own = [min(left)]
            left.discard(own[0])
            while len(own) < size:
                b = max(sorted(left), key=lambda x: max(tie[x, y] for y in own))
                own.append(b)
                left.discard(b)
            parts.append(own)
        costs = []
        for own in parts:
            agree = single[own[0]]
            for a, b in zip(own, own[1:]):
                agree *= pair[a, b] / max(single[a], 1e-9)
            odds = [(1 - single[b]) / max(single[b], 1e-9) for b in own]
            costs.append([0.0] + [n * n * max(agree, 1e-19) * (1 + sum(odds) * (t > 0)) + PROBE_COST * n * (1 + (1 + len(own)) * (t > 0)) for t in range(2)])
        need, table = limit - m + 1, {0: (0.0, [])}  # thresholds of -1, 0 and 1 are written 0, 1 and 2; so they sum to need + m
        for c in costs:
            nxt: dict[int, tuple[float, list]] = {}
            for total, (cost, chosen) in table.items():
                for t in range(3):
                    cand = (cost + c[t], [*chosen, t - 1])
                    if total + t not in nxt or cand[0] < nxt[total + t][0]:
                        nxt[total + t] = cand
            table = nxt
        if need + m in table and table[need + m][0] < best[0]:
            best = (table[need + m][0], [(own, t) for own, t in zip(parts, table[need + m][1]) if t >= 0])
    return best[1]


def _gather(bits: list[int]):
    """The value of the bits of a fingerprint column, as a long."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), i) for i, b in enumerate(bits)])


def keyed(fps: DataFrame, plan: list[tuple[list[int], int]], also: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """fp, the columns in ``also``, probe, bucket: every fingerprint under its partition's value, and as a probe under those within its threshold."""
    entries = []
    for k, (bits, t) in enumerate(plan, first):
        own = _gather(bits)
        entries.append(F.array(F.struct(F.lit(k).alias("part"), own.alias("value"), F.lit(False).alias("probe"))))
        if t:
            entries.append(F.array(*[F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(1 << i).cast("long")).alias("value"), F.lit(True).alias("probe")) for i in range(len(bits))]))
    return fps.select("fp", *also, F.explode(F.concat(*entries)).alias("e")).select("fp", *also, F.col("e.probe").alias("probe"), F.xxhash64("e.part", "e.value").alias("bucket"))


def _forest(limit: int):
    """Of buckets, sorted by their key: a spanning forest of the links within the task's buckets."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        def links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> None:
            at = np.arange(len(key) - 1)
            lag = 1
            while len(at):
                at = at[at + lag < len(key)]
                at = at[key[at] == key[at + lag]]
                near = at[(np.bitwise_count(fp[at] ^ fp[at + lag]) <= limit) & ~(probe[at] & probe[at + lag])]
                for a, b in zip(fp[near].tolist(), fp[near + lag].tolist()):
                    if (x := root(a)) != (y := root(b)):
                        parent[max(x, y)] = min(x, y)
                lag += 1

        rest: list[np.ndarray] | None = None
        for b in batches:
            new = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
            new = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            ready = int(np.searchsorted(new[0], new[0][-1])) if len(new[0]) else 0
            links(*(x[:ready] for x in new))
            rest = [x[ready:] for x in new]
        if rest is not None:
            links(*rest)
        pairs = [(x, root(x)) for x in list(parent) if root(x) != x]
        if pairs:
            both = np.array(pairs, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])

    return step


def _blocks(fps: DataFrame, d: int, limit: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Every fingerprint under each choice of d - limit out of d blocks of bits: a pair within the limit agrees on one of them."""
    cuts = [x.tolist() for x in np.array_split(np.arange(BITS), d)]
    chosen = [[b for i in c for b in cuts[i]] for c in combinations(range(d), d - limit)]
    masks = [sum(1 << b for b in bits) for bits in chosen]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    key = F.explode(F.transform(F.array(*[F.lit(x) for x in signed]), lambda mask: F.xxhash64(mask, F.col("fp").bitwiseAND(mask), *also[:1])))
    return fps.select("fp", *also, F.lit(False).alias("probe"), key.alias("bucket"))


def links(fps: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect exactly what links of ``limit`` or fewer bits connect. fps: distinct fingerprints in column fp.

    Fingerprints that share a bucket of more than ``bucket`` are keyed anew, under more and more bits. The last
    keys leave so few bits open that no bucket can hold more than a few thousand distinct fingerprints.
    """
    rows, found = keyed(fps, allot(*bit_statistics(fps), limit)), []
    for d in (6, 8, 12, 16):
        large = cut(rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket"))
        if large.isEmpty():
            break
        found.append(rows.join(large, "bucket", "left_anti"))
        rows = _blocks(cut(rows.join(large, "bucket", "left_semi").select("fp").distinct()), d, limit)
    every = reduce(DataFrame.unionByName, [*found, rows])
    return every.select("bucket", "fp", "probe").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forest(limit), "a long, b long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges in the task, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
    pairs = np.array([(x, r) for x in list(parent) if (r := root(x)) != x], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the least node) for every node with an edge but the roots: one task joins up to ``one_task`` edges, else star contraction does.

    Alternating large-star and small-star rounds run until no edge changes.
    """
    edges, n = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if n <= one_task:
        return map_text(edges.coalesce(1), _joined, "node long, root long")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = cut(small)
        if new.count() == edges.count() and new.exceptAll(edges).isEmpty():
            break
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE, limit: int = LIMIT, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), class (a fingerprint that names the component) and ``also``, one row for each document."""
    rows = cut(fingerprints(docs, id_col, text_col, words_in_shingle, also))
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(own.select("fp"), limit))
    classes = own.join(roots, own.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("class"))
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "class").select("fp", "class", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class", *also)
