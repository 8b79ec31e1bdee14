"""Groups of near-duplicate texts: SimHash links and minima of shingle hashes find the candidates, five-word shingles decide.

Two texts are one group if their sets of shingles have a Jaccard similarity of at least ``least``, which is verified
exactly for every candidate. Candidates come from two searches, the second for what the first can't reach:

- the operator of ``simhash.py``: fingerprints over the same shingles, linked at ``simhash.LIMIT`` bits by the
  generalised pigeonhole search. Two texts alike at 0.8 differ in about ten of 64 bits, so this finds the nearest
  copies only, and few partitions of bits could be equal at that distance without every text meeting every other;
- minima: the least hash under ``BANDS`` * ``ROWS`` permutations. Two texts are candidates if all minima of a band are
  equal and enough of ``WIDE`` bytes of minima agree. Of pairs at a similarity of exactly 0.8 about 7 in 100,000 are
  not, of nearer pairs fewer, whatever was added, cut off or edited.

Of the texts of a band's bucket only pairs in different groups are verified, and all of those are, in two rounds:
the SimHash links, each crowded bucket's texts with the one most like the bucket's commonest minima, and those of
all buckets with their 4 such texts; then, these groups being joined, all pairs left. No candidate is passed over, so groups are those of all candidates' links; where no text of a crowd is alike, that takes all its
candidate pairs. Crowded buckets are cut into parts and each two parts meet in a task, so no task holds a whole crowd.
Texts of one sequence of lower-case words are one text (by a 64-bit hash).

Null and empty texts are equal to each other. Texts of fewer than five words have one shingle, the whole; very long
texts count whole. Repeated rows and equal doc_ids stay apart by the hash of all their columns; of wholly equal rows
one is kept (columns of maps are compared as their text). An empty table gives an empty result. Other columns are
passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, map_text, plain_names, small_side, stored, tidy
from .simhash import components, shingle_hashes
from .simhash import split_words as _split

#: Bands of a signature and minima in a band; a pair alike at J agrees on a band with 1 - (1 - J**ROWS)**BANDS.
BANDS, ROWS = 20, 4
#: Minima of which a signature keeps one byte; candidates agree in as many as a pair alike at ``least`` but for this many deviations.
WIDE, DEVIATIONS = 512, 4.0
#: Words in a shingle, and the least similarity of near duplicates.
SHINGLE, LEAST = 5, 0.8
#: Texts in one bucket beyond which it is cut into parts; texts of each bucket that meet the others in the first round.
CROWD, PIVOTS = 1024, 4
#: Links of one text that are verified in one task, and a crowded bucket's texts whose commonest minima are taken.
LINKS, SAMPLE = 256, 256
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, WIDE), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles, in 32 bits; fewer words than k are one shingle, none none.

    Of two texts of 10,000 shingles each that share none, 0.02 are taken for shared on average.
    """
    return np.unique(shingle_hashes(words, k).astype(np.uint32))


def agreeing(least: float) -> float:
    """Of ``WIDE`` bytes, how many agree in a pair alike at ``least`` at the least."""
    return WIDE * least - DEVIATIONS * (WIDE * least * (1 - least)) ** 0.5


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signature(own: np.ndarray) -> np.ndarray:
    """The least hash of a set of shingles under each permutation."""
    low = np.full(WIDE, np.iinfo(np.uint64).max)
    for lo in range(0, len(own), 256):
        low = np.minimum(low, ((own[lo : lo + 256] ^ _MIX[0][:, None]) * _MIX[1][:, None]).min(1))
    return low


def _signatures(k: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, fps, bands, sigs = [], [], [], []
            for text in b.column(0).to_pylist():
                words = _split(text)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                hashes = shingle_hashes(words, k)
                fps.append(simhash.majority(hashes))
                low = signature(np.unique(hashes))
                bands.append(np.array([xxhash.xxh3_64_intdigest(x.tobytes(), band) for band, x in enumerate(low[: BANDS * ROWS].reshape(BANDS, ROWS))], np.uint64).view(np.int64))
                sigs.append((low >> np.uint64(20)).astype(np.uint8).tobytes())
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([*signed, pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), *b.columns[1:]], names=["node", "fp", "bands", "sig", *b.schema.names[1:]])

    return step


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE)


def _middle(sigs: np.ndarray) -> np.ndarray:
    """The commonest byte at each place of signatures."""
    return np.array([np.bincount(c).argmax() for c in sigs.T], np.uint8)


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_middle(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WIDE)).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["bucket", "other"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, signatures, give way to the number of bytes in which they agree."""
    for b in batches:
        same = (_bytes(b.column(b.num_columns - 2)) == _bytes(b.column(b.num_columns - 1))).sum(1)
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(same.astype(np.int32))], names=[*b.schema.names[:-2], "same"])


def _meet(most: int | None, close: float):
    """Of cells sorted by their key: the candidates in different groups, each cell's ``most`` middle texts with all others."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key: np.ndarray, bucket: np.ndarray, node: np.ndarray, group: np.ndarray, part: np.ndarray, mixed: np.ndarray, bands: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            rank = np.arange(len(key)) - np.repeat(starts, sizes)
            at, lag = np.arange(len(key)), 1
            if most is not None:
                order = at.copy()
                for lo, n in zip(starts[sizes > most + 1].tolist(), sizes[sizes > most + 1].tolist()):
                    own = sig[lo : lo + n]
                    order[lo : lo + n] = lo + np.argsort(-(own == _middle(own)).sum(1), kind="stable")
                node, group, part, mixed, bands, sig = (x[order] for x in (node, group, part, mixed, bands, sig))
                at = at[rank < most]
            while len(at):
                at = at[at + lag < len(key)]
                at = at[key[at] == key[at + lag]]
                near = at[(group[at] != group[at + lag]) & (~mixed[at] | (part[at] != part[at + lag]))]
                shared = (bands[near] == bands[near + lag]).argmax(1)
                near = near[bands[near, shared] == bucket[near]]  # a pair meets in the first band that it shares
                near = near[(sig[near] == sig[near + lag]).sum(1) >= close]
                if len(near):
                    a, b = node[near], node[near + lag]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                lag += 1

        rest: list[np.ndarray] | None = None
        for batch in batches:
            new = [*[c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]], batch.columns[-2].flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS), _bytes(batch.columns[-1])]
            new = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
            ready = int(np.searchsorted(new[0], new[0][-1])) if len(new[0]) else 0
            if ready:
                yield from pairs(*(x[:ready] for x in new))
            rest = [x[ready:] for x in new]
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    return step


def _cells(rows: DataFrame, sigs: DataFrame, most: int | None, close: float, crowd: int) -> DataFrame:
    """a, b (a < b): candidates of the buckets in ``rows``, each in the first bucket that it shares. A crowded bucket's parts meet two by two.

    That bucket is among ``rows`` as long as the pair is in two groups, or has met in all pairs before.
    """
    rows = rows.join(sigs, "node")
    parts = F.when(F.col("n") > crowd, F.ceil(2 * F.col("n") / crowd)).otherwise(1).cast("int")
    cells = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = cells.select("bucket", "node", "group", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "bands", "sig")
    key = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    cells = cells.select(key.alias("key"), "bucket", "node", "group", "part", (F.col("part") != F.col("other")).alias("mixed"), "bands", "sig")
    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(most, close), "a long, b long")


def _stars(rows: DataFrame, sigs: DataFrame, close: float) -> DataFrame:
    """a, b (a < b): of each bucket in ``rows``, the candidates of the text most like the commonest bytes of a sample's signatures."""
    rows = rows.join(sigs.drop("bands"), "node")
    some = rows.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SAMPLE)) == 0)
    middles = map_text(some.groupBy("bucket").agg(F.collect_list("sig")), _middles, "bucket long, other binary")
    like = map_text(rows.join(small_side(middles), "bucket").select("bucket", "node", "sig", "other"), _agreement, "bucket long, node long, same int")
    best = like.groupBy("bucket").agg(F.max(F.struct("same", "node")).alias("m")).select("bucket", "m.node")
    pivots = rows.join(small_side(best), ["bucket", "node"]).select("bucket", F.col("node").alias("pivot"), F.col("group").alias("own"), F.col("sig").alias("other"))
    met = rows.join(small_side(pivots), "bucket").where(F.col("group") != F.col("own"))
    near = map_text(met.select("pivot", "node", "sig", "other"), _agreement, "pivot long, node long, same int").where(F.col("same") >= close)
    return near.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))


def _shingle_sets(k: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([shingles(_split(t), k).tobytes() for t in b.column(0).to_pylist()], pa.binary())], names=["node", "own"])

    return step


def _alike(least: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[np.frombuffer(x, np.uint32) for x in b.column(k).to_pylist()] for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array([similarity(x, y) >= least for x, y in zip(*sets)], pa.bool_()))

    return step


def _with_sets(edges: DataFrame, own: DataFrame, end: str, name: str) -> DataFrame:
    """edges with the shingles of the text at one end; a text of many links is dealt over tasks of ``LINKS`` links."""
    copies = edges.groupBy(F.col(end).alias("node")).agg(F.ceil(F.count("*") / LINKS).cast("int").alias("copies"))
    dealt = edges.join(small_side(copies.where("copies > 1")).withColumnRenamed("node", end), end, "left")
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    each = own.join(copies, "node").select(F.col("node").alias(end), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("deal"), F.col("own").alias(name))
    return dealt.join(each, [end, "deal"]).drop("deal")


def verified(edges: DataFrame, own: DataFrame, least: float = LEAST) -> DataFrame:
    """The edges whose two texts are alike by their shingles. own: node and own, its shingles."""
    both = _with_sets(_with_sets(edges, own, "a", "x"), own, "b", "y")
    return map_text(both.select("a", "b", "x", "y"), _alike(least), "a long, b long")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b (a < b): texts whose fingerprints the pigeonhole search links, or are equal; one text stands for a fingerprint."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    linked = simhash.links(first.select("fp"))
    ends = linked.join(first.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    equal = nodes.select("fp", F.col("node").alias("y")).join(first.where("n > 1").select("fp", F.col("node").alias("x")), "fp").where("x <> y").select("x", "y")
    return ends.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(nodes: DataFrame, shingle_sets, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """node, root of every node alike with another. nodes: distinct node, fp, bands, sig; shingle_sets(nodes): their shingles, as ``verified`` reads them."""
    spark, close = nodes.sparkSession, agreeing(least)
    near, _ = stored(_simhash_pairs(nodes))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    rows = rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    rows, _ = stored(rows.withColumn("group", F.col("node")))
    sigs = nodes.select("node", "bands", "sig")
    own = shingle_sets(rows.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
    first, crowded = near.unionByName(_cells(rows, sigs, PIVOTS, close, crowd)), rows.where(F.col("n") > crowd)
    if not crowded.isEmpty():
        first = first.unionByName(_stars(crowded, sigs, close))
    tested, _ = stored(first.distinct())
    alike, _ = stored(verified(tested, own, least))
    roots, _ = stored(components(alike))
    tidy(spark)
    named = rows.drop("group").join(roots.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    apart = named.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("bucket")
    # buckets of PIVOTS + 1 texts or fewer have met in all pairs
    rows, left = stored(named.where(F.col("n") > min(PIVOTS + 1, crowd)).join(apart, "bucket"))
    if not left:
        return roots
    edges, _ = stored(_cells(rows, sigs, None, close, crowd).distinct().join(tested, ["a", "b"], "left_anti"))
    more, found = stored(verified(edges, own, least))
    tidy(spark)
    return components(alike.unionByName(more)) if found else roots


def _hashable(field) -> Column:
    """The column, or its text where a map in it can't be hashed."""
    column = F.col(f"`{field.name}`")
    return column.cast("string") if "map<" in field.dataType.simpleString() else column


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """The documents with one of each near-duplicate group: that of the smallest id (null last), and of wholly equal rows one."""
    names, docs = docs.columns, plain_names(docs)
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    cols = docs.columns
    marks = [next(m for m in (f"__mark_{k}{'_' * n}" for n in range(len(cols) + 1)) if m not in cols) for k in "ab"]
    parts = [x for c in docs.schema.fields for x in (_hashable(c), F.col(f"`{c.name}`").isNull())]
    marked = docs.withColumns({marks[0]: F.xxhash64(*parts), marks[1]: F.xxhash64(F.lit(1), *parts)})
    text = F.col(text_col).cast("string").alias("text")
    rows = cut(map_text(marked.select(text, F.col(id_col).cast("long").alias("id"), *marks), _signatures(words_in_shingle), f"node long, fp long, bands array<long>, sig binary, id long, {', '.join(f'{m} long' for m in marks)}"))
    nodes = cut(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "bands", "sig")], F.min(F.struct(*marks)).alias("mark")))

    def shingle_sets(wanted: DataFrame) -> DataFrame:
        ends = wanted.join(nodes, "node").select("node", *[F.col(f"mark.{m}").alias(m) for m in marks])
        texts = marked.select(text, *marks).join(small_side(ends), list(marks)).select("text", "node")
        return cut(map_text(texts, _shingle_sets(words_in_shingle), "node long, own binary").groupBy("node").agg(F.first("own").alias("own")))

    roots = groups(nodes.drop("mark"), shingle_sets, least, crowd)
    order = F.struct(F.col("id").isNull().alias("z"), "id", *marks)
    per_node = rows.groupBy("node").agg(F.min(order).alias("f"))
    first = per_node.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("f").alias("f")).select(*[F.col(f"f.{m}").alias(m) for m in marks]).distinct()
    copies = rows.groupBy(*marks).agg(F.count("*").alias("__copies"))
    chosen = cut(first.join(copies, list(marks)))
    single = marked.join(chosen.where("__copies = 1"), list(marks), "left_semi").select(*cols)
    several = marked.join(chosen.where("__copies > 1"), list(marks), "left_semi").groupBy(*marks).agg(F.first(F.struct(*cols)).alias("r")).select("r.*")
    return single.unionByName(several).toDF(*names)
