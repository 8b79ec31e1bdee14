"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter stands in it an odd number of times. One inserted or deleted
letter flips one bit, a replaced one two at most. The bits are split into three bands. Words of one length that differ by
a replacement agree in one band at least, and words whose lengths differ by one agree in two. So words are
keyed by length and band, and by the shorter length and two bands; words with equal keys whose masks differ in few enough
bits are candidates, which a comparison of the words decides. Letters are dealt over the bands by how often they occur,
so that each band tells words apart about equally well; letters of other alphabets share bits, which loses no pair.

A pair is emitted by the first key that it shares. Only masks are compared within a key, in blocks, and a key's words are
cut into parts that meet two by two, so no task holds a crowded key and only verified pairs leave it.

Null and empty texts have no words. A null doc_id counts as an empty one. Repeated rows count again. Ties of the most
frequent near word go to the smallest in code-point order. Very long texts and runs are read whole. An empty table gives
an empty result. Columns other than the two named are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, small_side, stored

SHORTEST, LEAST, FACTOR, SLIP = 5, 3, 2, 97
#: Words a task counts before it hands them on, words of one key in a part, pairs of masks compared at once.
HELD, CROWD, BLOCK = 400_000, 8192, 1 << 17
#: Bytes of words whose checksums are taken many at once.
SHORT = 48
RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters from common to rare, as in most texts of Latin script; they are dealt over the bands in turn, back and forth.
COMMON = "eainrtsoludchmgpbfvwkzyjxq"


def _bits() -> dict[str, int]:
    """The bit of each letter: common ones have bits of their own, the others share 38; bit b is in band b % 3."""
    deal = [0, 1, 2, 2, 1, 0]
    nexts, bits = [0, 1, 2], {}
    for k, letter in enumerate(COMMON):
        band = deal[k % 6]
        bits[letter] = nexts[band]
        nexts[band] += 3
    return bits


_BIT = _bits()
_SHARED = [b for b in range(64) if b not in _BIT.values()]
BANDS = [sum(1 << b for b in range(64) if b % 3 == k) for k in range(3)]


def mask(word: str) -> int:
    """The letter-parity mask of a word."""
    out = 0
    for c in word:
        b = _BIT.get(c)
        out ^= 1 << (_SHARED[ord(c) % len(_SHARED)] if b is None else b)
    return out


class _Words(dict):
    """Numbers words as they come, with the checksum and the bytes of each."""

    def __init__(self):
        super().__init__()
        self.crcs, self.sizes = [], []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        data = word.encode()
        self.crcs.append(zlib.crc32(data))
        self.sizes.append(len(data))
        return k


def _after(starts: list[int]) -> np.ndarray:
    """What text before a word of each length (to SHORT bytes) changes in its checksum, a row for each checksum of that text."""
    zeros = [bytes(k) for k in range(SHORT + 1)]
    own = np.array([zlib.crc32(z) for z in zeros], np.uint32)
    return np.array([[zlib.crc32(z, s) for z in zeros] for s in starts], np.uint32).reshape(-1, SHORT + 1) ^ own


def _counted(slip: int, shortest: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, slipped = _Words(), np.zeros(0, np.int64), Counter()

        def out() -> pa.RecordBatch:
            for word, n in zip(known, total.tolist()):
                if n and len(word) >= shortest:
                    slipped[word] += n
            return pa.RecordBatch.from_arrays([pa.array(list(slipped), pa.string()), pa.array(list(slipped.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            own, starts = [], []
            for id_, text in zip(*(c.to_pylist() for c in b.columns)):
                starts.append(zlib.crc32(f"{'' if id_ is None else id_}:".encode()))
                runs = RUN.findall((text or b"").lower().decode("utf-8", "replace"))
                own.append(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)))
            ids = np.concatenate(own)
            doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
            crcs, sizes = np.array(known.crcs, np.uint32), np.array(known.sizes, np.int64)
            size = sizes[ids]
            h = crcs[ids] ^ _after(starts)[doc, np.minimum(size, SHORT)]
            odd = np.flatnonzero((h % np.uint32(slip) == 0) | (size > SHORT))
            n = np.bincount(ids, minlength=len(known))
            words = list(known) if len(odd) else []
            for i, d in zip(ids[odd].tolist(), doc[odd].tolist()):
                word = words[i]
                mark = zlib.crc32(word.encode(), starts[d])
                if mark % slip == 0:
                    n[i] -= 1
                    at = mark % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        slipped[word] += 1
            n[: len(total)] += total
            total = n
            if len(known) + len(slipped) >= HELD:
                yield out()
                known, total = _Words(), np.zeros(0, np.int64)
                slipped.clear()
        if known:
            yield out()

    return step


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """word, n: the lower-case runs of letters with at least ``least`` occurrences; one in ``slip`` runs of a document loses a letter first.

    Tasks count before they shuffle, so a common word is one row of each.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_text(rows, _counted(slip, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under its keys: of its length, one band; two bands as the shorter of two lengths; two bands as the longer."""
    for b in batches:
        words = b.column(0).to_pylist()
        masks = np.array([mask(w) for w in words], np.uint64)
        sizes = np.array([len(w) for w in words], np.int32)
        keys, bases = [], []
        for kind in range(9):
            bands = BANDS[kind] if kind < 3 else sum(BANDS) - BANDS[kind % 3]
            base = sizes - (kind >= 6)
            family = kind if kind < 3 else 3 + kind % 3
            keys.append((masks & np.uint64(bands)) * np.uint64(0x9E3779B97F4A7C15) ^ (base.astype(np.uint64) * np.uint64(6) + np.uint64(family)) * np.uint64(0xC2B2AE3D27D4EB4F))
            bases.append(base)
        kinds = np.repeat(np.arange(9, dtype=np.int8), len(words))
        rest = [pa.array(np.tile(masks, 9).view(np.int64)), pa.array(kinds), pa.array(np.concatenate(bases)), pa.concat_arrays([b.column(0)] * 9), pa.concat_arrays([b.column(1)] * 9)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *rest], names=["key", "mask", "kind", "base", "word", "n"])


def _first(x: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether ``kind`` is the first key that two masks share; x: their differing bits."""
    same = [(x & np.uint64(b)) == 0 for b in BANDS]
    first_one = np.where(same[0], 0, np.where(same[1], 1, 2))
    first_two = np.where(same[1] & same[2], 0, np.where(same[0] & same[2], 1, 2))
    return np.where(kind < 3, first_one, first_two) == kind % 3


def _letters(words: np.ndarray, size: int) -> np.ndarray:
    """A row of code points for each word of one length."""
    return np.ascontiguousarray(words.astype(f"<U{size}")).view(np.uint32).reshape(len(words), size)


def _lanes(letters: np.ndarray) -> np.ndarray:
    """Eight bytes of each word, each of every eighth place: words that differ in one place differ in one byte at most."""
    out = np.zeros(len(letters), np.uint64)
    for k in range(letters.shape[1]):
        mixed = (letters[:, k].astype(np.uint64) * np.uint64(2 * k + 0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(255)
        out ^= mixed << np.uint64(8 * (k % 8))
    return out


def _replaced(masks: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i < j) of words of one length that differ in one letter, in blocks."""
    lanes, rows, found, low = _lanes(letters), max(1, BLOCK // len(masks)), [], np.uint64(0x7F7F7F7F7F7F7F7F)
    for lo in range(0, len(masks), rows):
        i, j = np.nonzero(np.bitwise_count(masks[lo : lo + rows, None] ^ masks[None, lo:]) <= 2)
        i, j = i[i < j] + lo, j[i < j] + lo
        x = lanes[i] ^ lanes[j]
        one = np.bitwise_count((((x & low) + low) | x) & ~low) <= 1
        i, j = i[one], j[one]
        one = (letters[i] != letters[j]).sum(1) == 1
        found.append((i[one], j[one]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _deleted(masks: np.ndarray, letters: np.ndarray, longer: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words (masks, letters) and of longer ones (longer, more) that lose one letter to them, in blocks."""
    rows, found, size = max(1, BLOCK // len(longer)), [], letters.shape[1]
    for lo in range(0, len(masks), rows):
        i, j = np.nonzero(np.bitwise_count(masks[lo : lo + rows, None] ^ longer[None, :]) == 1)
        i = i + lo
        head = np.logical_and.accumulate(letters[i] == more[j, :size], 1).sum(1)
        tail = np.logical_and.accumulate((letters[i] == more[j, 1:])[:, ::-1], 1).sum(1)
        one = head + tail >= size
        found.append((i[one], j[one]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells sorted by key, family, length and kind: the pairs one edit apart, each in both directions."""

    def pairs(cell: np.ndarray, mixed: np.ndarray, part: np.ndarray, masks: np.ndarray, kind: np.ndarray, base: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        family = np.where(kind < 3, kind, 3 + kind % 3)
        group = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (family[1:] != family[:-1]) | (base[1:] != base[:-1]), True])
        for lo, hi in zip(group[:-1].tolist(), group[1:].tolist()):
            mid, size = lo + int(np.searchsorted(kind[lo:hi], 6)), int(base[lo])
            if kind[lo] < 3 and hi - lo > 1:
                i, j = _replaced(masks[lo:hi], _letters(word[lo:hi], size))
                j = j + lo
            elif kind[lo] >= 3 and lo < mid < hi:  # the shorter words come first
                i, j = _deleted(masks[lo:mid], _letters(word[lo:mid], size), masks[mid:hi], _letters(word[mid:hi], size + 1))
                j = j + mid
            else:
                continue
            i = i + lo
            ok = (~mixed[i] | (part[i] != part[j])) & _first(masks[i] ^ masks[j], kind[i])
            left.append(i[ok])
            right.append(j[ok])
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            both = [np.r_[left, right], np.r_[right, left]]
            yield pa.RecordBatch.from_arrays([pa.array(word[both[0]], pa.string()), pa.array(word[both[1]], pa.string()), pa.array(n[both[1]].astype(np.int64))], names=["word", "near", "near_n"])

    rest: list[np.ndarray] | None = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        new[3] = new[3].astype(np.int64).view(np.uint64)
        new = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        ready = int(np.searchsorted(new[0], new[0][-1])) if len(new[0]) else 0
        if ready:
            yield from pairs(*(x[:ready] for x in new))
        rest = [x[ready:] for x in new]
    if rest is not None and len(rest[0]):
        yield from pairs(*rest)


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, near, near_n: each pair of words one edit apart, in both directions. words: distinct word, n."""
    keyed = cut(map_text(words.select("word", "n"), _keyed, "key long, mask long, kind byte, base int, word string, n long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    crowded = small_side(sizes.where(F.col("size") > crowd))
    rows = keyed.join(sizes.select("key"), "key", "left_semi").join(crowded, "key", "left")
    parts = F.coalesce(F.ceil(2 * F.col("size") / crowd), F.lit(1)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    cells = cells.select(cell.alias("cell"), (F.col("part") != F.col("other")).alias("mixed"), "part", "mask", "kind", "base", "word", "n")
    family = F.when(F.col("kind") < 3, F.col("kind")).otherwise(3 + F.col("kind") % 3)  # keys whose hashes are equal stay apart
    return map_text(cells.repartition("cell").sortWithinPartitions("cell", family, "base", "kind"), _meet, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of a word lead. forms: word, form (not null), of ever more frequent words, so there is no ring.

    Pointers jump twice as far each round; what has arrived takes no part in the next.
    """
    at = cut(forms.select("word", F.col("form").alias("to")))
    while True:
        step = at.select(F.col("word").alias("to"), F.col("to").alias("next"))
        met, left = stored(at.join(small_side(step), "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not left or met.where("moved").isEmpty():
            return met.select("word", F.col("to").alias("root"))
        at = met.select("word", "to")


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the distinct words with their counts n.

    A word's form is its near word of largest n, if that is at least ``factor`` times the word's.
    """
    words = cut(words)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    named = words.join(best, "word", "left")
    taken = -F.col("b.minus") >= factor * F.col("n")
    named = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("b.near")).alias("form"), F.when(taken, -F.col("b.minus")).alias("form_n")))
    led = roots(named.where("form IS NOT NULL").select("word", "form"))
    return named.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group_variants`` over the documents' own ``vocabulary``."""
    return group_variants(vocabulary(docs, id_col, text_col))
