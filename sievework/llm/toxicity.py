"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alikes, normalised by length.

Folding lowers case, takes accents off, maps homoglyphs (Cyrillic, Greek, full-width) and digit and symbol
substitutions to Latin letters, and drops zero-width characters. Learning counts, over all labelled training
documents, in how many families each word and word stem occurs by label; a family is a group of near copies
that share a MinHash value, so a thousand copies count once. Terms that mark label 1 get their log odds as
weight. A match must start a word (a whole-word term must also end it) and lie outside every exception
phrase. The score is x / (x + t) of x, the summed weights over a slowly rising function of length; t is
the fitted cutoff, so 0.5 means label 1.

Terms are counted once for each family and label, over the family's text of the smallest doc_id; the cutoff is
fitted over every labelled training text. Words of under 3 or over 40 letters never become terms.

Null and empty texts score 0; very long texts are read whole. Labels null or missing teach nothing; of several
labels for one doc_id the highest counts. With nothing to learn from, every score is 0. Repeated rows keep one row
each, and texts alike in their folded words score alike. An empty table gives an empty result. Other columns are
passed through (``mark``) or not read (``score``).
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, plain_names, small_side

#: Homoglyphs that Unicode decomposition leaves apart, and substitutions. i, l, 1, | and ! fold to one letter.
HOMOGLYPHS = dict(zip("асеорхуѕјһԁԛԝкмнтв", "aceopxysjhdqwkmhtb")) | dict(zip("αεορυκνηχτω", "aeopuknnxtw")) | {"і": "l", "ι": "l", "ı": "l", "ß": "ss"}
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "|": "l", "!": "l", "i": "l"}
ZERO_WIDTH = "­​‌‍⁠﻿"
#: Harmless phrases around words that may be in a lexicon.
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash bag", "pond scum", "soap scum", "idiot proof", "loser bracket")
#: Stems of these lengths are tried beside whole words; terms kept at most; families a term must mark; least lift.
STEMS, MOST_TERMS, LEAST_FAMILIES, LEAST_LIFT = (4, 5, 6), 4096, 5, 8.0


class _Fold(dict):
    def __missing__(self, code: int):
        c = chr(code).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out = "".join(SUBSTITUTES.get(x, x) for y in plain for x in HOMOGLYPHS.get(y, y))
        out = out if all(x.isalnum() for x in out) else "".join(x if x.isalnum() else " " for x in out)
        self[code] = value = None if c in ZERO_WIDTH else out
        return value


FOLD = _Fold()
_TRAILING = re.compile(r"[!|]+(?!\w)")


def fold(text: str) -> str:
    """Letters and blanks only; what stands in for a letter inside a word becomes it. A ! or | that ends a word ends it."""
    if "!" in text or "|" in text:
        text = _TRAILING.sub(" ", text)
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """Folded terms with weights; a term that ends in a blank is a whole word, else a stem."""

    weights: dict[str, float] = field(default_factory=dict)
    cutoff: float = 1.0
    exceptions: tuple[str, ...] = EXCEPTIONS


def density(weight: float, n_words: int) -> float:
    """The summed weight over a length norm that rises with the logarithm of the words."""
    return weight / (1.0 + math.log1p(n_words / 100.0))


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.cutoff, self.n = lexicon.cutoff, len(lexicon.weights)
        self.auto = ahocorasick.Automaton()
        for term, w in lexicon.weights.items():
            self.auto.add_word(" " + term, (len(term), w))
        for phrase in lexicon.exceptions:
            folded = " " + " ".join(fold(phrase).split()) + " "
            self.auto.add_word(folded, (len(folded) - 1, None))
        self.auto.make_automaton()

    def weight(self, text: str | None) -> tuple[float, int]:
        """Summed weight of the matches, the longest at each place, outside exception phrases; and the number of words."""
        if not text or not self.n:
            return 0.0, 0
        words = fold(text).split()
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.auto.iter(f" {' '.join(words)} "):
            at = end - n + 1
            if w is None:
                spared.append((at, end))
            elif n > best.get(at, (0, 0.0))[0]:
                best[at] = (n, w)
        if spared:
            best = {a: v for a, v in best.items() if not any(x <= a and a + v[0] - 1 <= y for x, y in spared)}
        return sum(w for _, w in best.values()), len(words)

    def score(self, text: str | None) -> float:
        w, n = self.weight(text)
        x = density(w, n)
        return x / (x + self.cutoff) if x > 0 else 0.0


def _family(words: list[str], k: int = 5) -> int:
    """The least hash of the k-word shingles: near copies mostly share it."""
    import xxhash

    if len(words) <= k:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(map(xxhash.xxh64_intdigest, map(" ".join, zip(*(words[i:] for i in range(k)))))) >> 1


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_family(t.lower().split()) for t in texts], pa.int64()), pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), b.column(2)], names=["doc_id", "family", "crc", "toxic"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the task's documents with the number of documents of each label; stems and whole words."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        terms = list(counts[0].keys() | counts[1].keys())
        for k in range(0, len(terms), 20_000):
            part = terms[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()), pa.array([counts[0][t] for t in part], pa.int64())], names=["term", "toxic", "clean"])
        for c in counts:
            c.clear()

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = {w for w in fold(text).split() if 3 <= len(w) <= 40 and not w.isdigit()}
            terms = {w + " " for w in words}
            for n in STEMS:
                terms.update([w[:n] for w in words if len(w) > n])
            counts[int(toxic > 0)].update(terms)
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield from flush()
    yield from flush()


def labelled(docs: DataFrame, labels: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, toxic of documents with a label and a text for which ``training`` (SQL over doc_id) holds."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(f"text is not null and ({training})")
    return narrow.join(small_side(marks.where(training)), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, training: str = "crc32(cast(doc_id as string)) % 5 <> 0", id_col: str = "doc_id", text_col: str = "text", most_terms: int = MOST_TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon and cutoff from all training documents. Only counts of at most ``most_terms`` terms come to the driver."""
    known = labelled(docs, labels, training, id_col, text_col)
    families = cut(map_text(known.select("doc_id", "text", "toxic"), _families, "doc_id long, family long, crc long, toxic int"))
    first = families.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "crc")).alias("f")).select("f.doc_id", "f.crc", "toxic")
    first = cut(first)
    n = {int(r.toxic > 0): r["count"] for r in first.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return Lexicon({}, 1.0, exceptions)
    alone = known.withColumn("crc", F.crc32(F.col("text").cast("binary"))).join(small_side(first.drop("toxic")), ["doc_id", "crc"], "left_semi").select("text", "toxic")
    counts = map_text(alone, _count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    lift = ((F.col("t") + 0.5) / F.lit(n1 + 1.0)) / ((F.col("c") + 0.5) / F.lit(n0 + 1.0))
    top = counts.where(F.col("t") >= LEAST_FAMILIES).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT).orderBy(F.desc(F.col("t") * F.log("lift")), "term").limit(most_terms).collect()
    weights: dict[str, float] = {}
    for r in sorted(top, key=lambda r: (len(r.term), r.term)):
        # a longer term adds nothing where a shorter stem of it marks label 1 as surely
        if not any(r.term.startswith(s) and weights[s] >= 0.8 * math.log(r.lift) for s in (r.term[:k] for k in STEMS) if s in weights):
            weights[r.term] = math.log(r.lift)
    lexicon = Lexicon(weights, 1.0, exceptions)
    lexicon.cutoff = _fit_cutoff(known, lexicon)
    return lexicon


def _fit_cutoff(known: DataFrame, lexicon: Lexicon) -> float:
    """The density that splits the training labels with the fewest errors, from a histogram of 400 steps."""
    step = 0.05

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, c = Matcher(lexicon), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = density(*m.weight(text))
                c[(-1 if x <= 0 else min(399, int(x / step)), int(toxic > 0))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.int32()), pa.array([k[1] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["cell", "toxic", "n"])

    hist = {(r.cell, r.toxic): r.n for r in map_text(known.select("text", "toxic"), cells, "cell int, toxic int, n long").groupBy("cell", "toxic").agg(F.sum("n").alias("n")).collect()}
    best = (None, 0)
    for k in range(400):
        errors = sum(v for (c, y), v in hist.items() if (c >= k) != (y == 1))
        if best[0] is None or errors < best[0]:
            best = (errors, k)
    return max(best[1], 0.2) * step


def mark(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep_below: float | None = None) -> DataFrame:
    """docs with a column toxicity, in place of one of that name; with ``keep_below``, docs of a lower score only, and their own columns alone. Columns may have any names."""
    docs = docs if keep_below is not None else docs.drop("toxicity")
    at, rows = docs.columns.index(text_col), plain_names(docs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for b in batches:
            scores = [m.score(t) for t in b.column(at).to_pylist()]
            if keep_below is not None:
                yield b.filter(pa.array([s < keep_below for s in scores]))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "toxicity"])

    if keep_below is not None:
        return map_text(rows, step, rows.schema).toDF(*docs.columns)
    return map_text(rows, step, type(rows.schema)(rows.schema.fields[:]).add("toxicity", "double")).toDF(*docs.columns, "toxicity")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and toxicity, one row for each document."""
    return mark(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), lexicon).select("doc_id", "toxicity")
