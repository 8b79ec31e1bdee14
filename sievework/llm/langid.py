"""Language identification by unigrams over a fixed public vocabulary, marginalised over segmentations.

Each language has probabilities of the vocabulary's pieces. A word's likelihood is the sum, by the forward
algorithm, over all its segmentations into pieces; a text's is the product over its words (runs of letters,
lower-cased, each with the word mark before it; a run of more than 32 letters is scored in parts of 32, so
segmentations with a piece across a cut are left out). Learning counts every word of every training document by
language, then runs expectation-maximisation (forward-backward) over these counts.

A text that is null or has no letter is ``und`` with score 0. Training texts with a null lang teach nothing.
With nothing to learn from, every text is ``und``. Ties go to the language first in order of name. Repeated
rows keep one row each. Other columns are passed through (``keep``) or not read (``predict``).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, plain_names

UNDEFINED, MARK = "und", "▁"
#: Rounds of expectation-maximisation; added to each piece's count; the probability of a character outside the vocabulary.
ROUNDS, SMOOTH, UNKNOWN = 2, 0.05, 1e-7
#: More languages than this are refused: a model holds one row of the vocabulary for each.
MOST_LANGUAGES = 256
#: A word longer than this is scored in parts of this length, so the cost stays linear.
LONGEST = 32
#: Distinct words that a worker keeps.
MOST_WORDS = 800_000
WORD = re.compile(r"[^\W\d_]+")
_VOCAB: dict[str, dict[str, int]] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case letter pieces of the model, each once, in order."""
    if path not in _VOCAB:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        own: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i).lower()
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) and (p == MARK or p.lstrip(MARK).isalpha() and p.count(MARK) == p.startswith(MARK)):
                own.setdefault(p, len(own))
        _VOCAB[path] = own
    return _VOCAB[path]


@dataclass
class Model:
    path: str
    langs: list[str] = field(default_factory=list)
    prior: list[float] = field(default_factory=list)
    #: One row for each language: piece probabilities.
    pieces: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


class Segmenter:
    """All segmentations of many words at once, as edges between places of one joined string."""

    def __init__(self, path: str):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for p, i in vocabulary(path).items():
            self.auto.add_word(p, i << 8 | len(p))
        self.auto.make_automaton()

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end and piece (-1: a character outside the vocabulary) of each edge, by end; and each word's start and end.

        Pieces hold the word mark only as their first character, so none spans two words.
        """
        text = MARK + MARK.join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stop = np.cumsum(size)
        found = np.fromiter(chain.from_iterable(self.auto.iter(text)), np.int64).reshape(-1, 2)
        end, piece, n = found[:, 0] + 1, found[:, 1] >> 8, found[:, 1] & 255
        single = np.zeros(len(text) + 1, bool)
        single[end[n == 1]] = True
        missing = np.flatnonzero(~single[1:]) + 1
        if len(missing):
            end, piece, n = np.r_[end, missing], np.r_[piece, np.full(len(missing), -1)], np.r_[n, np.ones(len(missing), np.int64)]
        return end - n, end, piece, stop - size, stop


def _levels(key: np.ndarray, depth: np.ndarray, backwards: bool = False):
    """Groups of edges by depth, each sorted by key, with the keys and where each key's run begins."""
    order = np.lexsort((key, depth))
    key, depth = key[order], depth[order]
    cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1]]) if len(depth) else np.zeros(0, np.int64)
    spans = list(zip(cuts, np.r_[cuts[1:], len(depth)]))
    for lo, hi in reversed(spans) if backwards else spans:
        k = key[lo:hi]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        yield order[lo:hi], k[first], first


def likelihoods(seg: Segmenter, words: list[str], p: np.ndarray) -> np.ndarray:
    """The log likelihood of each word (rows) in each language (columns): forward over all segmentations. p: pieces by languages, with a last row for unknown characters."""
    start, end, piece, at, stop = seg.edges(words)
    a = np.zeros((int(stop[-1]) + 1, p.shape[1]))
    origin = np.repeat(at, stop - at)  # of each place but the last
    # A place is both a word's end and the next one's start: ends are kept apart
    total = np.zeros((len(words), p.shape[1]))
    word = np.repeat(np.arange(len(words)), stop - at)
    a[at] = 1.0
    last = end == stop[word[start]]
    for own, key, first in _levels(end, end - origin[start]):
        sums = np.add.reduceat(a[start[own]] * p[piece[own]], first, axis=0)
        done = last[own[first]]
        total[word[start[own[first[done]]]]] = sums[done]
        a[key[~done]] = sums[~done]
    return np.log(np.maximum(total, 1e-300))


def expected(seg: Segmenter, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words with their counts, over all segmentations (forward-backward), in one language."""
    start, end, piece, at, stop = seg.edges(words)
    size = int(stop[-1]) + 1
    origin, word = np.repeat(at, stop - at), np.repeat(np.arange(len(words)), stop - at)
    w = p[piece]
    last = end == stop[word[start]]
    total, a = np.zeros(len(words)), np.zeros(size)
    a[at] = 1.0
    for own, key, first in _levels(end, end - origin[start]):
        sums = np.add.reduceat(a[start[own]] * w[own], first)
        done = last[own[first]]
        total[word[start[own[first[done]]]]] = sums[done]
        a[key[~done]] = sums[~done]
    b = np.zeros(size)
    for own, key, first in _levels(start, start - origin[start], backwards=True):
        b[key] = np.add.reduceat(np.where(last[own], 1.0, b[end[own]]) * w[own], first)
    after = np.where(last, 1.0, b[end])
    share = a[start] * w * after * (counts / np.maximum(total, 1e-300))[word[start]]
    return np.bincount(piece[piece >= 0], share[piece >= 0], len(p) - 1)


def _parts(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    docs: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            items = [(w, n) for w, n in c.items()] + [("", docs[lang])]
            for k in range(0, len(items), 20_000):
                part = items[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])
        counts.clear()
        docs.clear()

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs[lang] += 1
            counts[lang].update(WORD.findall(text.lower()))
        if sum(map(len, counts.values())) > 1_000_000:
            yield from flush()
    yield from flush()


def learn(docs: DataFrame, training: str = "crc32(cast(doc_id as string)) % 4 <> 2", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from all training documents (``training``: SQL over doc_id). A row of the vocabulary for each language comes to the driver."""
    path = path or default_path()
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(f"text is not null and lang is not null and ({training})")
    words = cut(map_text(known.select("text", "lang"), _words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    first = words.where("word = ''").orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(first) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs, total = [r.lang for r in first], sum(r.n for r in first)
    size = len(vocabulary(path))
    p = np.full((len(langs), size), 1.0 / size)
    if not langs:
        return Model(path, [], [], p)
    at = {lang: k for k, lang in enumerate(langs)}
    for _ in range(rounds):
        now = p.astype(np.float32)

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            seg, sums = Segmenter(path), np.zeros(now.shape)
            for b in batches:
                own: dict[int, list] = defaultdict(list)
                for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                    own[at[lang]] += [(part, n) for part in _parts(word)]
                for k, items in own.items():
                    sums[k] += expected(seg, [w for w, _ in items], np.array([n for _, n in items], float), np.append(now[k].astype(float), UNKNOWN))
            k, i = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[k, i])], names=["k", "i", "x"])

        new = np.full(p.shape, SMOOTH)
        got = words.where("word <> ''").mapInArrow(step, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).toPandas()
        new[got["k"].to_numpy(), got["i"].to_numpy()] += got["x"].to_numpy()
        p = new / new.sum(1, keepdims=True)
    return Model(path, langs, [r.n / total for r in first], p.astype(np.float32))


class Scorer:
    """Log likelihoods of words by language, each distinct word of a worker once, new words of a batch together."""

    def __init__(self, model: Model):
        self.model, self.seg = model, Segmenter(model.path)
        self.p = np.vstack([model.pieces.T.astype(float), np.full((1, len(model.langs)), UNKNOWN)]) if model.langs else None
        self.prior = np.log(np.maximum(model.prior, 1e-9)) if model.langs else np.zeros(0)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)))

    def _learn(self, texts: list[list[str]]) -> None:
        """Rows for the words of a batch; the memo starts anew when it is full."""
        if len(self.rows) > MOST_WORDS:
            self.rows.clear()
        new = list(set().union(*texts) - self.rows.keys())
        for lo in range(0, len(new), 8192):
            words = new[lo : lo + 8192]
            parts = [_parts(w) for w in words]
            got = likelihoods(self.seg, [x for ps in parts for x in ps], self.p)
            first = np.cumsum([0, *map(len, parts)])[:-1]
            while len(self.table) < len(self.rows) + len(words):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            n = len(self.rows)
            self.table[n : n + len(words)] = np.add.reduceat(got, first, axis=0)
            self.rows.update(zip(words, range(n, n + len(words))))

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        if not self.model.langs:
            return [(UNDEFINED, 0.0)] * len(texts)
        self._learn(words)
        return [self._predict(w) for w in words]

    def _predict(self, words: list[str]) -> tuple[str, float]:
        """The language and its posterior, evidence beyond 50 words' worth being damped to 50 words."""
        if not words or not any(c.isalpha() for w in words for c in w):
            return UNDEFINED, 0.0
        n, row = len(words), self.rows.__getitem__
        x = self.prior + self.table[np.fromiter(map(row, words), np.int64, n)].sum(0) * (min(n, 50) / n)
        k = int(np.argmax(x))
        return self.model.langs[k], float(1.0 / np.exp(x - x[k]).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            got = s.predictions(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), step, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs whose language is found with a score of ``least`` or more; their columns as they are, whatever their names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            got = s.predictions(b.column(at).to_pylist())
            yield b.filter(pa.array([g[0] != UNDEFINED and g[1] >= least for g in got], pa.bool_()))

    rows = plain_names(docs)
    return map_text(rows, step, rows.schema).toDF(*docs.columns)
