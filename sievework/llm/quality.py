"""Quality rules whose cutoffs are risk-controlled: DataFrame and SQL functions only.

Rules reject a document whose feature exceeds a cutoff. In each stratum the rules are tightened step by step, from none to
strict, and after each step the joint rejection by all rules is tested on the labelled holdout's good texts (quality 1) by
an exact binomial (Clopper-Pearson) bound: the chance of seeing as few false rejections as were seen, were the true
rate ``risk``, must be at most ``error`` over the number of strata tested (Bonferroni). The first step that fails ends the
stratum and the last that passed holds. A sequence fixed in advance needs no further correction, and this one is fixed
without the good texts: steps come from what the bad texts (quality 0) and those without a label exceed, the most telling
first. Strata are bands of document length, so their number is fixed. Only strata with
enough good texts to pass at all are tested (at the defaults 203 each if all three are, 149 for one alone); in others
the base rules alone reject.

A null text has no words and fails the base rules, as does an empty one. Labels that are null or missing
take no part; of several labels for one doc_id or one text (by a 64-bit hash) the lowest counts, so copies of
a text are one trial; near copies are several. Without labels only the base rules
reject. Repeated rows keep one row each. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side

#: Base rules: least words, most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Upper ends of the length bands (words) that are the strata; a last band is open.
BANDS = (200, 1000)
#: Most false rejections among a stratum's good documents by all rules together, and the chance of error over all tests together.
RISK, ERROR = 0.02, 0.05
#: What a false rejection weighs against a rejection of a bad document, both as shares of theirs.
PRICE = 5.0
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    name: str
    value: str
    grid: tuple[float, ...]


#: Rules in their order: SQL over the features, and the cutoffs tried, strictest first.
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1L)", tuple(round(0.01 * k, 4) for k in range(1, 31))),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1L)", tuple(round(0.02 * k, 4) for k in range(1, 26))),
    Rule("capitals", "n_capitals / greatest(word_chars, 1L)", tuple(round(0.05 * k, 4) for k in range(1, 20))),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1L)", tuple(round(0.02 * k, 4) for k in range(1, 26))),
)


def _let(value: Column, body) -> Column:
    """body(value), value being computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _twice(p: Column, same) -> Column:
    """Of sorted entries, those equal to the one before or after."""
    return F.filter(p, lambda x, k: F.coalesce(same(x, F.get(p, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k + 1)), F.lit(False)))


def _repeat_words(w: Column, h: Column) -> Column:
    """Words in three-word windows that occur twice or more. h: a hash of each window.

    Places are sorted with the low 40 bits of their hash above 24 bits of place, then those with a neighbour of
    the same bits are sorted by their words and compared. Texts of 2^24 words or more compare all their places.
    """
    packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 24).bitwiseOR(i.cast("bigint"))))
    close = _let(packed, lambda p: F.transform(_twice(p, lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)), lambda x: x.bitwiseAND(F.lit((1 << 24) - 1).cast("bigint")).cast("int")))
    places = F.when(F.size(h) < 1 << 24, close).otherwise(F.sequence(F.lit(0), F.size(h) - 1))
    named = F.sort_array(F.transform(places, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    at = F.sort_array(F.transform(_let(named, lambda p: _twice(p, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]))), lambda x: x["i"]))
    return _let(at, lambda a: F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - i, F.lit(3)))), F.lit(0), lambda s, x: s + x))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word), n_capitals (A to Z), text_hash of each document.

    Windows of three words are compared by a 64-bit hash first; only texts with equal hashes compare the words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = lambda chars: F.regexp_count("t", F.lit(chars)).cast("long")
    lines = F.when(F.col("t").contains("\n"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).otherwise(F.when(F.col("t").rlike(r"[^\x20\x09-\x0D]"), F.array("t")).otherwise(F.array().cast("array<string>")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    base = base.select("doc_id", F.xxhash64("t").alias("text_hash"), _words(F.col("t")).alias("w"), count("[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_capitals"), lines.alias("lines"))
    n = F.size("w")
    hashes = F.zip_with(F.zip_with("w", F.slice("w", 2, n), lambda a, b: F.xxhash64(a, b)), F.slice("w", 3, n), lambda h, c: F.xxhash64(h, c))
    h = F.when(n >= 3, F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select("doc_id", "text_hash", "w", "n_symbols", "n_capitals", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), h.alias("h"))
    repeat = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_repeat_words(F.col("w"), F.col("h")))
    return base.select("doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.cast("long").alias("n_repeat_words"), "n_lines", "n_capitals", "text_hash")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(BANDS))
    for k, top in reversed(list(enumerate(BANDS))):
        out = F.when(F.col("n_words") < top, k).otherwise(out)
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def passes(rejected: int, good: int, risk: float, level: float) -> bool:
    """Whether the exact bound shows a false rejection rate below ``risk`` at this level."""
    if good == 0 or rejected >= risk * good:
        return False
    return binomial_cdf(rejected, good, risk) <= level


def _exceeded(grid: tuple[float, ...], value: str) -> Column:
    """How many of a rule's cutoffs, which rise, a document exceeds."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in grid]), lambda c: F.expr(value) > c))


def _shares(counts: dict[int, int], cutoffs_: int, whole: int) -> list[float]:
    """Of ``whole`` documents, the share that exceeds each cutoff."""
    out, n = [], 0
    for k in range(cutoffs_ - 1, -1, -1):
        n += counts.get(k + 1, 0)
        out.append(n / whole if whole else 0.0)
    return out[::-1]


def steps(bad: dict[str, list[float]], other: dict[str, list[float]], part: float, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float]]:
    """(rule, cutoff) by which the rules are tightened one after another, the most telling first.

    bad, other: the shares of bad and of unlabelled texts that exceed each cutoff; ``part``: the share of bad ones among
    all. What good texts would lose is what the unlabelled lose beyond their bad part. A step is worth what it adds
    of bad texts less ``PRICE`` times what it costs of good ones; those worth nothing are left out.
    """
    chains = {}
    for r in rules:
        at, chains[r.name] = (0.0, 0.0), []
        for k, c in reversed(list(enumerate(r.grid))):
            now = (bad[r.name][k], max(0.0, (other[r.name][k] - part * bad[r.name][k]) / (1 - part)) if part < 1 else 0.0)
            worth = now[0] - at[0] - PRICE * (now[1] - at[1])
            if now[0] > at[0] and worth > 0:
                chains[r.name].append((worth, c))
                at = now
    out = []
    while any(chains.values()):
        name = max((n for n in chains if chains[n]), key=lambda n: chains[n][0][0])
        out.append((name, chains[name].pop(0)[1]))
    return out


def passed(rejected: list[int], good: int, risk: float, level: float) -> int:
    """How many steps, in order, keep the risk; rejected: the good texts that each step and those before reject."""
    for k, n in enumerate(rejected):
        if not passes(n, good, risk, level):
            return k
    return len(rejected)


def levels(good: dict[int, int], risk: float, error: float) -> dict[int, float]:
    """The level of each stratum that is tested: as many strata, the largest first, as could each pass with no false rejection at ``error`` over their number."""
    ranked = sorted(good, key=lambda s: (-good[s], s))
    m = max((m for m in range(1, len(ranked) + 1) if passes(0, good[ranked[m - 1]], risk, error / m)), default=0)
    return {s: error / m for s in ranked[:m]}


def cutoffs(feats: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> dict[tuple[int, str], float]:
    """The chosen cutoff of each stratum and rule. Counts come to the driver, at most one for each stratum and cutoff.

    With a column text_hash in ``feats`` each labelled text counts once, and copies of one aren't unlabelled texts.
    """
    fine = feats.where(~base_failed())
    marks = small_side(labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    known, other = fine.join(marks, "doc_id"), fine.join(marks, "doc_id", "left_anti")
    if "text_hash" in known.columns:
        rest = [c for c in known.columns if c not in ("text_hash", "quality")]
        known = cut(known.groupBy("text_hash").agg(F.min("quality").alias("quality"), *[F.min(c).alias(c) for c in rest]))
        other = other.join(small_side(known.select("text_hash")), "text_hash", "left_anti")
    kinds = known.where("quality in (0, 1)").unionByName(other.withColumn("quality", F.lit(None).cast("int")), allowMissingColumns=True).withColumn("s", stratum())
    cells = F.when(F.col("quality") == 1, F.array(F.struct(F.lit("").alias("rule"), F.lit(0).alias("k")))).otherwise(F.array(F.struct(F.lit("").alias("rule"), F.lit(0).alias("k")), *[F.struct(F.lit(r.name).alias("rule"), _exceeded(r.grid, r.value).alias("k")) for r in rules]))
    seen = {(r.s, r.quality, r.rule, r.k): r["count"] for r in kinds.select("s", "quality", F.explode(cells).alias("c")).groupBy("s", "quality", "c.rule", "c.k").count().collect()}
    order = {}
    for s in range(len(BANDS) + 1):
        whole = {q: seen.get((s, q, "", 0), 0) for q in (0, 1, None)}
        share = {q: {r.name: _shares({k: n for (s_, q_, name, k), n in seen.items() if (s_, q_, name) == (s, q, r.name)}, len(r.grid), whole[q]) for r in rules} for q in (0, None)}
        order[s] = steps(share[0], share[None], whole[0] / max(whole[0] + whole[1], 1), rules) if whole[0] and whole[1] else []
    value = {r.name: r.value for r in rules}
    first = F.lit(None).cast("int")
    for s, moves in order.items():
        if moves:
            hit = F.array_min(F.array_compact(F.array(*[F.when(F.expr(value[name]) > F.lit(c), F.lit(k)) for k, (name, c) in enumerate(moves)])))
            first = F.when(F.col("s") == s, hit).otherwise(first)
    falls = {(r.s, r.first): r["count"] for r in known.where("quality = 1").withColumn("s", stratum()).groupBy("s", first.alias("first")).count().collect()}
    good, out = {s: seen.get((s, 1, "", 0), 0) for s in order}, {}
    for s, level in levels(good, risk, error).items():
        rejected = [sum(falls.get((s, i), 0) for i in range(k + 1)) for k in range(len(order[s]))]
        for name, c in order[s][: passed(rejected, good[s], risk, level)]:
            out[s, name] = c
    return out


def verdict(chosen: dict[tuple[int, str], float], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule's cutoff is exceeded."""
    out = F.lit(True)
    for r in rules:
        limit = F.lit(float("inf"))
        for (s, name), c in sorted(chosen.items()):
            if name == r.name:
                limit = F.when(stratum() == s, c).otherwise(limit)
        out = out & (F.expr(r.value) <= limit)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The features with base_failed and kept, one row for each document."""
    feats = cut(features(docs, id_col, text_col))
    chosen = cutoffs(feats, labels, rules, risk, error)
    return feats.drop("text_hash").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(chosen, rules))
