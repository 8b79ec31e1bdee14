"""Topics mined from metadata of candidates: term counts, session profiles, learned profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planning import STOP_TERMS
from ..functions.text import ngrams, normalize_phrase, slug

#: Terms of a profile at most, and what a controlled and a text term weigh.
MOST_TERMS, CONTROLLED, TEXT = 12, 2, 1
#: Words whose terms are counted first for a lower bound, and words that are sent to tasks at most.
SEED_WORDS, MOST_WORDS = 200, 5_000
#: Terms too general to say anything.
GENERIC = ("agricultural and biological sciences", "biology", "biochemistry", "chemistry", "computer science", "earth and planetary sciences", "economics", "electrical engineering", "engineering", "environmental science", "materials science", "mathematics", "medicine", "physics", "psychology", "social sciences", "statistics")


def controlled_terms(concepts: Column, mesh_terms: Column, journal: Column) -> Column:
    """Terms between semicolons and commas of at least three characters, repeats included, and the journal."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), squeeze), lambda t: F.length(t) >= 3)
    name = squeeze(F.coalesce(journal, F.lit("")))
    return F.concat(split(concepts), split(mesh_terms), F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>")))


def kept_words(text: Column, stop: tuple[str, ...] = STOP_TERMS) -> Column:
    """Words over two letters that are no stop words, in order."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9-]*"), 0)
    return F.filter(words, lambda w: (F.length(w) > 2) & (~F.lower(w).isin(*stop) if stop else F.lit(True)))


def text_terms(text: Column, stop: tuple[str, ...] = STOP_TERMS) -> Column:
    """Runs of two and of three words over two letters that are no stop words."""
    return F.transform(F.array(kept_words(text, stop)), lambda w: F.concat(ngrams(w, 2), ngrams(w, 3)))[0]  # the words are found once


def placed_terms(text: Column, stop: tuple[str, ...], among: list[str]) -> Column:
    """struct(term, p): those of ``text_terms`` whose words are all ``among`` some words, with their places in that array."""
    return F.transform(F.array(kept_words(text, stop)), lambda w: F.transform(F.array(F.transform(w, lambda x: x.isin(among))), lambda ok: F.concat(_placed(w, ok, 2), _placed(w, ok, 3)))[0])[0]


def _placed(w: Column, ok: Column, n: int) -> Column:
    before = F.size(w) - 2 if n == 3 else F.lit(-1)  # runs of two stand before those of three
    start = F.filter(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: reduce(lambda a, b: a & b, [F.get(ok, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(w) >= n, F.transform(start, lambda i: F.struct(F.array_join(F.slice(w, i, n), " ").alias("term"), (before + i).alias("p")))).otherwise(F.array().cast("array<struct<term:string,p:int>>"))


def term_counts(records: DataFrame, order: str, stop: tuple[str, ...] = STOP_TERMS, generic: tuple[str, ...] = GENERIC, among: list[str] | None = None) -> DataFrame:
    """term, n (controlled terms weigh 2, text terms 1) and its first place (by ``order``, a unique number below 2^39, then within the record).

    records: concepts, mesh_terms, journal, text. Counts are summed before the shuffle, and terms are judged once each after it.
    Text terms with a word that is not ``among`` the given ones are left out.
    """
    controlled = controlled_terms(F.col("concepts"), F.col("mesh_terms"), F.col("journal"))
    runs = F.transform(text_terms(F.col("text"), stop), lambda t, i: F.struct(t.alias("term"), i.alias("p"))) if among is None else placed_terms(F.col("text"), stop, among)
    named = F.transform(F.array(controlled), lambda c: F.struct(c.alias("c"), F.size(c).alias("n")))[0]
    rows = records.select(F.col(order).cast("long").alias("o"), named.alias("c"), runs.alias("r")).select("o", F.explode(F.concat(F.transform("c.c", lambda t, i: F.struct(t.alias("term"), i.alias("p"), F.lit(CONTROLLED).alias("w"))), F.transform("r", lambda t: F.struct(t["term"].alias("term"), (t["p"] + F.col("c.n")).alias("p"), F.lit(TEXT).alias("w"))))).alias("t"))
    useful = normalize_phrase(F.col("term"))
    return rows.select("t.term", "t.w", (F.shiftleft("o", 24) + F.col("t.p")).alias("at")).groupBy("term").agg(F.sum("w").alias("n"), F.min("at").alias("first")).where((useful != "") & (~useful.isin(*generic) if generic else F.lit(True)))


def word_weights(records: DataFrame, stop: tuple[str, ...] = STOP_TERMS) -> DataFrame:
    """word and n: no text term that holds the word has a higher count. A controlled term counts for each of its words, as it may be a text's term too."""
    controlled = F.flatten(F.transform(controlled_terms(F.col("concepts"), F.col("mesh_terms"), F.col("journal")), lambda t: F.array_distinct(F.split(t, " "))))
    text, named = records.select(F.explode(kept_words(F.col("text"), stop)).alias("word"), F.lit(TEXT).alias("w")), records.select(F.explode(controlled).alias("word"), F.lit(CONTROLLED).alias("w"))
    return text.unionByName(named).groupBy("word").agg(F.sum("w").alias("n"))


def top_terms(records: DataFrame, order: str, stop: tuple[str, ...] = STOP_TERMS, generic: tuple[str, ...] = GENERIC, most: int = MOST_TERMS, seeds: int = SEED_WORDS, words: int = MOST_WORDS) -> DataFrame:
    """``most_common`` of ``term_counts``, without a shuffle of all terms.

    No term is commoner than its words. Terms of the commonest words are counted first; the least of the ``most`` best is a count
    that all winners reach, so only terms whose words all reach it are counted in the end. Where there are too few such terms, or too many such words to send, all terms are counted.
    """
    every = lambda: most_common(term_counts(records, order, stop, generic), most)
    common = word_weights(records, stop).orderBy(F.desc("n"), "word").limit(words + 1).collect()
    best = most_common(term_counts(records, order, stop, generic, [r.word for r in common[:seeds]]), most).collect() if common else []
    if len(best) < most:
        return every()
    least = min(r.n for r in best)
    among = [r.word for r in common if r.n >= least]
    return every() if len(among) > words else most_common(term_counts(records, order, stop, generic, among), most)


def most_common(counts: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The terms of the highest counts, earlier seen ones first among equals."""
    return counts.orderBy(F.desc("n"), "first").limit(most)


def mine_profile(question: str, records: DataFrame, order: str, min_count: int = 2, stop: tuple[str, ...] = STOP_TERMS, generic: tuple[str, ...] = GENERIC, most: int = MOST_TERMS) -> DataFrame:
    """One row: a session profile of a question and the terms its candidates repeat. Queries are the question alone and with its first five terms."""
    asked = " ".join(question.split())
    top = top_terms(records, order, stop, generic, most).where(F.col("n") >= min_count)
    terms = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "term"))), lambda x: x["term"]).alias("positive_terms"))
    other = F.filter(F.slice("positive_terms", 1, 5), lambda t: normalize_phrase(t) != normalize_phrase(F.lit(asked)))
    ask = F.array_distinct(F.concat(F.array(F.lit(asked)), F.transform(other, lambda t: F.concat(F.lit(asked + " "), t))))
    some = F.size("positive_terms") > 0
    return terms.select(F.concat(F.lit("session."), slug(F.lit(asked))).alias("profile_id"), F.when(some, "session").otherwise("unknown").alias("domain"), F.array(F.lit(asked)).alias("core_terms"), "positive_terms", ask.alias("search_queries"), F.when(some, "metadata_mined_profile").otherwise("no_repeated_metadata_terms").alias("reason"))


def learned_terms(relevant: DataFrame, irrelevant: DataFrame, order: str, stop: tuple[str, ...] = STOP_TERMS, generic: tuple[str, ...] = GENERIC, most: int = MOST_TERMS) -> DataFrame:
    """term, n, kind of a learned profile: the commonest terms of relevant records, and those of irrelevant ones that are not among them."""
    good = top_terms(relevant, order, stop, generic, most).select("term", "n", F.lit("positive").alias("kind"))
    bad = top_terms(irrelevant, order, stop, generic, most).select("term", "n", F.lit("negative").alias("kind"))
    return good.unionByName(bad.join(F.broadcast(good.select("term")), "term", "left_anti"))
