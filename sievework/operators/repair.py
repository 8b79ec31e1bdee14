"""What a rejected draft needs for its repair: the sentences that failed, the citations behind them, and their evidence.

A failure text names a sentence if a run of two to five of its longer words stands in the sentence. A run of more than two
holds one of two, so two words decide. They are found by an inverted index: two neighbouring words of at least four
letters, the second of which begins where the first one ended, leave the same nine characters around the blank in
both texts, and an equal join on these gives the candidates, which a comparison of the words decides. A failure text with
a single longer word is probed by the rarest of its runs of four characters among the draft's words.

Rows without a key have no failures. Null and empty drafts have no sentences. Of equal sentences the first stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations
from .report import draft_sentences, none

#: Letters of a word that the index keeps, and the least length of a word that counts.
EDGE = LEAST = 4
#: Characters that fold into letters which failure texts hold.
FOLDED = {"ß": "ss", "ẞ": "ss", "ſ": "s", "K": "k", "µ": "μ", "ϐ": "β", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_CITED = r"(?i)\bP\d+\s+p\d+\b"


def folded(c: Column) -> Column:
    """Lower case in which forms of a letter that differ by case alone are one."""
    single = {k: v for k, v in FOLDED.items() if len(v) == 1}
    c = F.lower(F.translate(c, "".join(single), "".join(single.values())))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in FOLDED.items() if len(v) > 1), c)


def loose_citations(c: Column) -> Column:
    """Citations ``P<n> p<page>`` anywhere in a text, brackets or not, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(_CITED), 0), lambda x: F.regexp_replace(x, r"\s+", " ")))


def failure_words(c: Column) -> Column:
    """The longer words of a failure text, folded, without citations."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)P\d+\s+p\d+", " "), "[^A-Za-z0-9 βµ-]+", " ")
    return F.filter(F.split(folded(bare), " +"), lambda w: F.length(w) >= LEAST)


def ordered_unique(c: Column) -> Column:
    """The texts of an array without blanks at their ends; empty ones and all but the first of equal ones go."""
    return F.array_distinct(F.filter(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != ""))


def _words(sentence: Column) -> Column:
    return F.split(folded(sentence), " ")


def _edge(first: Column, second: Column) -> Column:
    return F.concat(F.right(first, F.lit(EDGE)), F.lit(" "), F.left(second, F.lit(EDGE)))


def _neighbours(words: Column) -> Column:
    """struct(first, second) of each two neighbouring words that are long enough."""
    both = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.struct(w.alias("first"), F.get(words, i + 1).alias("second")))
    return F.array_distinct(F.filter(both, lambda p: (F.length(p["first"]) >= LEAST) & (F.length(p["second"]) >= LEAST)))


def _grams(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (EDGE - 1)), lambda i: F.substring(word, i, F.lit(EDGE))))


def named_sentences(sentences: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place of each sentence that a failure text names. sentences: keys, place, sentence; failures: keys, text."""
    words = failures.select(*keys, failure_words(F.col("text")).alias("w"))
    told = words.where(F.size("w") >= 2).select(*keys, F.explode(_neighbours(F.col("w"))).alias("t")).distinct()
    told = told.select(*keys, _edge(F.col("t.first"), F.col("t.second")).alias("edge"), "t")
    said = sentences.select(*keys, "place", F.explode(_neighbours(_words(F.col("sentence")))).alias("s"))
    said = said.select(*keys, "place", _edge(F.col("s.first"), F.col("s.second")).alias("edge"), "s")
    met = said.join(told, [*keys, "edge"]).where(F.col("s.first").endswith(F.col("t.first")) & F.col("s.second").startswith(F.col("t.second")))

    alone = words.where(F.size("w") == 1).select(*keys, F.get("w", 0).alias("word")).distinct()
    held = sentences.join(alone.select(*keys).distinct(), keys, "left_semi").select(*keys, "place", F.explode(F.array_distinct(_words(F.col("sentence")))).alias("token")).where(F.length("token") >= LEAST)
    index = held.select(*keys, "place", "token", F.explode(_grams(F.col("token"))).alias("gram"))
    often = index.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    probes = alone.select(*keys, "word", F.explode(_grams(F.col("word"))).alias("gram")).join(often, [*keys, "gram"], "left")
    # a word with a run that no sentence holds is in none
    rarest = probes.groupBy(*keys, "word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select(*keys, "word", F.col("r.gram").alias("gram"))
    single = index.join(rarest, [*keys, "gram"]).where(F.contains("token", "word"))
    return met.select(*keys, "place").unionByName(single.select(*keys, "place")).distinct()


def repair_context(drafts: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, failed_sentences, implicated (citations) of each draft. drafts: keys, draft, allowed (citations); failures: keys, ordinal, text.

    The failed sentences are those that a failure text names (level ``terms``), else those that share a citation with one
    (``citations``, may be none), else the first two (``opening``). Implicated are the citations of the failure texts and of
    these sentences, or of the whole draft if neither has any, as far as they are allowed.
    """
    fails = failures.select(*keys, "ordinal", F.trim("text").alias("text")).where(F.length("text") > 0)
    cut = drafts.select(*keys, "draft", "allowed", draft_sentences(F.coalesce("draft", F.lit(""))).alias("sentences"))
    each = cut.select(*keys, F.posexplode("sentences").alias("place", "sentence"))
    hits = named_sentences(each, fails, keys).groupBy(*keys).agg(F.collect_list("place").alias("hits"))
    cited = fails.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", loose_citations(F.col("text")).alias("c")))).alias("told"))
    row = cut.join(hits, keys, "left").join(cited, keys, "left").withColumns({"hits": F.coalesce("hits", F.array().cast("array<int>")), "cited": F.array_distinct(F.flatten(F.coalesce("told.c", F.array().cast("array<array<string>>")))), "allowed": F.coalesce("allowed", none())})
    shared = F.filter("sentences", lambda s: F.arrays_overlap(citations(s), F.col("cited")))
    named = F.filter("sentences", lambda s, i: F.array_contains("hits", i))
    level = F.when(F.size("hits") > 0, "terms").when(F.size("cited") > 0, "citations").otherwise("opening")
    chosen = F.when(F.size("hits") > 0, named).when(F.size("cited") > 0, shared).otherwise(F.slice("sentences", 1, 2))
    row = row.withColumns({"level": level, "failed_sentences": ordered_unique(chosen)})
    behind = F.array_distinct(F.concat("cited", F.flatten(F.transform("failed_sentences", loose_citations))))
    behind = F.when(F.size(behind) > 0, behind).otherwise(citations(F.coalesce("draft", F.lit(""))))
    return row.select(*keys, "level", "failed_sentences", F.filter(behind, lambda x: F.array_contains("allowed", x)).alias("implicated"))


def repair_rows(contexts: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, place, citations, text: evidence behind the implicated citations, in order.

    evidence: keys, ordinal, citations, text, table_rows (array of struct with citation and text). An entry with table rows
    for these citations gives these, else itself with those of its citations that are implicated.
    """
    met = evidence.join(contexts.select(*keys, "implicated"), keys).withColumn("own", F.array_intersect("citations", "implicated")).where(F.size("own") > 0)
    rows = F.filter(F.coalesce("table_rows", F.array()), lambda r: F.array_contains("implicated", r["citation"]))
    shown = F.transform(rows, lambda r: F.struct(F.array(r["citation"]).alias("citations"), r["text"].alias("text")))
    own = F.array(F.struct(F.col("own").alias("citations"), F.col("text").alias("text")))
    return met.select(*keys, "ordinal", F.posexplode(F.when(F.size(rows) > 0, shown).otherwise(own)).alias("place", "r")).select(*keys, "ordinal", "place", "r.citations", "r.text")
