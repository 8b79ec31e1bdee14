"""Column functions over text: normalising, phrases, tokens, sentences, citations, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks a cut inside a text; texts do not hold it.
CUT = "\x01"


def settled(df: DataFrame, name: str, c: Column) -> DataFrame:
    """df with a costly column that is evaluated once a row: it comes out of an explode, so that filters on it and columns made of it don't evaluate it again."""
    return df.withColumn(name, c).withColumn(name, F.explode(F.array(name)))


def normalize_phrase(c: Column) -> Column:
    """Lower-case words of a-z and 0-9 with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def contains_phrase(normalized: Column, phrase: str | Column) -> Column:
    """Whether a normalised text holds a phrase as whole words."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))


def clean_markup(c: Column) -> Column:
    """Tags become blanks, white space single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"[ \t\n\r\f]+", " "))


def tokens(c: Column, stop: list[str] | None = None, least: int = 3) -> Column:
    """Distinct lower-case tokens of at least ``least`` characters, without stop words, in order of first occurrence."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    keep = lambda t: (F.length(t) >= least) & (~t.isin(stop) if stop else F.lit(True))
    return F.array_distinct(F.filter(found, keep))


def sentences(c: Column) -> Column:
    """Sentences, cut after . ! or ? and white space; trimmed, empty ones left out."""
    cut = F.split(F.regexp_replace(c, r"([.!?])[ \t\n\r\f]+", "$1" + CUT), CUT)
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks."""
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(words), runs)[0]  # the words are found once, not for each run


#: A citation inside a bracket group: ``P<n> p<page>``, or as readers see it, ``<n>, p. <page>``.
CITED = r"(?:P\d+\s+p\d+|\d+,?\s+[pP]\.?\s*\d+)"


def citations(c: Column) -> Column:
    """Distinct citation keys ``P<n> p<page>`` of bracket groups, in order; ``<n>, p. <page>`` is put in that form."""
    inner = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), 1), lambda g: F.split(g, ";")))
    short = r"^(\d+),? [pP]\.? ?(\d+)$"
    key = F.transform(inner, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), short, "P$1 p$2"))
    return F.array_distinct(F.filter(key, lambda x: x.rlike(r"^P\d+ p\d+$")))


def strip_citations(c: Column) -> Column:
    """The text without bracket groups that hold a citation."""
    return F.trim(F.regexp_replace(c, rf"\s*\[(?:[^\];]*;)*\s*{CITED}\s*(?:;[^\]]*)?\]", ""))


def sort_citations(c: Column) -> Column:
    """Citation keys by paper and page as numbers; malformed ones last, by text."""
    part = lambda x, i: F.coalesce(F.regexp_extract(x, r"^P(\d+)\s+p(\d+)$", i).try_cast("long"), F.lit(999999))
    return F.transform(F.array_sort(F.transform(c, lambda x: F.struct(part(x, 1).alias("a"), part(x, 2).alias("b"), x.alias("c")))), lambda x: x["c"])


def display_citations(c: Column) -> Column:
    """Citation keys as readers see them in one bracket, ``[1, p. 2; 3, p. 4]``; empty if there are none."""
    shown = F.transform(F.filter(F.array_distinct(c), lambda x: x.rlike(r"^P\d+\s+p\d+$")), lambda x: F.regexp_replace(x, r"^P(\d+)\s+p(\d+)$", "$1, p. $2"))
    return F.when(F.size(shown) > 0, F.concat(F.lit("["), F.array_join(shown, "; "), F.lit("]"))).otherwise("")


def normalize_doi(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^https?://(dx\.)?doi\.org/", ""), "(?i)^doi:", "")


def year(c: Column) -> Column:
    """The first year 1900 to 2099 that stands alone, or null."""
    return F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def trailing_id(c: Column) -> Column:
    """The last segment of a path."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def acronyms(c: Column) -> Column:
    """Distinct words of 2 to 8 letters and digits that hold two or more capitals, in order."""
    words = F.regexp_extract_all(c, F.lit(r"\b[A-Za-z][A-Za-z0-9]{1,7}\b"), 0)
    return F.array_distinct(F.filter(words, lambda w: F.length(F.regexp_replace(w, "[^A-Z]", "")) >= 2))


def stem(c: Column) -> Column:
    """ies becomes y; a final s of words over four letters goes."""
    return F.when(c.endswith("ies"), F.regexp_replace(c, "ies$", "y")).when((F.length(c) > 4) & c.endswith("s"), F.regexp_replace(c, "s$", "")).otherwise(c)


def slug(c: Column, mark: str = "-", default: str = "item") -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")
    return F.when((bare == "") | bare.isNull(), F.lit(default)).otherwise(bare)


def inverted_index_text(index: Column) -> Column:
    """The text of a map from word to its places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def string_list(c: Column) -> Column:
    """A JSON list of strings as an array: trimmed, without empty ones; anything else is an empty array."""
    got = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(got, lambda s: F.trim(s)), lambda x: F.coalesce(x != "", F.lit(False)))


def join_unique(c: Column) -> Column:
    """Array entries joined by '; ', the first of entries equal but for case."""
    seen = lambda acc, x: F.when(F.array_contains(F.transform(acc, F.lower), F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(c, F.array().cast("array<string>"), seen), "; ")
