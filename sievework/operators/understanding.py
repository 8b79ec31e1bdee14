"""Query understanding over tables of queries: senses of acronyms from a registry, topics from profiles.

Both are joins. Acronyms found in a query meet the registry by name. Topics are found by phrases: the runs of words of a
query meet the profiles' terms as equal texts, so no query is compared with every profile. Registries and profiles are
broadcast only if they are counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.planning import ACRONYMS, Sense
from ..functions.text import acronyms, contains_phrase, ngrams, normalize_phrase
from .report import STRINGS, none

#: Rows and bytes of a registry that are broadcast.
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20
REGISTRY = "acronym string, place int, meaning string, intent string, context array<string>, needs boolean, silent boolean"
#: The term lists of a profile; the first four decide whether it matches or is needed.
LISTS = ("match", "required", "core", "positive", "negative", "searches", "preferences")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows and bytes of text are within bounds."""
    size = sum((F.length(F.to_json(F.struct(F.col(f"`{c}`")))) for c in df.columns), F.lit(0))
    rows, wide = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and wide <= SMALL_BYTES else df


def registry_rows(table: dict[str, tuple[Sense, ...]] = ACRONYMS) -> list[tuple]:
    """A registry's rows for ``REGISTRY``."""
    return [(a, i, s.meaning, s.intent, list(s.context), s.needs, s.silent) for a, senses in table.items() for i, s in enumerate(senses)]


def detected(query: Column) -> Column:
    """The acronyms of a query in order, the first of those equal but for case."""
    found = acronyms(query)
    return F.filter(found, lambda a, i: ~F.exists(F.slice(found, 1, i), lambda b: F.upper(b) == F.upper(a)))


def acronym_senses(queries: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, acronym, meaning, intent, reason, rejected (other meanings) of each acronym in a query.

    queries: keys, query. A sense has a vote for each of its context phrases that stands in the query. Of several senses
    the most voted is taken, the earlier on a tie, and the first one without votes. A single one that needs context counts
    only with a vote. Silent senses are left out, and acronyms that have no others are not reported. Unknown and undecided
    acronyms stand for themselves.
    """
    asked = queries.select(*keys, normalize_phrase(F.coalesce("query", F.lit(""))).alias("said"), F.posexplode(detected(F.coalesce("query", F.lit("")))).alias("place", "token"))
    known = registry.select(F.upper("acronym").alias("name"), "acronym", F.struct("place", "meaning", "intent", "context", "needs", "silent").alias("sense"))
    senses = small(known.groupBy("name").agg(F.min("acronym").alias("acronym"), F.array_sort(F.collect_list("sense")).alias("senses")))
    met = asked.join(senses, F.upper("token") == F.col("name"), "left")
    loud = F.filter("senses", lambda s: ~F.coalesce(s["silent"], F.lit(False)))
    voted = F.transform("loud", lambda s: F.struct(F.size(F.filter(F.coalesce(s["context"], none()), lambda t: contains_phrase(F.col("said"), normalize_phrase(t)))).alias("votes"), (-s["place"]).alias("minus"), s["meaning"].alias("meaning"), s["intent"].alias("intent"), s["needs"].alias("needs")))
    met = met.withColumn("loud", loud).where(F.col("senses").isNull() | (F.size("loud") > 0)).withColumn("voted", voted)
    most = F.array_max("voted")
    single = F.get("voted", 0)
    lone = F.size("voted") == 1
    lost = F.col("senses").isNull() | (lone & F.coalesce(single["needs"], F.lit(False)) & (single["votes"] == 0))
    reason = F.when(lost, "unresolved_acronym").when(lone, F.when(F.coalesce(single["needs"], F.lit(False)), "context_match").otherwise("registry_single_sense")).when(most["votes"] > 0, "context_match").otherwise("registry_default")
    taken = F.when(~lost, F.when(lone | (most["votes"] == 0), single).otherwise(most))
    out = met.withColumns({"reason": reason, "taken": taken})
    rejected = F.when(F.col("taken").isNull(), none()).otherwise(F.filter(F.transform("voted", lambda s: s["meaning"]), lambda m: m != F.col("taken.meaning")))
    return out.select(*keys, "place", F.when(F.col("taken").isNull(), F.col("token")).otherwise(F.col("acronym")).alias("acronym"), F.coalesce("taken.meaning", "token").alias("meaning"), F.coalesce("taken.intent", F.lit("unknown")).alias("intent"), "reason", rejected.alias("rejected"))


def rendered(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expansions: the acronyms of a query with their meanings in one line."""
    one = F.struct("place", F.concat("acronym", F.lit("="), F.when(F.col("intent") == "unknown", "unresolved").otherwise(F.col("meaning"))).alias("t"))
    return resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("x")).select(*keys, F.array_join(F.col("x.t"), "; ").alias("expansions"))


def ordered_union(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys and ``values``: the values of each group in order, the first of those equal but for case and white space; empty ones go.

    An aggregate: the first place of each folded value, then the values by their places.
    """
    bare = rows.withColumn("_v", F.trim(F.regexp_replace(value, r"\s+", " "))).where("_v <> ''")
    first = bare.groupBy(*keys, F.lower("_v").alias("_f")).agg(F.min(F.struct(*order, "_v")).alias("_m"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_l")).select(*keys, F.col("_l._v").alias("values"))


def profile_matches(queries: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, profile_id, place, score, needed of each profile that a query matches.

    profiles: profile_id, place and the arrays of ``LISTS``. 4 points if all required terms stand in the query and there are
    some, 2 for each match term (core terms if none are given). Needed if a match or core term stands in it.
    """
    size = lambda c: F.size(F.coalesce(c, none()))
    own = profiles.select("profile_id", "place", *[F.coalesce(c, none()).alias(c) for c in ("match", "required", "core")])
    scored = F.when(size("match") > 0, F.col("match")).otherwise(F.col("core"))
    lists = [("scored", scored), ("required", F.col("required")), ("asked", F.concat("match", "core"))]
    terms = own.select("profile_id", "place", size("required").alias("wanted"), F.explode(F.array(*[F.struct(F.lit(n).alias("list"), c.alias("terms")) for n, c in lists])).alias("l")).select("profile_id", "place", "wanted", "l.list", F.explode("l.terms").alias("term"))
    terms = terms.withColumn("phrase", normalize_phrase(F.col("term"))).groupBy("phrase", "profile_id", "place", "wanted", "list").agg(F.count("*").alias("times")).where("phrase <> ''")
    longest = terms.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(0))).first()[0]
    words = F.split(normalize_phrase(F.coalesce("query", F.lit(""))), " ")
    runs = F.transform(F.array(words), lambda w: F.array_distinct(F.flatten(F.array(*[ngrams(w, n) for n in range(1, longest + 1)]))))[0] if longest else none()
    said = queries.select(*keys, F.explode(runs).alias("phrase"))
    hits = said.join(small(terms), "phrase").groupBy(*keys, "profile_id", "place", "wanted")
    n = lambda name: F.coalesce(F.sum(F.when(F.col("list") == name, F.col("times"))), F.lit(0))
    out = hits.agg(n("scored").alias("s"), n("required").alias("r"), n("asked").alias("a"))
    score = F.when((F.col("wanted") > 0) & (F.col("r") == F.col("wanted")), 4).otherwise(0) + 2 * F.col("s")
    return out.select(*keys, "profile_id", "place", score.cast("int").alias("score"), (F.col("a") > 0).alias("needed")).where("score > 0")


def topic_plans(queries: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, profile_id, domain, hint, needed and the lists of ``LISTS`` of each query: its matching profiles composed.

    profiles: as for ``profile_matches``, with domain and hint. Lists are ordered unions over the profiles by place, the
    query itself first among the searches. A query that matches none has the domain unknown and itself as its core term and search.
    """
    bare = queries.select(*keys, F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " ")).alias("query"))
    met = durable(profile_matches(bare, profiles, keys))  # read three times
    own = profiles.select("profile_id", F.nullif(F.col("domain"), F.lit("unknown")).alias("domain"), "hint", *LISTS)
    full = met.join(small(own), "profile_id")
    named = F.struct("place", "profile_id", "needed")
    heads = full.groupBy(*keys).agg(F.array_sort(F.collect_list(named)).alias("p"))
    lists = [F.struct(F.lit(c).alias("list"), F.coalesce(c, none()).alias("values")) for c in LISTS]
    lists += [F.struct(F.lit(c).alias("list"), F.array_compact(F.array(c)).cast(STRINGS).alias("values")) for c in ("domain", "hint")]
    values = full.select(*keys, "place", F.explode(F.array(*lists)).alias("l")).select(*keys, "place", "l.list", F.posexplode("l.values").alias("term_place", "value"))
    first = bare.join(met.select(*keys).distinct(), keys, "left_semi").select(*keys, F.lit(-1).alias("place"), F.lit("searches").alias("list"), F.lit(0).alias("term_place"), F.col("query").alias("value"))
    merged = ordered_union(values.unionByName(first), [*keys, "list"], "value", ["place", "term_place"])
    wide = merged.groupBy(*keys).pivot("list", [*LISTS, "domain", "hint"]).agg(F.first("values"))
    out = bare.join(heads, keys, "left").join(wide, keys, "left")
    alone, itself = F.col("p").isNull(), F.filter(F.array("query"), lambda q: q != "")
    some = {c: F.when(alone, itself if c in ("core", "searches") else none()).otherwise(F.coalesce(c, none())) for c in LISTS}
    return out.select(
        *keys, F.when(alone, "unknown").otherwise(F.concat(F.lit("composed."), F.array_join("p.profile_id", "+"))).alias("profile_id"), F.when(alone, "unknown").otherwise(F.array_join(F.coalesce("domain", none()), "+")).alias("domain"), F.when(F.size("hint") > 0, F.array_join("hint", "+")).alias("hint"),
        F.coalesce(F.transform(F.filter("p", lambda x: x["needed"]), lambda x: x["profile_id"]), none()).alias("needed"), *[v.alias(c) for c, v in some.items()],
    )
