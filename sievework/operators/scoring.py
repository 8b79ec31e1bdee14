"""Weighted-term relevance, labels and review scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import contains_phrase

LABELS = ("relevant", "maybe", "irrelevant")


def weighted_hits(normalized: Column, terms: dict[str, int]) -> Column:
    """Summed weights of the phrases that a normalised text holds."""
    return reduce(lambda a, b: a + b, [F.when(contains_phrase(normalized, t), w).otherwise(0) for t, w in terms.items()], F.lit(0))


def relevance(normalized: Column, provider: Column, terms: dict[str, int], bonus: dict[str, int], negative: dict[str, int] | None = None, base: int = 5) -> Column:
    """base + provider bonus + hits, less up to 80 (hits + 18) for negative terms where nothing else hits; within 0 and 100."""
    hits = weighted_hits(normalized, terms)
    score = F.lit(base) + reduce(lambda a, b: a.when(provider == b[0], b[1]), list(bonus.items())[1:], F.when(provider == next(iter(bonus)), next(iter(bonus.values())))).otherwise(0) + hits
    if negative:
        wrong = weighted_hits(normalized, negative)
        score = score - F.when((hits == 0) & (wrong > 0), F.least(F.lit(80), wrong + 18)).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def auto_label(overlap: Column, score: Column) -> Column:
    """struct(label, confidence) by the default rule: token overlap with the query, and relevance."""
    rel = (overlap >= 3) | (score >= 65)
    maybe = (overlap >= 2) | ((overlap >= 1) & (score >= 15)) | (score >= 25)
    conf = F.when(rel, F.least(F.lit(0.95), 0.62 + 0.08 * overlap + score / 250)).when(maybe, F.least(F.lit(0.8), 0.55 + 0.07 * overlap + score / 300)).otherwise(F.least(F.lit(0.9), 0.68 + F.greatest(F.lit(0), 25 - score) / 200))
    return F.struct(F.when(rel, "relevant").when(maybe, "maybe").otherwise("irrelevant").alias("label"), F.round(conf, 3).alias("confidence"))


def review_score(label: Column, score: Column, confidence: Column) -> Column:
    """How much a model should look again: doubtful, contradictory and missing labels first."""
    extra = F.when(label == "maybe", 120).when((label == "irrelevant") & (score >= 40), 110).when(label.isNull(), 80).when((label == "relevant") & (confidence < 0.75), 70).otherwise(5)
    return (score + extra + F.when(confidence < 0.7, 30).otherwise(0)).cast("int")


def diversify(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows by ``order``, one of each key before any second one; rank from 1.

    Only the best of each key and the best k of all can be taken. The first are cut to one row a key before the
    shuffle, and a key among the best k of all has its own best there, so the rest are known without another look.
    """
    own = F.row_number().over(W.partitionBy(key).orderBy(*order))
    best = df.withColumn("own", own).where("own = 1").orderBy(*order).limit(k)
    rest = df.orderBy(*order).limit(k).withColumn("own", own).where("own > 1")
    every = best.unionByName(rest).withColumn("again", F.when(F.col("own") == 1, 0).otherwise(1)).drop("own")
    return every.orderBy("again", *order).limit(k).withColumn("rank", F.row_number().over(W.orderBy("again", *order))).drop("again")


def confusion(df: DataFrame, human: str, agent: str) -> DataFrame:
    """One row for each human label with a count for each agent label, zeros filled."""
    counts = df.groupBy(F.col(human).alias("human")).agg(*[F.count_if(F.col(agent) == x).alias(x) for x in LABELS])
    choices = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("human"))
    return choices.join(counts, "human", "left").na.fill(0, list(LABELS))


def precision_recall(df: DataFrame, human: str, agent: str) -> DataFrame:
    """Of each label: precision and recall, 0 where the denominator is; rounded to 6 digits."""
    agg = df.agg(*[f(x).alias(f"{n}_{x}") for x in LABELS for n, f in (("hit", lambda x: F.count_if((F.col(human) == x) & (F.col(agent) == x))), ("agent", lambda x: F.count_if(F.col(agent) == x)), ("human", lambda x: F.count_if(F.col(human) == x)))])
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    rows = F.array(*[F.struct(F.lit(x).alias("label"), rate(f"hit_{x}", f"agent_{x}").alias("precision"), rate(f"hit_{x}", f"human_{x}").alias("recall")) for x in LABELS])
    return agg.select(F.explode(rows).alias("r")).select("r.*")
