"""Store operators as set operations: first and last of a key, folds, appends, counters, replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.durable import durable


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the least by ``order``: an aggregate with a map-side part, so a hot key costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the greatest by ``order``: what a keyed upsert leaves."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def append_new(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to add: the first of each key in ``new`` that ``existing`` lacks."""
    return first_per_key(new, keys, order).join(existing.select(*keys), keys, "left_anti")


def latest(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def fold_labels(events: DataFrame, keys: list[str]) -> DataFrame:
    """Labels after events (columns label, label_source, at, ordinal): the last human one, else the last of an agent; created and updated times."""
    place = F.struct(F.when(F.col("label_source") == "human", 1).otherwise(0).alias("h"), "at", "ordinal")
    best = F.max_by(F.struct("label", "label_source", "at"), place)
    return events.groupBy(*keys).agg(best.alias("w"), F.min("at").alias("created_at"), F.count("*").alias("n_events")).select(*keys, "w.label", "w.label_source", "created_at", F.col("w.at").alias("updated_at"), "n_events")


def counters(items: DataFrame, keys: list[str], allowed: Column, deep: Column) -> DataFrame:
    """screened, blocked and deep-read counts, derived and never stored."""
    return items.groupBy(*keys).agg(F.count("*").alias("screened_count"), F.count_if(~allowed).alias("blocked_count"), F.count_if(allowed & deep).alias("deep_read_count"))


def replace_keys(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with all rows of the keys in ``new`` replaced by those of ``new``."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def require_parents(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child without a parent: empty where the reference holds."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def runs(df: DataFrame, group: str, order: list[str], label: str, name: str) -> DataFrame:
    """``name`` counts a group's runs of one label, from 1: a row whose label differs from the row's before begins a run. Null is a label.

    A group is one text, report or user: its rows are sorted in one task, which spills.
    """
    w = W.partitionBy(group).orderBy(*order)
    begins = F.when((F.row_number().over(w) == 1) | ~F.lag(label).over(w).eqNullSafe(F.col(label)), 1).otherwise(0)
    return df.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(w)).drop("__begins")


def carried(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``name`` holds the last value that is not null up to each row of its group; null before the first."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def out_of_order(df: DataFrame, group: str, order: list[str], place: str, name: str) -> DataFrame:
    """``name`` is true where a row's place is less than that of the row before it; false where one of them is null or there is none."""
    w = W.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.coalesce(F.col(place) < F.lag(place).over(w), F.lit(False)))


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with each row's place from 1 by ``order``, which must be unique: sorted ranges are stored, and each counts on from those before.

    No task sorts all rows, as it would under a window without partition. A row's place in its range is the low part of
    its id; the driver sees one count for each range.
    """
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    before, sums = 0, []
    for r in sorted(rows.groupBy("_part").count().collect()):
        sums.append((r[0], before))
        before += r[1]
    moved = df.sparkSession.createDataFrame(sums, "_part long, _before long")
    return rows.join(F.broadcast(moved), "_part").withColumn(name, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_id", "_part", "_before")
