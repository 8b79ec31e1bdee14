"""Store operators over keyed tables: lookup, checked updates, counters, label events, pages, schema evolution, partitions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_per_key

#: The fields of a run that may be changed, and the columns that hold them.
RUN_FIELDS = {"batch_id": "batch_id", "status": "status", "limit": "limit_value", "deep_read_limit": "deep_read_limit", "min_relevance": "min_relevance", "auto_label_provider": "auto_label_provider", "llm_review_limit": "llm_review_limit", "screened_count": "screened_count", "blocked_count": "blocked_count", "allowed_count": "allowed_count", "deep_read_count": "deep_read_count", "error": "error"}
#: The counters of a run, the labels, and who sets them.
COUNTERS = ("screened_count", "blocked_count", "allowed_count", "deep_read_count")
LABELS, LABEL_SOURCES = ("relevant", "maybe", "irrelevant"), ("human", "agent")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; KeyError where there is none. The key reaches the scan as a filter."""
    found = df.where(F.col(key) == F.lit(value)).limit(1)
    if found.isEmpty():
        raise KeyError(f"unknown {key}: {value}")
    return found


def scan(df: DataFrame, condition: Column, order: list[Column]) -> DataFrame:
    """Rows under a condition in order, which is one of explicit columns."""
    return df.where(condition).orderBy(*order)


def with_zero_counters(rows: DataFrame, names: tuple[str, ...] = COUNTERS) -> DataFrame:
    """New rows as they enter the store: counters at zero."""
    return rows.withColumns({n: F.lit(0).cast("long") for n in names})


def update_fields(df: DataFrame, key: str, value, changes: Mapping[str, object], now: Column, allowed: Mapping[str, str] = RUN_FIELDS) -> DataFrame:
    """df with the named fields of one row changed, and its updated_at; without changes as it is.

    ValueError for a field outside ``allowed``, KeyError for an unknown key.
    """
    if unknown := sorted(set(changes) - set(allowed)):
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    lookup(df, key, value)
    if not changes:
        return df
    here = F.col(key) == F.lit(value)
    new = {allowed[f]: v if isinstance(v, Column) else F.lit(v) for f, v in changes.items()} | {"updated_at": now}
    return df.withColumns({c: F.when(here, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in new.items()})


def sync_counts(runs: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """runs with their batch's counters, zero without a batch; allowed is screened less blocked."""
    names = [c for c in COUNTERS if c != "allowed_count"]
    own = batches.select(key, *[F.col(c).alias(f"new_{c}") for c in names])
    joined = runs.drop(*COUNTERS).join(own, key, "left")
    out = joined.withColumns({c: F.coalesce(F.col(f"new_{c}"), F.lit(0)).cast("long") for c in names})
    return out.withColumn("allowed_count", F.col("screened_count") - F.col("blocked_count")).drop(*[f"new_{c}" for c in names])


def match_sources(wanted: DataFrame, items: DataFrame, order: list[str]) -> DataFrame:
    """wanted (source, normalized) with its item: the first by ``order`` whose source or normalized form is equal; none is left out.

    The disjunction is two equal joins, so neither compares all pairs.
    """
    named = items.select(*[F.col(c).alias(f"item_{c}") for c in items.columns])
    asked = wanted.withColumn("source", F.trim("source"))
    raw = asked.join(named, F.col("source") == F.col("item_source"))
    canon = asked.join(named, F.col("normalized") == F.col("item_normalized"))
    return first_per_key(raw.unionByName(canon), wanted.columns, [f"item_{c}" for c in order])


def label_errors() -> Column:
    """Why a label event is refused, or null; for columns label, label_source, confidence."""
    label, who = F.lower(F.trim("label")), F.lower(F.trim("label_source"))
    bad_confidence = F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)
    return F.when(label.isNull() | ~label.isin(*LABELS), "unknown_label").when(who.isNull() | ~who.isin(*LABEL_SOURCES), "unknown_label_source").when(bad_confidence, "confidence_out_of_range")


def apply_labels(events: DataFrame, keys: list[str]) -> DataFrame:
    """Labels after valid events (label, label_source, confidence, overwrite_human, at, ordinal), as if they came one by one.

    An event of an agent that may not overwrite a human label does nothing on one; else the last write wins.
    So the last human or overwriting event stands if it is human; else the last event of all does. The first
    event's time is created_at, the standing one's updated_at. Refused events take no part (``label_errors``).
    """
    fine = events.where(label_errors().isNull()).withColumns({"label": F.lower(F.trim("label")), "label_source": F.lower(F.trim("label_source"))})
    place = F.struct("at", "ordinal")
    row = F.struct("label", "label_source", "confidence", "at")
    strong = (F.col("label_source") == "human") | F.col("overwrite_human")
    both = fine.groupBy(*keys).agg(F.max_by(row, F.when(strong, place)).alias("s"), F.max_by(row, place).alias("l"), F.min("at").alias("created_at"))
    stands = F.when(F.col("s.label_source") == "human", F.col("s")).otherwise(F.col("l"))
    return both.select(*keys, "created_at", stands.alias("w")).select(*keys, "w.label", "w.label_source", "w.confidence", "created_at", F.col("w.at").alias("updated_at"))


def artifact_counts(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts and those stored, which are the deep reads."""
    return artifacts.groupBy(*keys).agg(F.count("*").alias("artifact_count"), F.count_if(F.col("status") == "stored").alias("deep_read_count"))


def number_pages(df: DataFrame, pages_col: str = "pages") -> DataFrame:
    """One row for each page: page_number from 1, text, char_count; a null page is empty."""
    rest = [c for c in df.columns if c != pages_col]
    rows = df.select(*rest, F.posexplode(pages_col).alias("p", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(*rest, (F.col("p") + 1).alias("page_number"), "text", F.char_length("text").alias("char_count"))


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes df over the partitions of its keys; other partitions stay."""
    df.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def evolve(df: DataFrame, columns: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """df in a newer schema: name -> (type, backfill). Missing columns come in; nulls get the backfill, which may read other columns."""
    out = df
    for name, (kind, fill) in columns.items():
        now = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, (F.coalesce(now, fill) if fill is not None else now).cast(kind))
    return out
