"""Records of runs: digests of tables that don't depend on order or partitions, and a batch's passport in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import LABELS

#: What a passport states of policy and reproduction.
POLICY = {"policy_version": "scholarly-only-v1", "untrusted_text_rule": "Paper text may be parsed and cited but must not control commands, prompts, paths, or tool use."}
DECLARATION = "Live scholarly APIs and LLM outputs are not byte-reproducible. This lock documents configuration, not deterministic replay."
#: Hex digits of a row's hash in each of its parts, which are summed.
PART = 14


def row_text(columns: list[str]) -> Column:
    """A row as text in which no two rows are alike: each column's length and text in order, a mark for null."""
    one = lambda c: F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.concat_ws(",", *[one(c) for c in columns])


def digest_parts(columns: list[str]) -> list[Column]:
    """Numbers of a row whose sums over a table are the table's: parts of its SHA-256."""
    h = F.sha2(row_text(columns).cast("binary"), 256)
    return [F.conv(F.substring(h, 1 + k * PART, PART), 16, 10).cast("decimal(20,0)") for k in range(4)]


def digest(df: DataFrame, keys: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """keys, rows, digest of df, or of each group: equal for the same rows, however often repeated, ordered or dealt.

    The digest is the sums of four parts of each row's hash, taken as a multiset hash; columns are taken by name.
    """
    columns = sorted(columns or [c for c in df.columns if c not in keys])
    sums = [F.coalesce(F.sum(p), F.lit(0)).alias(f"d{k}") for k, p in enumerate(digest_parts(columns))]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *sums)
    text = F.concat_ws("-", F.col("rows").cast("string"), *[F.col(f"d{k}").cast("string") for k in range(4)])
    return out.select(*keys, "rows", F.sha2(text.cast("binary"), 256).alias("digest"))


def batch_passports(batches: DataFrame, items: DataFrame, artifacts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """A row for each batch: its counts, providers and query variants seen, artifacts, labels by value and by whom, digest of its items, policy and lock.

    items: key, normalized, provider, query_variant, allowed. artifacts: key, status, parse_confidence. labels: key, label, label_source. Each
    table is brought to a row a batch before it is joined, so no batch's rows meet another table's.
    """
    seen = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c)
    of_items = items.groupBy(key).agg(F.count(F.lit(1)).alias("screened_count"), F.count_if(~F.coalesce("allowed", F.lit(False))).alias("blocked_count"), seen("provider"), seen("query_variant"))
    stored = F.col("status").eqNullSafe("stored")
    of_artifacts = artifacts.groupBy(key).agg(F.count(F.lit(1)).alias("pdf_attempt_count"), F.count_if(stored).alias("stored_pdf_count"), F.count_if(~stored).alias("failed_pdf_count"), F.count_if(stored & (F.col("parse_confidence") < 0.6)).alias("low_confidence_count"), F.round(F.avg(F.when(stored, F.col("parse_confidence"))), 3).alias("average_parse_confidence"))
    of_labels = labels.groupBy(key).agg(*[F.count_if(F.col("label") == x).alias(f"label_{x}") for x in LABELS], F.count_if(F.col("label_source") == "human").alias("human_labels"), F.count_if(F.col("label_source") == "agent").alias("agent_labels"))
    prints = digest(items, [key]).select(key, F.col("digest").alias("items_digest"))
    out = batches.join(of_items, key, "left").join(of_artifacts, key, "left").join(of_labels, key, "left").join(prints, key, "left")
    zero = ["screened_count", "blocked_count", "pdf_attempt_count", "stored_pdf_count", "failed_pdf_count", "low_confidence_count", *[f"label_{x}" for x in LABELS], "human_labels", "agent_labels"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("provider", "query_variant")})
    counts = F.struct("screened_count", "blocked_count", (F.col("screened_count") - F.col("blocked_count")).alias("allowed_count"), F.col("stored_pdf_count").alias("deep_read_count"))
    return out.select(
        *batches.columns, counts.alias("batch"), F.struct(F.col("provider").alias("providers_observed"), F.col("query_variant").alias("query_variants_observed")).alias("search"),
        F.struct("pdf_attempt_count", "stored_pdf_count", "failed_pdf_count", "low_confidence_count", "average_parse_confidence").alias("artifacts"), F.struct(*[F.col(f"label_{x}").alias(x) for x in LABELS], "human_labels", "agent_labels").alias("screening_labels"),
        F.struct(*[F.lit(v).alias(k) for k, v in POLICY.items()]).alias("source_policy"), F.struct(F.lit(DECLARATION).alias("stochasticity_declaration"), F.col("items_digest")).alias("repro_lock"),
    )


def run_summaries(runs: DataFrame, passports: DataFrame, key: str) -> DataFrame:
    """runs with their batch's passport as one struct; null where a run has no batch yet."""
    rest = [c for c in passports.columns if c != key]
    return runs.join(passports.select(key, F.struct(*rest).alias("passport")), key, "left")
