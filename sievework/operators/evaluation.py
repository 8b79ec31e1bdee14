"""Label evaluation, review rows, label export, run counts, attention lists and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .relational import ranked

#: The columns of a label export, in order.
EXPORT_FIELDS = (
    "schema_version", "batch_id", "batch_mode", "query", "batch_limit", "batch_created_at", "source", "normalized", "allowed", "source_reason", "source_domain",
    "provider", "title", "abstract", "doi", "pmid", "pmcid", "arxiv_id", "year", "url", "journal", "concepts", "mesh_terms", "oa_status", "open_access_pdf_url",
    "relevance_score", "relevance_reason", "query_variant", "query_intent", "acronym_expansions", "label", "label_source", "gold_label", "weak_label",
    "label_confidence", "label_rationale", "label_signals", "label_note", "label_created_at", "label_updated_at", "review_queue_rank", "review_queue_score", "review_queue_reason",
)
#: The confidence of a grave mistake, the score of an item that should have a label, the place of an item outside the queue.
GRAVE, HIGH_RELEVANCE, NO_RANK = 0.85, 60, 999_999


def accuracy(comparable: DataFrame, human: str = "human", agent: str = "agent") -> DataFrame:
    """comparable_count, correct_count and accuracy of rows with both labels; 0 without any."""
    both = comparable.where(F.col(human).isNotNull() & F.col(agent).isNotNull())
    counts = both.agg(F.count("*").alias("comparable_count"), F.count_if(F.col(human) == F.col(agent)).alias("correct_count"))
    return counts.withColumn("accuracy", F.coalesce(F.try_divide("correct_count", "comparable_count"), F.lit(0.0)))


def mistakes(comparable: DataFrame, human: str = "human", agent: str = "agent", confidence: str = "confidence", source: str = "source", limit: int | None = None) -> DataFrame:
    """Rows whose labels differ, the surest first (null last), with grave for those at or over ``GRAVE``; at most ``limit``."""
    rows = comparable.where(F.col(human) != F.col(agent)).withColumn("grave", F.coalesce(F.col(confidence) >= GRAVE, F.lit(False)))
    rows = rows.orderBy(F.desc(F.coalesce(F.col(confidence), F.lit(-1.0))), source)
    return rows if limit is None else rows.limit(limit)


def with_labels(items: DataFrame, labels: DataFrame, key: str = "normalized") -> DataFrame:
    """Items with their label columns, label_source being unlabeled where there is none."""
    return items.join(labels, key, "left").withColumn("label_source", F.coalesce("label_source", F.lit("unlabeled")))


def review_rows(items: DataFrame, labels: DataFrame, queue: DataFrame, only: str | None = None, min_relevance: int = 0, limit: int = 50, key: str = "normalized") -> DataFrame:
    """Allowed items in the order of review, position from 1: the queue's by rank, then agents' labels, unlabeled, humans', others; by title, source.

    items: key, source, title, allowed, relevance_score. labels: key, label, label_source. queue: key, review_queue_rank.
    only: a label source (human, agent, unlabeled) or a label.
    """
    rows = with_labels(items.where("allowed").withColumns({"title": F.coalesce("title", "source"), "relevance_score": F.coalesce("relevance_score", F.lit(0))}).where(F.col("relevance_score") >= min_relevance), labels, key)
    if only is not None:
        wanted = only.strip().lower()
        rows = rows.where(F.col("label_source" if wanted in ("human", "agent", "unlabeled") else "label") == wanted)
    rows = rows.join(queue, key, "left")
    bucket = F.when(F.col("label_source") == "agent", 0).when(F.col("label_source") == "unlabeled", 1).when(F.col("label_source") == "human", 2).otherwise(3)
    order = [F.col("review_queue_rank").isNull(), F.coalesce("review_queue_rank", F.lit(NO_RANK)), bucket, F.lower("title"), F.col("source")]
    top = rows.orderBy(*order).limit(max(0, limit))
    return top.withColumn("position", F.row_number().over(W.orderBy(*order)))


def export_rows(batches: DataFrame, items: DataFrame, labels: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of ``EXPORT_FIELDS`` for each label whose item is known; columns that no table has are null.

    A human's label is the gold label, an agent's the weak one. Tables share batch_id and normalized; batches
    has mode, limit_value and created_at; labels has confidence, rationale, signals, note, created_at, updated_at.
    """
    b = batches.select("batch_id", *[F.col(c).alias(n) for c, n in (("mode", "batch_mode"), ("query", "query"), ("limit_value", "batch_limit"), ("created_at", "batch_created_at")) if c in batches.columns])
    names = {"confidence": "label_confidence", "rationale": "label_rationale", "signals": "label_signals", "note": "label_note", "created_at": "label_created_at", "updated_at": "label_updated_at"}
    own = labels.select("batch_id", "normalized", "label", "label_source", *[F.col(c).alias(n) for c, n in names.items() if c in labels.columns])
    known = items.withColumnsRenamed({"reason": "source_reason", "domain": "source_domain"}).drop("created_at")
    rows = own.join(known, ["batch_id", "normalized"]).join(b, "batch_id").join(queue, ["batch_id", "normalized"], "left")
    rows = rows.withColumns({"schema_version": F.lit("1.0"), "gold_label": F.when(F.col("label_source") == "human", F.col("label")), "weak_label": F.when(F.col("label_source") == "agent", F.col("label"))})
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EXPORT_FIELDS])


def write_export(rows: DataFrame, path: str, kind: str = "jsonl") -> None:
    """JSON lines with keys in order and nulls kept, or CSV with a header."""
    if kind == "jsonl":
        rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").csv(path)
    else:
        raise ValueError(f"unknown kind of export: {kind}")


def run_counts(items: DataFrame, labels: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The 14 counts of a run in one row; each table is read once.

    items: normalized, allowed. labels: normalized, label_source. artifacts: status. evidence: quality_label, trust_label, reportable.
    """
    named = labels.select("normalized").distinct().withColumn("has", F.lit(True))
    i = items.join(named, "normalized", "left").agg(F.count("*").alias("screened"), F.count_if(~F.col("allowed")).alias("blocked"), F.count_if("allowed").alias("allowed"), F.count_if(F.col("allowed") & F.col("has").isNull()).alias("unlabeled_allowed"))
    n = labels.agg(F.count("*").alias("labeled"), F.count_if(F.col("label_source") == "human").alias("human_labels"), F.count_if(F.col("label_source") == "agent").alias("agent_labels"))
    a = artifacts.agg(F.count_if(F.col("status") == "stored").alias("stored_pdfs"), F.count_if(F.col("status") != "stored").alias("failed_pdfs"))
    clean = (F.col("quality_label") == "clean") & F.col("reportable")
    e = evidence.agg(F.count_if(clean).alias("evidence_items"), F.count_if(~clean).alias("blocked_evidence_items"), F.count_if(clean & (F.col("trust_label") == "trusted")).alias("trusted_evidence_items"), F.count_if(F.col("trust_label") == "review").alias("review_evidence_items"), F.count_if(F.col("trust_label") == "quarantined").alias("quarantined_evidence_items"))
    one = F.lit(1).alias("one")
    out = i.withColumn("one", F.lit(1))
    for other in (n, a, e):
        out = out.join(other.select("*", one), "one")
    return out.drop("one")


def high_relevance_unlabeled(items: DataFrame, labels: DataFrame, least: int = HIGH_RELEVANCE, limit: int = 10, key: str = "normalized") -> DataFrame:
    """Allowed items without a label and a relevance of ``least`` or more: the highest first, then by source."""
    rows = items.where(F.col("allowed") & (F.col("relevance_score") >= least)).join(labels.select(key).distinct(), key, "left_anti")
    return rows.orderBy(F.desc("relevance_score"), "source").limit(limit)


def attention(items: DataFrame, labels: DataFrame, artifacts: DataFrame, comparable: DataFrame, rejected: DataFrame, limit: int = 10, key: str = "normalized") -> dict[str, DataFrame]:
    """The lists that need a look, each of at most ``limit`` rows in an explicit order."""
    wrong = mistakes(comparable)
    return {
        "label_disagreements": wrong.limit(limit),
        "high_confidence_mistakes": wrong.where("grave").limit(limit),
        "maybe_labels": labels.where("label = 'maybe'").orderBy(key).limit(limit),
        "high_relevance_unlabeled": high_relevance_unlabeled(items, labels, limit=limit, key=key),
        "failed_pdfs": artifacts.where("status <> 'stored'").orderBy("source").limit(limit),
        "source_gate_blocks": rejected.where("stage = 'source_gate'").orderBy("source").limit(limit),
    }


def parser_quality(artifacts: DataFrame) -> DataFrame:
    """Attempts (with a parser), stored ones and those of low confidence: under 0.6, or flagged so."""
    low = (F.col("parse_confidence") < 0.6) | F.array_contains("parse_flags", "low_confidence")
    tried = artifacts.where(F.coalesce(F.col("parser_name"), F.lit("")) != "")
    return tried.agg(F.count("*").alias("parser_attempt_count"), F.count_if(F.col("status") == "stored").alias("stored_pdf_count"), F.count_if(F.coalesce(low, F.lit(False))).alias("low_confidence_count"))


def distinct_sorted(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of small vocabularies, sorted, joined by a bar; null and empty ones out."""
    return df.agg(*[F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|").alias(c) for c in columns])


def topic_counts(curated: DataFrame) -> DataFrame:
    """status and number of rows, eligible and blocked ones."""
    return curated.groupBy("status").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("blocked"))


def suite_totals(results: DataFrame, passed: str = "passed") -> DataFrame:
    """total, passed, failed and pass_rate rounded to 3 digits, 0 without cases."""
    out = results.agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"))
    return out.withColumns({"failed": F.col("total") - F.col("passed"), "pass_rate": F.round(F.coalesce(F.try_divide("passed", "total"), F.lit(0.0)), 3)})


def coverage(items: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """screened, allowed, blocked and stored of each batch."""
    own = items.groupBy(*keys).agg(F.count("*").alias("screened"), F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))
    stored = artifacts.where("status = 'stored'").groupBy(*keys).agg(F.count("*").alias("stored_pdfs"))
    return own.join(stored, keys, "left").na.fill(0, ["stored_pdfs"])


def preview(evidence: DataFrame, keys: list[str], order: list[Column], per_type: int = 2, most: int = 12) -> DataFrame:
    """Trusted evidence of each key: at most ``per_type`` of a type in order, then at most ``most`` in all; place from 1."""
    first = F.row_number().over(W.partitionBy(*keys, "evidence_type").orderBy(*order))
    some = evidence.where("trust_label = 'trusted'").withColumn("k", first).where(F.col("k") <= per_type).drop("k")
    return some.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def report_claims(claims: DataFrame, order: list[Column], most: int = 6) -> DataFrame:
    """The claims of the highest quality, equal ones in order; a negative or null quality stays out."""
    return claims.where(F.col("quality_score") >= 0).orderBy(F.desc("quality_score"), *order).limit(most)


def evidence_gaps(stored: int, screened: int, failed: int, blocked: int, low_trust: int, limitations: int) -> list[str]:
    """What a cited report says is missing, from counted figures."""
    out = [f"Deep-read coverage: {stored} of {screened} screened records produced stored PDFs."]
    out += [f"PDF failures: {failed} blocked or failed PDF attempts."] * bool(failed)
    out += [f"Evidence quality gate blocked {blocked} extracted fragments."] * bool(blocked)
    out += [f"Evidence trust gate withheld {low_trust} low-trust extracted fragments."] * bool(low_trust)
    return out + ["No extracted limitation evidence found."] * (not limitations)


def cited_evidence(artifacts: DataFrame, items: DataFrame, evidence: DataFrame, order: list[Column]) -> DataFrame:
    """Trusted evidence of stored artifacts with the paper's label (P1, P2, ... by ``order``), its item's title and citation."""
    stored = ranked(artifacts.where("status = 'stored'"), order, "paper").select("artifact_id", "source", F.concat(F.lit("P"), F.col("paper").cast("string")).alias("paper"))
    papers = stored.join(items.select("source", "title"), "source", "left")
    return evidence.where("trust_label = 'trusted'").join(papers, "artifact_id").withColumn("citation", F.concat("paper", F.lit(" p"), "page_number"))
