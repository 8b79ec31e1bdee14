"""The registered queries of the training-data operators: thin layers that derive digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, license, linededup, packing, piece_codec, quality, resampling, sharding, simhash, spelling, tokencount, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_edits(text) -> object:
    """Three edits of every text: an insertion in its middle, a cut at a third, a replacement at three quarters."""
    n = F.length(F.coalesce(text, F.lit("")))
    one = lambda a, b, new: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"), F.lit(new).alias("new"))
    return F.array(one(F.floor(n / 2), F.floor(n / 2), " (edited in 2024) "), one(F.floor(n / 3), F.floor(n / 3) + 12, ""), one(F.floor(3 * n / 4), F.floor(3 * n / 4) + 5, "it's\n new"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", sample_edits(F.col("text")))
    return tokencount.count_edited(docs, "edits")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learn(docs))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(_table(spark, sf_dir, "documents"), digests=True)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_packing, op4_quality, op5_sharding, op6_toxicity, op7_topk, op8_language, op9_license, op10_pieces, op11_spelling, op12_resampling, op13_lines)}


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the whole result; the other queries are tested against brute force."""
    return {"op7_topk": TOPK_SQL, "op13_lines": LINES_SQL}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM d)),
f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
p AS (SELECT r, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (f.key IS NULL), '') AS kept FROM l LEFT JOIN f ON l.key = f.key GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN p USING (r)
"""
