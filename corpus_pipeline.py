"""The corpus pipeline: toxicity, language, near duplicates, packing. Each stage works on all its predecessor kept.

Null, empty and repeated documents pass through as each operator's docstring says: texts without a letter have
no language and go with the second stage; of equal rows one stays in the third. Very long texts are read whole, an
empty table gives no pieces, and columns of any other name and type pass through the first three stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import langid, packing, simhash_groups, toxicity
from sievework.llm.common import discard, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't put at label 1."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.mark(docs, lexicon, keep_below=0.5)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is found with a score of at least one half."""
    return langid.keep(docs, langid.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash links and shingle minima, verified: five-word shingles alike at 0.8 or more."""
    return simhash_groups.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_language), ("near_copies", drop_near_copies), ("packing", pack_sequences)]

#: The stages learn models from the corpus, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's result is written as Parquet in the shared folder and read again, then deleted; the last one's stays for the caller."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        here = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            discard(spark, before)
        before = here
    return docs
