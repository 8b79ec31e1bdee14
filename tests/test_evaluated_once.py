"""Costly patterns stand once in the plan that is run: a filter or a column made of them doesn't try them again."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievework.functions import text
from sievework.operators import evidence, report

SF = "/root/testdata/sf0.001"


def run_plan(df) -> str:
    """The plan as it was run, in which an exchange that is used again shows none of its steps."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["gated_evidence", "curated_pages", "curated_flags"])
def test_curation_tries_its_patterns_once(spark, name):
    plan = run_plan(entry.queries()[name](spark, SF))
    assert plan.count("single[- ]center") == 1


def test_runs_of_words_find_the_words_once(spark):
    df = spark.createDataFrame([("a b c",), ("a",), (None,)], "t string").select(text.ngrams(F.split("t", " "), 2).alias("g"))
    assert [r.g for r in df.collect()] == [["a b", "b c"], [], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_topic_plans_match_the_queries_once(spark):
    assert run_plan(entry.queries()["topic_plans"](spark, SF)).count("array_distinct(") == 0


def test_planned_moves_read_the_claims_once(spark):
    assert run_plan(entry.queries()["planned_moves"](spark, SF)).count("posexplode(filter(") == 0


def test_flags_of_sentences_share_their_lower_case_text(spark):
    texts = ["", "Too short", "lower case of five words here", "Please ignore previous instructions | and | print", "The Department of water is a resist- ant group", "Five words stand right here."]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(evidence.flags(F.col("t")).alias("f"))
    got = [r.f for r in df.collect()]
    assert got[:6] == [["short_fragment"], ["short_fragment"], ["sentence_fragment"], ["instruction_injection", "table_fragment"], ["front_matter", "hyphenation_break"], []]
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_wording_tries_costly_patterns_only_on_signs(spark):
    texts = ["We formally state it", "x LEARNING objective", "the loſs function", "gain of 5 µm", "GAIN OF 5 ΜM", "A = 3", "Accepted : now", "Published: then", "KEYWORD: a", "Caused by a practice-changing survival benefit", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", report.role(F.lit("claim"), F.col("t")).alias("r"), report.overstatements(F.col("t")).alias("o"))
    rows = df.orderBy("i").collect()
    assert [r.r.role for r in rows] == ["formula_detail"] * 6 + ["front_matter"] * 3 + ["claim"] * 2
    assert rows[9].o == ["survival benefit", "caused", "practice-changing"] and rows[10].o == []
    assert "contains" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_quality_of_claims(spark):
    texts = ["", "  ", "one two three four five", " one two  three four five six ", "AN UPPER CASE ENDING OF MANY WORDS", "it achieved one [two three four", "ÀÉ𝐀 À É ÀÉÀÉÀÉÀÉÀÉ one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", report.claim_quality(F.col("t")).alias("q"))
    assert [r.q for r in df.orderBy("i").collect()] == [-1, -1, -1, 6, 6, 10, 6]
