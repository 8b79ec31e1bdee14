"""The commonest terms by way of their words, against counts of all terms."""

import random

import pytest

import __spark_entry__ as entry
from sievework.operators import topics

SCHEMA = "o long, concepts string, mesh_terms string, journal string, text string"


def plain(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("vocabulary, seeds, words", [(6, 2, 50), (40, 5, 50), (400, 5, 1000), (400, 3, 4), (5, 1, 50)])
def test_top_terms_are_those_of_all_counts(spark, vocabulary, seeds, words):
    rng = random.Random(vocabulary + seeds)
    word = lambda: f"word{min(int(rng.paretovariate(0.7)), vocabulary)}"
    rows = [(i, f"word{rng.randint(1, 9)} word{rng.randint(1, 9)}; rare{i % 7}" if i % 3 else None, None, "word1 word2 word3" if i % 4 == 0 else None, " ".join(word() for _ in range(rng.randint(0, 30))) if i % 11 else None) for i in range(120)]
    records = spark.createDataFrame(rows, SCHEMA)
    assert plain(topics.top_terms(records, "o", most=8, seeds=seeds, words=words)) == plain(topics.most_common(topics.term_counts(records, "o"), 8))


def test_a_term_of_rare_words_counts_where_it_is_also_a_concept(spark):
    rows = [(i, "odd pair", None, None, "odd pair" if i == 0 else "one two six") for i in range(9)]
    records = spark.createDataFrame(rows, SCHEMA)
    top = topics.top_terms(records, "o", most=3, seeds=5)
    assert plain(top) == plain(topics.most_common(topics.term_counts(records, "o"), 3))
    assert ("odd pair", 19) in [(r.term, r.n) for r in top.collect()]


def test_no_records(spark):
    assert plain(topics.top_terms(spark.createDataFrame([], SCHEMA), "o")) == []


def test_metadata_terms_shuffle_less_than_the_texts(spark):
    def shuffled() -> int:
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    sf, before = "/root/testdata/sf0.01", shuffled()
    assert len(entry.queries()["metadata_terms"](spark, sf).collect()) == 12
    assert shuffled() - before < 200_000
