"""The risk of a stratum holds for all its rules together, and copies of a text are one trial."""

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import quality

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def test_joint_rejection_keeps_the_risk(spark):
    high = (60, 4, 40, 300)  # beyond some cutoff of symbols, duplicate lines, repeats and capitals
    for share in (12, 3):  # good documents in 1,000 that fail each rule, none of them two rules
        rows = []
        for i in range(24_000):
            a, b, c, d = (v if i % 4 == 0 or (i // 4) % 1000 // share == k else 0 for k, v in enumerate(high))
            rows.append((i, 100, 500, a, b, c, 10, d))
        feats = spark.createDataFrame(rows, SCHEMA)
        labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(24_000)], "doc_id long, quality int")
        chosen = quality.cutoffs(feats, labels)
        good = feats.where("doc_id % 4 <> 0")
        rejected = good.where(~quality.verdict(chosen)).count() / good.count()
        assert rejected <= quality.RISK
        assert chosen


def test_copies_of_a_text_are_one_trial(spark):
    bad, good = " ".join(f"# w{k}" for k in range(80)), " ".join(f"w{k}" for k in range(80))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, bad).otherwise(good).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    feats = quality.features(docs)
    assert quality.cutoffs(feats, labels) == {}
    other = docs.withColumn("text", F.concat_ws(" ", "text", F.col("doc_id").cast("string")))
    assert quality.cutoffs(quality.features(other), labels.where("quality is not null")) != {}


def test_false_rejections_over_many_holdouts():
    """Were each step's true rate known: in at most 5 % of holdouts may the last step taken be beyond the risk, in any stratum."""
    rng = np.random.default_rng(7)
    rates = np.array([0.001, 0.006, 0.0205, 0.021, 0.04])  # of steps, from lenient to strict
    sizes = {0: 1100, 1: 1700, 2: 260}
    wrong = useful = 0
    for _ in range(2000):
        bad = False
        for s, level in quality.levels(sizes, quality.RISK, quality.ERROR).items():
            u = np.sort(rng.random(sizes[s]))
            k = quality.passed([int(np.searchsorted(u, r)) for r in rates], sizes[s], quality.RISK, level)
            bad |= k > 0 and rates[k - 1] > quality.RISK
            useful += k > 0
        wrong += bad
    assert wrong <= 0.05 * 2000 and useful > 3000


def test_levels_go_to_strata_that_can_pass():
    assert quality.levels({0: 203, 1: 300, 2: 203}, 0.02, 0.05) == {1: 0.05 / 3, 0: 0.05 / 3, 2: 0.05 / 3}
    assert quality.levels({0: 116, 1: 173, 2: 26}, 0.02, 0.05) == {1: 0.05} and quality.levels({0: 116, 1: 148, 2: 0}, 0.02, 0.05) == {}
    assert quality.levels({0: 190, 1: 190, 2: 20}, 0.02, 0.05) == {0: 0.025, 1: 0.025}


def test_steps_take_the_most_telling_first():
    rules = (quality.Rule("a", "x", (0.1, 0.2)), quality.Rule("b", "y", (0.1, 0.2)), quality.Rule("c", "z", (0.1,)))
    bad, other = {"a": [0.9, 0.5], "b": [0.8, 0.1], "c": [0.9]}, {"a": [0.5, 0.05], "b": [0.08, 0.01], "c": [0.9]}
    # a's second step and all of c cost more of good texts than they bring
    assert quality.steps(bad, other, 0.1, rules) == [("a", 0.2), ("b", 0.2), ("b", 0.1)]
    assert quality.steps({k: [0.0] * len(v) for k, v in bad.items()}, other, 0.1, rules) == []
