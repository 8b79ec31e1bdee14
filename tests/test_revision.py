"""Repair contexts and bounded revision: small cases worked by hand, and the index against plain containment."""

import random
import re

from pyspark.sql import functions as F

from sievework.operators import repair, revision

KEY = ["k"]
DRAFTS = "k string, draft string, allowed array<string>"
FAILS = "k string, ordinal int, text string"


def contexts(spark, drafts, fails):
    out = repair.repair_context(spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(fails, FAILS), KEY)
    return {r.k: (r.level, r.failed_sentences, r.implicated) for r in out.collect()}


def test_levels(spark):
    drafts = [
        ("a", "The model improved. Supermodel performance, high [P1 p2]. Bananas grow [P3 p4].", ["P1 p2"]), ("b", "One sentence here [P2 p3]. Two. Three.", ["P2 p3", "P3 p2"]), ("c", "# H\nAlpha. Beta. Gamma.", []), ("d", None, None), ("e", "A specialised thing. Other [P9 p9].", ["P9 p9"]),
        ("f", "Nothing cited here. Nor here.", ["P5 p5"]), ("g", "Same words stand here. Same words stand here. Else.", []), ("h", "", ["P1 p1"]), (None, "No key. At all. Here.", []), ("i", "Straßenbahn rides. Plain.", []),
    ]
    fails = [("a", 0, "the MODEL was performance high"), ("b", 1, "P3 p2"), ("b", 0, "see p2  P3? P2 p3"), ("c", 0, None), ("c", 1, "  "), ("e", 0, "the special"), ("f", 0, "P5  p5"), ("g", 0, "same words"), (None, 0, "no key"), ("i", 0, "ssenbahn rides"), ("gone", 0, "nobody asked")]
    got = contexts(spark, drafts, fails)
    assert got["a"] == ("terms", ["Supermodel performance, high [P1 p2]."], ["P1 p2"])
    assert got["b"] == ("citations", ["One sentence here [P2 p3]."], ["P2 p3", "P3 p2"])
    assert got["c"] == ("opening", ["Alpha.", "Beta."], []) and got["d"] == ("opening", [], []) and got["h"] == ("opening", [], [])
    assert got["e"] == ("terms", ["A specialised thing."], ["P9 p9"])
    assert got["f"] == ("citations", [], ["P5 p5"])
    assert got["g"] == ("terms", ["Same words stand here."], [])
    assert got[None] == ("opening", ["No key.", "At all."], []) and got["i"][:2] == ("terms", ["Straßenbahn rides."])
    assert "gone" not in got and len(got) == len(drafts)
    assert contexts(spark, [], fails) == {}


def test_index_finds_what_containment_finds(spark):
    rng, words = random.Random(3), ["model", "remodel", "models,", "able", "stable", "ables", "the", "perf-orm", "x", "ion", "station", "stations."]
    sentences = [("k%d" % (i % 3), i, " ".join(rng.choices(words, k=7))) for i in range(120)]
    fails = [("k%d" % (i % 3), " ".join(rng.choices([w.strip(".,") for w in words], k=rng.choice((1, 2, 3, 6))))) for i in range(30)]
    got = repair.named_sentences(spark.createDataFrame(sentences, "k string, place int, sentence string"), spark.createDataFrame(fails, "k string, text string"), KEY)
    want = set()
    for k, text in fails:
        w = [x for x in re.sub("[^A-Za-z0-9 -]+", " ", text).lower().split() if len(x) > 3]
        runs = [" ".join(w[i : i + n]) for n in (2, 3, 4, 5) for i in range(len(w) - n + 1)] if len(w) > 1 else w
        want |= {(k, p) for kk, p, s in sentences if kk == k and any(r in s for r in runs)}
    assert {(r.k, r.place) for r in got.collect()} == want and want


def test_rows_behind_citations(spark):
    c = spark.createDataFrame([("a", ["P1 p1", "P2 p2"]), ("b", [])], "k string, implicated array<string>")
    e = spark.createDataFrame([("a", 1, ["P1 p1", "P9 p9"], "one", None), ("a", 2, ["P2 p2"], "two", [("P2 p2", "x"), ("P9 p9", "y"), ("P1 p1", "z")]), ("a", 3, ["P9 p9"], "three", None), ("a", 4, None, "four", None), ("b", 1, ["P1 p1"], "none", None)], "k string, ordinal int, citations array<string>, text string, table_rows array<struct<citation:string,text:string>>")
    got = sorted((r.ordinal, r.place, r.citations, r.text) for r in repair.repair_rows(c, e, KEY).collect())
    assert got == [(1, 0, ["P1 p1"], "one"), (2, 0, ["P2 p2"], "x"), (2, 1, ["P1 p1"], "z")]


REJECT = '{"verdict": "fail", "summary": "Clinically validated is unsupported.", "unsupported_claims": ["clinically validated"]}'
GOOD, BAD = "The result reports AUROC 0.91 [P1 p2].", "The result was clinically validated [P1 p2]."


def drafts_of(spark, keys):
    return spark.createDataFrame([(k, BAD, ["Clinically validated is unsupported."], ["P1 p2"], []) for k in keys], "k string, draft string, failures array<string>, allowed array<string>, gaps array<string>")


def answers_of(spark, rows):
    return spark.createDataFrame(rows, "k string, attempt int, success boolean, text string, verifier_success boolean, verifier_text string")


def test_section_rounds(spark):
    drafts = drafts_of(spark, "abcdef")
    rows = [
        ("a", 1, True, GOOD, True, '{"verdict": "pass"}'), ("b", 1, True, BAD, True, REJECT), ("b", 2, True, GOOD, True, '{"verdict": "pass"}'), ("c", 1, False, None, None, None), ("c", 2, True, GOOD, True, '{"verdict": "pass"}'),
        ("d", 1, True, BAD, True, REJECT), ("d", 2, True, BAD, True, REJECT), ("d", 3, True, BAD, True, REJECT), ("d", 4, True, GOOD, True, '{"verdict": "pass"}'), ("e", 1, True, "Uncited words stand here.", True, '{"verdict": "pass"}'),
    ]
    asked = []

    def answer(open_, attempt):
        asked.append((attempt, sorted(r.k for r in open_.collect())))
        return revision.recorded(answers_of(spark, rows), KEY)(open_, attempt)

    out = revision.section_revisions(drafts, answer, KEY).cache()
    got = {(r.k, r.attempt): (r.last, r.status, r.reason, r.level) for r in out.collect()}
    assert asked == [(1, list("abcdef")), (2, ["b", "d"]), (3, ["d"])]
    assert got[("a", 1)] == (True, "pass", "revision_verified", "terms") and got[("b", 1)] == (False, "fallback", "revision_rejected", "terms") and got[("b", 2)][:3] == (True, "pass", "revision_verified")
    assert got[("c", 1)][:3] == (True, "fallback", "revision_not_trusted") and got[("e", 1)][:3] == got[("c", 1)][:3] and got[("f", 1)][:3] == got[("c", 1)][:3]
    assert got[("d", 3)][:3] == (True, "fallback", "revision_rejected") and len(got) == 9
    end = {r.k: (r.final, r.attempts) for r in revision.final_drafts(drafts, out, KEY).collect()}
    assert end == {"a": (GOOD, 1), "b": (GOOD, 2), "c": (BAD, 1), "d": (BAD, 3), "e": (BAD, 1), "f": (BAD, 1)}


def test_no_round_without_open_drafts(spark):
    drafts = drafts_of(spark, "a").where("k = 'none'")
    out = revision.section_revisions(drafts, revision.recorded(answers_of(spark, []), KEY), KEY)
    assert out.count() == 0
    assert [r.k for r in revision.final_drafts(drafts_of(spark, "a"), out, KEY).where(F.col("final") == BAD).collect()] == ["a"]


def test_report_rounds(spark):
    reports = spark.createDataFrame([(k, "old") for k in "abcde"], "k string, report string")
    schema = "k string, attempt int, success boolean, text string, citation string, prose_quality string, faithfulness string, plan_adherence string, semantic string, critic string"
    ok = ("pass",) * 4
    rows = [("a", 1, True, "new", *ok, "skipped", "pass"), ("b", 1, True, "one", *ok, None, "fallback"), ("b", 2, True, "two", *ok, "pass", None), ("c", 1, True, "bad", "pass", "fallback", "pass", "pass", "pass", "fallback"), ("c", 2, True, "good", *ok, "pass", "pass"), ("d", 1, True, " ", *ok, "pass", "pass"), ("e", 1, True, "x", *ok, "pass", "fallback"), ("e", 2, True, "y", *ok, "fallback", "pass")]
    out = revision.report_revisions(reports, revision.recorded(spark.createDataFrame(rows, schema), KEY), KEY)
    end = {r.k: (r.final, r.attempts, r.reason) for r in revision.final_drafts(reports, out, KEY, "report").collect()}
    assert end == {"a": ("new", 1, "revision_accepted"), "b": ("two", 2, "revision_accepted"), "c": ("old", 1, "revision_rejected"), "d": ("old", 1, "empty_revision"), "e": ("old", 2, "revision_rejected")}
