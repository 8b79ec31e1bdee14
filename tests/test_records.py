"""Corpus checks, evidence plans and records of runs: small cases worked by hand."""

import json

from pyspark.sql import functions as F

from sievework.operators import constraints, evidence_plan, records

GOOD = {"case_id": "gold.a", "type": "ranking", "description": "x", "expected": {}}


def test_first_broken_rule_of_each_case(spark):
    change = lambda **k: json.dumps(GOOD | k)
    cases = {
        "0": (json.dumps(GOOD), None), "1": (change(case_id="gold.a", type="none"), "duplicate_case_id"), "2": ("{", "unreadable"), "3": (None, "unreadable"), "4": ("[]", "not_an_object"), "5": ("null", "not_an_object"), "6": (change(case_id=5), "bad_case_id"), "7": (change(case_id="other.a"), "bad_case_id"),
        "8": (change(case_id="gold.b", type="none"), "unsupported_type"), "9": (change(case_id="gold.b"), "duplicate_case_id"), "10": (change(case_id="gold.c", description=" \n"), "no_description"), "11": (change(case_id="gold.d", description=None), "no_description"), "12": (change(case_id="gold.e", expected=[]), "no_expected"), "13": ('{"case_id": "gold.f", "type": "ranking", "description": "d"}', "no_expected"), "14": ("{}", "bad_case_id"), "15": (change(case_id="gold.g", type=["ranking"]), "unsupported_type"),
    }
    df = spark.createDataFrame([(int(k), v[0]) for k, v in cases.items()], "place int, json string")
    got = {r.place: r.rule for r in constraints.violations(df, "gold.", ["place"]).collect()}
    assert got == {int(k): v[1] for k, v in cases.items() if v[1]}
    own = (constraints.Rule("short", lambda v: F.length(F.try_variant_get(v, "$.description", "string")) > 1),)
    assert {r.rule for r in constraints.violations(df.where("place = 0"), "gold.", ["place"], own).collect()} == {"short"}
    assert constraints.violations(df.where("false"), "gold.", ["place"]).count() == 0


def test_corpus_files(spark, tmp_path):
    files = {"a.json": json.dumps({"schema_version": "1.0", "cases": [GOOD, "x", None]}), "b.json": json.dumps({"schema_version": "1.0", "cases": [GOOD]}, indent=1), "c.json": "{", "d.json": '{"schema_version": 1.0, "cases": []}', "e.json": '{"schema_version": "1.0", "cases": {}}', "f.json": '{"schema_version": "1.0", "cases": []}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    cases, bad = constraints.read_corpus(spark, str(tmp_path))
    short = lambda f: f.rsplit("/", 1)[-1]
    assert {(short(r.file), r.rule) for r in bad.collect()} == {("c.json", "unreadable_file"), ("d.json", "bad_schema_version"), ("e.json", "no_cases")}
    got = {(short(r.file), r.place, r.rule) for r in constraints.violations(cases, "gold.", ["file", "place"]).collect()}
    assert got == {("a.json", 1, "not_an_object"), ("a.json", 2, "not_an_object"), ("b.json", 0, "duplicate_case_id")}


ROWS = "k string, section string, ordinal int, row_id string, `table` string, citation string, text string, evidence_type string, trust_label string"


def test_evidence_plan(spark):
    rows = [
        ("r", "results", 1, "E1", "results", "P1 p1", "plain", "result", "trusted"), ("r", "results", 2, None, None, "P2 p1", "formally given", "result", None), ("r", "results", 3, "E3", "methods", "P3 p1", "plain", "method", ""), ("r", "results", 4, "E4", "", "P3 p1", "plain", "method", ""), ("r", "results", 5, "E5", "results", " ", "plain", "result", "trusted"),
        ("r", "results", 6, "E6", "results", "P6 p1", None, "result", "trusted"), ("r", "results", 7, "E7", "results", "P7 p1", "plain", "result", "suspect"), ("r", "results", 8, "", "results", "P1 p1", "Keywords: x", "odd", "trusted"), ("q", "all", 1, "E1", "anything", "P1 p1", "plain", "odd", "trusted"),
    ]
    ours = evidence_plan.planned_rows(spark.createDataFrame(rows, ROWS), ["k"])
    shown = {(r.k, r.row_id): (r.citation, r.role, r.action) for r in ours.collect()}
    assert shown == {("r", "E1"): ("P1 p1", "result", "include"), ("r", "E2"): ("P2 p1", "formula_detail", "appendix"), ("r", "E8"): ("P1 p1", "front_matter", "exclude"), ("q", "E1"): ("P1 p1", "claim", "include")}
    said = 'Sure: ```json\n{"rows": [{"row_id": " E2 ", "citation": "P2 p1", "action": "include", "reason": " r "}, {"row_id": "E2", "citation": "P2 p1", "action": "exclude"}, {"row_id": "E1", "citation": "P9 p9"}, {"row_id": "E8", "citation": "P1 p1", "role": "nobody", "action": "nothing"}]}\n```'
    answers = spark.createDataFrame([("r", "results", True, said), ("q", "all", False, said), ("q", "results", True, None)], "k string, section string, success boolean, answer string")
    out = evidence_plan.reconciled(ours, evidence_plan.planner_rows(answers, ["k"]), ["k"])
    got = {(r.k, r.row_id): (r.place, r.role, r.action, r.reason, r.planner_status) for r in out.collect()}
    assert got == {("r", "E2"): (0, "formula_detail", "include", "r", "pass"), ("r", "E8"): (3, "front_matter", "exclude", "front matter is not evidentiary prose", "pass"), ("q", "E1"): (1, "claim", "include", "usable evidence for narrative prose", "fallback")}
    plans = {r.k: r for r in evidence_plan.section_plans(out, ["k"]).collect()}
    assert plans["r"].include_citations == ["P2 p1"] and plans["r"].exclude_row_ids == ["E8"] and plans["r"].appendix_citations == [] and plans["q"].include_row_ids == ["E1"]


def test_lists_keep_the_first_place_of_a_citation(spark):
    rows = [("k", "all", "E2", "P2 p1", 1), ("k", "all", "E1", "P1 p1", 2), ("k", "all", "E3", "P2 p1", 3), ("k", "all", "E1", "P3 p1", 4)]
    df = spark.createDataFrame(rows, "k string, section string, row_id string, citation string, place int").withColumns({"action": F.lit("include"), "planner_status": F.lit("pass")})
    r = evidence_plan.section_plans(df, ["k"]).first()
    assert r.include_citations == ["P2 p1", "P1 p1", "P3 p1"] and r.include_row_ids == ["E2", "E1", "E3"]


def test_digests(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "", "x"), (None, None, "1:x")], "n int, s string, `a.b` string")
    one = records.digest(df).first()
    assert records.digest(df.repartition(7).orderBy(F.desc("n"))).first() == one and records.digest(df.select("s", "n", F.col("`a.b`"))).first() == one
    others = [df.limit(3), df.unionByName(df.limit(1)), df.withColumn("s", F.coalesce("s", F.lit(""))), df.withColumn("n", F.lit(1)), df.distinct()]
    assert len({records.digest(x).first().digest for x in others} | {one.digest}) == 6
    # what a column lacks another can't make up for
    pair = lambda a, b: records.digest(spark.createDataFrame([(a, b)], "a string, b string")).first().digest
    assert len({pair("ab", "c"), pair("a", "bc"), pair("a,1:b", "c"), pair(None, "c"), pair("-", "c"), pair("", "c")}) == 6
    empty = records.digest(df.where("false")).first()
    assert empty.rows == 0 and empty.digest != one.digest
    each = {r.n: r.rows for r in records.digest(df, ["n"]).collect()}
    assert each == {1: 2, 2: 1, None: 1}


def test_passports_and_runs(spark):
    batches = spark.createDataFrame([("a", "q"), ("b", None)], "batch_id string, query string")
    items = spark.createDataFrame([("a", "1", "arxiv", "v", True), ("a", "2", "", None, None), ("a", "3", "arxiv", "u", False)], "batch_id string, normalized string, provider string, query_variant string, allowed boolean")
    artifacts = spark.createDataFrame([("a", "stored", 0.5), ("a", "stored", None), ("a", "failed", 0.1), ("a", None, None)], "batch_id string, status string, parse_confidence double")
    labels = spark.createDataFrame([("a", "maybe", "human"), ("a", "maybe", "agent"), ("gone", "relevant", "human")], "batch_id string, label string, label_source string")
    p = {r.batch_id: r for r in records.batch_passports(batches, items, artifacts, labels, "batch_id").collect()}
    a, b = p["a"], p["b"]
    assert tuple(a.batch) == (3, 2, 1, 2) and a.search == (["arxiv"], ["u", "v"]) and tuple(a.artifacts) == (4, 2, 2, 1, 0.5) and tuple(a.screening_labels) == (0, 2, 0, 1, 1) and a.repro_lock.items_digest
    assert tuple(b.batch) == (0, 0, 0, 0) and b.search == ([], []) and b.artifacts.average_parse_confidence is None and b.repro_lock.items_digest is None and b.source_policy.policy_version == "scholarly-only-v1"
    runs = spark.createDataFrame([("r1", "a"), ("r2", None)], "run_id string, batch_id string")
    out = records.run_summaries(runs, records.batch_passports(batches, items, artifacts, labels, "batch_id"), "batch_id")
    assert {r.run_id: r.passport is not None and r.passport.query for r in out.collect()} == {"r1": "q", "r2": False}
