"""Acronym senses, topics and a model's labels on small tables, against the driver's forms and worked by hand."""

import json

from pyspark.sql import functions as F

from sievework.functions import planning
from sievework.operators import model_labels, understanding

QUERIES = ["AMR surveillance of isolates", "AMR parsing, amr and graphs", "AMR", "finite AMR mesh text", "MIC by MALDI-TOF", "MIC of isolates", "XyZ and NLP, CNNs", "none", "", "AST LLM"]


def test_senses_equal_the_driver_form(spark):
    rows = [(i, q) for i, q in enumerate(QUERIES)] + [(99, None)]
    registry = spark.createDataFrame(understanding.registry_rows(), understanding.REGISTRY)
    out = understanding.acronym_senses(spark.createDataFrame(rows, "k int, query string"), registry, ["k"])
    got = {}
    for r in out.orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(planning.Resolved(r.acronym, r.meaning, r.intent, r.reason, tuple(r.rejected)))
    assert got == {i: list(planning.resolve(q)) for i, q in enumerate(QUERIES) if planning.resolve(q)}
    lines = {r.k: r.expansions for r in understanding.rendered(out, ["k"]).collect()}
    assert lines == {i: planning.plan_query(q).rendered() for i, q in enumerate(QUERIES) if planning.resolve(q)}


def test_ties_and_empty_registry(spark):
    registry = spark.createDataFrame([("ab", 1, "later", "x", ["word", "other"], False, False), ("ab", 0, "first", "y", ["word", "none"], None, None), ("cd", 0, "hidden", "z", None, False, True)], understanding.REGISTRY)
    asked = spark.createDataFrame([(1, "AB word"), (2, "AB other"), (3, "CD")], "k int, query string")
    shown = lambda df: sorted((r.k, r.meaning, r.reason, r.rejected) for r in df.collect())
    assert shown(understanding.acronym_senses(asked, registry, ["k"])) == [(1, "first", "context_match", ["later"]), (2, "later", "context_match", ["first"])]
    assert shown(understanding.acronym_senses(asked, registry.where("false"), ["k"])) == [(1, "AB", "unresolved_acronym", []), (2, "AB", "unresolved_acronym", []), (3, "CD", "unresolved_acronym", [])]


def profile(place, id_, domain, hint=None, **lists):
    return (place, id_, domain, hint, *[list(lists.get(k, ())) for k in understanding.LISTS])


SCHEMA = "place int, profile_id string, domain string, hint string, " + ", ".join(f"{k} array<string>" for k in understanding.LISTS)


def test_topics_equal_the_driver_form(spark):
    own = [
        profile(0, "a", "x", "h", match=["deep  Nets", "nets"], core=["Layer"], positive=["One", "two"], searches=["s a"], negative=["no"]), profile(1, "b", "unknown", required=["alpha", "beta gamma"], core=["delta"], positive=["ONE", "three", " "], searches=["S  A", "s b"], preferences=["p"]),
        profile(2, "c", "y", "h", core=["nets"], positive=["four"]), profile(3, "d", "z", match=["never"], required=["", "alpha"]), profile(4, "e", "x", "k", required=["alpha"]),
    ]
    queries = ["Deep nets", "alpha and beta, gamma", "delta", "layer", "nothing", "  ", "alpha", "beta alpha gamma"]
    out = understanding.topic_plans(spark.createDataFrame(list(enumerate(queries)), "k int, query string"), spark.createDataFrame(own, SCHEMA), ["k"])
    topics = [planning.Topic("", p[1], p[2], *[tuple(p[4 + i]) for i in range(5)], tuple(p[9]), tuple(p[10]), p[3], {p[1]: ()}, (p[1],)) for p in own]
    got = {r.k: r for r in out.collect()}
    assert len(got) == len(queries)
    for i, q in enumerate(queries):
        want = planning.plan_topic(q, topics)
        r = got[i]
        assert (r.profile_id, r.domain, r.hint, tuple(r.needed)) == (want.profile_id, want.domain, want.hint, want.needed), q
        assert [tuple(r[k]) for k in understanding.LISTS] == [want.match, want.required, want.core, want.positive, want.negative, want.searches, want.preferences], q
    scores = {(r.k, r.profile_id): r.score for r in understanding.profile_matches(spark.createDataFrame([(1, "deep nets; alpha, beta gamma delta")], "k int, query string"), spark.createDataFrame(own, SCHEMA), ["k"]).collect()}
    assert scores == {(1, "a"): 4, (1, "b"): 6, (1, "c"): 2, (1, "e"): 4}
    assert understanding.topic_plans(spark.createDataFrame([(1, "x")], "k int, query string"), spark.createDataFrame([], SCHEMA), ["k"]).first().profile_id == "unknown"


def test_ordered_union(spark):
    rows = [("a", 1, 0, "B  b"), ("a", 0, 1, "c"), ("a", 0, 0, "b B"), ("a", 2, 0, "  "), ("a", 2, 1, None), ("b", 0, 0, "x")]
    out = understanding.ordered_union(spark.createDataFrame(rows, "k string, p int, i int, v string"), ["k"], "v", ["p", "i"])
    assert {r.k: r["values"] for r in out.collect()} == {"a": ["b B", "c"], "b": ["x"]}


def good(**more):
    return json.dumps({"label": "maybe", "confidence": 0.1239, "rationale": " a  b ", "evidence_terms": ["x  y"], "exclusion_reason": None} | more)


def test_checked_answers(spark):
    cases = {
        good(): None, good(evidence_terms=[]): None, good(confidence=1): None, good(confidence=0): None, good(exclusion_reason=" "): None, "": "not_an_object", "[]": "not_an_object", '"x"': "not_an_object", "{": "not_an_object", good(label="Maybe"): "invalid_label", good(label=1): "invalid_label", good(confidence="0.5"): "invalid_confidence", good(confidence=True): "invalid_confidence", good(confidence=1.01): "invalid_confidence",
        good(confidence=None): "invalid_confidence", good(rationale=" "): "empty_rationale", good(rationale=["a"]): "empty_rationale", good(evidence_terms="x"): "invalid_evidence_terms", good(evidence_terms=["a", None]): "invalid_evidence_terms", good(evidence_terms=[None]): "invalid_evidence_terms", good(evidence_terms=["a", " "]): "invalid_evidence_terms", good(evidence_terms=["a", 1]): "invalid_evidence_terms", good(exclusion_reason=1): "invalid_exclusion_reason", '{"label": "maybe"}': "invalid_confidence",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", model_labels.checked(F.col("a")).alias("d")).collect()
    assert {r.a: r.d.error for r in rows} == cases
    first = next(r.d for r in rows if r.a == good())
    assert (first.label, first.confidence, first.rationale, first.evidence_terms, first.exclusion_reason) == ("maybe", 0.124, "a b", ["x y"], None)
    assert spark.createDataFrame([(None,)], "a string").select(model_labels.checked(F.col("a")).alias("d")).first().d.error == "not_an_object"


def test_responses(spark):
    part = lambda *c: json.dumps({"output": [{"content": list(c)}]})
    cases = {'{"output_text": "t"}': ("t", None), part({"type": "output_text", "text": "u"}): ("u", None), part({"type": "refusal", "refusal": "no"}, {"type": "output_text", "text": "u"}): (None, "refused: no"), part({"type": "other"}): (None, "no_output_text"), "{}": (None, "no_output_text"), "bad": (None, "no_output_text")}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", model_labels.response_text(F.col("a")).alias("d")).collect()
    assert {r.a: tuple(r.d) for r in rows} == cases


def answer(payloads):
    if any("boom" in p for p in payloads):
        raise OSError("down")
    return [None if p == "none" else ValueError("one") if p == "one" else good(confidence=0.9 if "sure" in p else 0.1) for p in payloads]


def test_label_items(spark):
    spark.sparkContext.addPyFile(__file__)
    rows = [(1, "sure", None), (2, "low", "agent"), (3, "none", None), (4, "one", None), (5, "sure", "human"), (6, None, None)] + [(100 + i, "boom", None) for i in range(12)]
    items = spark.createDataFrame(rows, "k int, payload string, label_source string").coalesce(1).orderBy("k")
    out = model_labels.label_items(items.where("k < 6"), ["k"], answer, least=0.5, batch=2)
    assert {r.k: (r.outcome, r.error) for r in out.decisions.collect()} == {1: ("applied", None), 2: ("skipped_low_confidence", None), 3: ("skipped_error", "no_answer"), 4: ("skipped_error", "call_failed: one"), 5: ("skipped_human", None)}
    assert out.counts == {"applied": 1, "skipped_human": 1, "skipped_low_confidence": 1, "skipped_error": 2} and out.errors == ["no_answer", "call_failed: one"]
    down = model_labels.label_items(items.where("k >= 100"), ["k"], answer)
    assert down.counts["skipped_error"] == 12 and down.errors == ["call_failed: down"] * 10
    assert model_labels.label_items(items.where("false"), ["k"], answer).counts == {"applied": 0, "skipped_human": 0, "skipped_low_confidence": 0, "skipped_error": 0}


def test_payload(spark):
    df = spark.createDataFrame([(None, "T")], "query string, title string")
    p = json.loads(df.select(model_labels.label_payload(F.col("query"), F.struct(F.lit("nlp").alias("intent")), df.columns).alias("p")).first().p)
    assert p["query"] == "" and p["query_plan"] == {"intent": "nlp"} and p["candidate"]["title"] == "T" and p["candidate"]["doi"] is None and p["label_choices"] == ["relevant", "maybe", "irrelevant"] and set(p["rules"]) == set(p["label_choices"])
