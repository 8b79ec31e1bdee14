"""Claims, audits and gates of reports, on small texts worked by hand."""

from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import report

REPORT = """# Report
## Background
The background section draws on two page-anchored claims.
- Resistance rose among isolates in the ward [1, p. 2].
## Methods
Mass spectra trained a large classifier [P2 p3; P1 p2]. Everyone was treated well with new drugs.
## Results
The test proved a survival benefit for patients [1, p. 2].
Bananas grow on tall trees [P2 p3].
Something else [P9 p9].
- MATERIAL GAP: No limitation evidence is available.
## Evidence Table
| a | b |
Nothing here counts as a claim of the report.
"""


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def index(spark):
    rows = [("r", 1, "E1", "P1 p2", "Resistance rose among isolates; spectra", "result", 0.9, 1.0, 0.9), ("r", 2, "E2", "P2 p3", "Spectra trained the classifier", "method", 0.8, 0.95, None), ("r", 3, "E3", "P2 p3", "Spectra trained the classifier", "method", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, ordinal int, row_id string, citation string, text string, evidence_type string, quality_score double, parse_confidence double, trust_score double")
    return report.evidence_index(df.withColumns({"support_status": F.lit(""), "quality_label": F.lit("clean")}), "id")


def units(spark):
    r = spark.createDataFrame([("r", REPORT), ("empty", ""), ("null", None)], "id string, report string")
    gaps = spark.createDataFrame([("r", "No limitation evidence is available")], "id string, message string")
    return r, report.claim_units(r, index(spark), gaps, "id")


def test_citation_forms(spark):
    assert col(spark, "a [1, p. 2; P3  p4] b [x; 5 P.6] [7]", text.citations) == ["P1 p2", "P3 p4", "P5 p6"]
    assert col(spark, "A [x; 1, p. 2]. B [no].", text.strip_citations) == "A. B [no]."
    assert col(spark, ["P10 p1", "bad", "P2 p11", "P2 p3"], text.sort_citations, "array<string>") == ["P2 p3", "P2 p11", "P10 p1", "bad"]
    assert col(spark, ["P1 p2", "bad", "P1 p2"], text.display_citations, "array<string>") == "[1, p. 2]" and col(spark, [], text.display_citations, "array<string>") == ""


def test_columns(spark):
    assert col(spark, "The mass-spectra of 12 -x- [P1 p2] and Yeast", report.terms) == ["mass-spectra", "12", "yeast"]
    assert col(spark, "Proven and  proved: survival  benefit", report.overstatements) == ["proved", "proven"]
    assert col(spark, "short claim", report.claim_quality) == -1 and col(spark, "we show that the model works [well", report.claim_quality) == 7 + 6 - 2
    assert [col(spark, x, report.stance) for x in ("did not improve but improved", "higher", "same")] == ["negative", "positive", "neutral"]
    assert col(spark, "E. coli grew. It died\n# Head\n---\nEnd", report.draft_sentences) == ["E. coli grew.", "It died", "End"]
    assert col(spark, "Keywords: a", lambda c: report.role(F.lit("result"), c)) == ("front_matter", "exclude", "front matter is not evidentiary prose")
    assert col(spark, "plain", lambda c: report.role(F.lit("result"), c)).action == "include"
    assert col(spark, "AUC was good", lambda c: report.group_label(F.lit(" "), F.lit("result"), c)) == "Model performance"
    assert col(spark, '```json\n{"a": 1}\n``` x', report.json_text) == '{"a": 1}' and col(spark, "none", report.json_text) is None


def test_claim_units(spark):
    r, u = units(spark)
    got = {x.text: x for x in u.collect()}
    verdicts = {k: (v.claim_type, v.support_status, v.verdict) for k, v in got.items()}
    assert verdicts["Resistance rose among isolates in the ward"] == ("factual", "supported", "supported")
    assert verdicts["Mass spectra trained a large classifier. Everyone was treated well with new drugs"] == ("synthesis", "supported", "supported")
    assert verdicts["The test proved a survival benefit for patients"][2] == "overstated"
    assert verdicts["Bananas grow on tall trees"] == ("result", "weak_support", "weak")
    assert verdicts["Something else"] == ("result", "unknown_citation", "unsupported")
    assert verdicts["No limitation evidence is available"] == ("material_gap", "material_gap", "material_gap")
    both = got["Mass spectra trained a large classifier. Everyone was treated well with new drugs"]
    assert (both.citations, both.evidence_row_ids, both.min_quality_score, both.min_trust_score) == (["P1 p2", "P2 p3"], ["E1", "E2", "E3"], 0.8, 0.9)
    assert not any("Nothing here" in k for k in got)
    f = {x.id: (x.tier_a_status, x.tier_b_status, x.status) for x in report.faithfulness(r, u, "id").collect()}
    assert f == {"r": ("fallback", "fallback", "fallback"), "empty": ("pass", "pass", "pass"), "null": ("pass", "pass", "pass")}


def test_plan_adherence(spark):
    _, u = units(spark)
    moves = spark.createDataFrame([("r", "results", 1, "a", ["P9 p9"]), ("r", "results", 2, "b", ["P1 p2"]), ("r", "results", 3, "c", ["P1 p2", "P7 p7"]), ("r", "results", 4, "d", ["P8 p8"])], "id string, section string, ordinal int, label string, citations array<string>")
    got = {(x.rule, x.item): x.citations for x in report.plan_adherence(moves, u, "id").collect()}
    loose = next(k for k in got if k[0] == "unplanned_claim")
    assert got.pop(loose) == ["P2 p3"]
    assert got == {("out_of_order_planned_move", "b"): [], ("partial_planned_move", "c"): ["P7 p7"], ("missing_planned_move", "d"): ["P8 p8"]}


def test_prose(spark):
    r = spark.createDataFrame([("r", "## Background\nIn this work we present it.\nThe evidence includes [1, p. 1; 2, p. 1; 3, p. 1; 4, p. 1; 5, p. 1].\nBad Phrase here [P1 p2]"), ("ok", "## Background\n## Methods\nFine.")], "id string, report string")
    blocked = spark.createDataFrame([("bad phrase",), ("",)], "phrase string")
    got = {(x.id, x.rule): x.examples for x in report.prose_issues(r, "id", ("## Background", "## Methods"), blocked).collect()}
    assert got == {
        ("r", "missing_required_heading"): ["## Methods"], ("r", "internal_citation_syntax"): ["[P1 p2]"], ("r", "oversized_citation_bundle"): ["[1, p. 1; 2, p. 1; 3, p. 1; 4, p. 1; 5, p. 1]"],
        ("r", "raw_evidence_dump_phrase"): ["The evidence includes [1, p. 1; 2, p. 1; 3, p. 1; 4, p. 1; 5, p. 1]."], ("r", "source_author_voice"): ["In this work we present it."], ("r", "feedback_blocked_phrase"): ["Bad Phrase here [P1 p2]"],
    }


def test_claims_tables_clusters(spark):
    claims = spark.createDataFrame([("b", 1, "result", "P1", "P1 p2", 2, "x rose"), ("b", 2, "claim", "P2", "P2 p1", 1, "y fell"), ("b", 3, "result", "P2", None, 0, "z"), ("b", 4, "other", "P2", "P2 p1", 1, "q")], "b string, n int, evidence_type string, paper string, citation string, page_number int, text string")
    a = report.claim_support(claims, "b", ["n"])
    assert {x.n: (x.claim_id, x.support_status) for x in a.collect()} == {2: ("C1", "SUPPORTED"), 1: ("C2", "SUPPORTED"), 3: ("C3", "MISSING_PAGE_ANCHOR")}
    groups = spark.createDataFrame([("b",), ("none",)], "b string")
    assert {x.b: (x.supported, x.missing_page_anchor, x.material_gaps, x.status) for x in report.support_summary(a, groups, "b").collect()} == {"b": (2, 1, 0, "gaps"), "none": (0, 0, 1, "gaps")}
    refs = spark.createDataFrame([("b", "P1", "T", 2020, "J", None, "s")], "b string, label string, title string, year int, journal string, doi string, source string")
    assert [(x.row_id, x.table, x.paper_title) for x in report.evidence_tables(claims, refs, "b", ["n"]).orderBy("n").collect()] == [("E1", "results", "T"), ("E2", "claims", None), ("E3", "results", None), ("E4", "claims", None)]
    c = {x.evidence_type: x for x in report.clusters(claims.where("citation is not null"), "b", ["n"]).collect()}
    assert c["result"].paragraph == "Across 1 paper, result evidence includes x rose [P1 p2]."
    s = report.body_sentences(claims.where("evidence_type in ('result', 'claim')").withColumn("m", F.lit(1)).withColumn("text", F.lit("We present  a Test.")), "m", ["n"]).orderBy("place")
    assert [x.sentence for x in s.collect()] == ["One paper reported that the authors presented a Test [1, p. 2].", "A second paper argued that the authors presented a Test [2, p. 1]."]


def test_paragraphs_and_groups(spark):
    blocks = [("S1", "SUPPORTED", "x [P1 p2]\n\ny", ["P1 p2"]), ("S2", "NO", "x", ["P1 p2"]), ("S3", "SUPPORTED", "", ["P1 p2"]), ("S4", "SUPPORTED", "x [P2 p2]", ["P1 p2"]), ("S5", "SUPPORTED", "x", None), ("S6", None, None, None)]
    got = {x.paragraph_id: (x.support_status, x.reason) for x in report.paragraph_audit(spark.createDataFrame(blocks, "block_id string, status string, paragraph string, citations array<string>")).collect()}
    gap = "MATERIAL_GAP"
    assert got == {"S1.1": ("SUPPORTED", "page_anchored"), "S1.2": (gap, "missing_page_citation"), "S2.1": (gap, "unsupported_block_status"), "S3.1": (gap, "empty_paragraph"), "S4.1": (gap, "unknown_page_citation"), "S5.1": (gap, "no_page_anchored_evidence"), "S6.1": (gap, "unsupported_block_status")}
    p = spark.createDataFrame([("k", 1, None, "result", "accuracy improved", ["P1 p1"]), ("k", 2, None, "result", "accuracy was worse", ["P2 p1", "P1 p1"]), ("k", 3, "T", "method", "m", ["P3 p1"])], "k string, ordinal int, topic string, evidence_type string, paragraph string, citations array<string>")
    g = report.groups_of(p, "k").orderBy("group_id").collect()
    assert [(x.group_id, x.group_label, x.paragraph_count, x.conflict, x.conflict_citations) for x in g] == [("G1", "Model performance", 2, True, ["P1 p1", "P2 p1"]), ("G2", "T", 1, False, [])]
    gaps = spark.createDataFrame([("k", 2, "b", "m"), ("k", 1, "a", "m"), ("k", 3, "c", "")], "k string, n int, reason string, message string")
    assert [tuple(x) for x in report.material_gaps(gaps, "k", "n").collect()] == [("k", "m", "a", 1)]


def test_gates(spark):
    names = ("citation", "faithfulness", "tier_a", "tier_b", "plan_adherence", "semantic_faithfulness", "prose_quality", "critic")
    trust = lambda **k: spark.range(1).select(report.report_trust({n: F.lit(k.get(n, "pass")) for n in names}).alias("t")).first().t
    assert tuple(trust()) == (100, "publishable", "publish", ["critic_passed"])
    assert tuple(trust(citation="fallback", prose_quality="fallback")) == (40, "blocked", "block", ["citation_audit_failed", "prose_quality_failed"])
    assert tuple(trust(semantic_faithfulness="skipped", critic="not_run")) == (85, "needs_review", "human_review", ["semantic_verifier_not_run", "critic_not_run"])
    draft = spark.createDataFrame([(1, True, "Spectra were read well [P1 p2]."), (2, True, "Spectra were read well. Good [P1 p2]."), (3, True, ""), (4, None, "x"), (5, True, "Spectra [P7 p2]"), (6, True, "plain words only"), (7, True, "X [P1 p2]\n## Material Gaps\nNo data [P1 p2]\nMore [P1 p2]")], "i int, ok boolean, d string")
    one, gaps = F.array(F.lit("P1 p2")), F.array(F.lit("No data [P1 p2]"))
    got = draft.select("i", report.composer_gate(F.col("ok"), F.col("d"), one, gaps).alias("g")).collect()
    assert {x.i: x.g.reason for x in got} == {1: "evidence_bound", 2: "uncited_factual_sentence", 3: "empty_model_output", 4: "model_unavailable", 5: "unknown_citation", 6: "missing_citations", 7: "material_gap_expansion"}
    answers = spark.createDataFrame([(1, True, '{"verdict": "Pass"}'), (2, True, '{"verdict": "pass", "unsupported_claims": ["x"]}'), (3, True, "no"), (4, False, None)], "i int, ok boolean, a string")
    got = answers.select("i", report.verifier_gate(F.col("ok"), F.col("a"), F.lit("a [P1 p2]"), one).alias("g")).collect()
    assert {x.i: (x.g.reason, x.g.verdict) for x in got} == {1: ("verified", "pass"), 2: ("verifier_rejected", "pass"), 3: ("verifier_unparseable", "fail"), 4: ("verifier_unavailable", "fail")}
    critics = spark.createDataFrame([("a", "prose", "pass", 0), ("a", "structure", "pass", 0), ("b", "prose", "pass", 1), ("b", "faith", None, 0)], "id string, kind string, verdict string, issue_count int")
    assert {x.id: (x.status, x.failed_critic_kinds) for x in report.critic_panel(critics, "id").collect()} == {"a": ("pass", []), "b": ("fallback", ["faith", "prose"])}
    audits = {k: F.lit("pass") for k in ("citation", "prose_quality", "faithfulness", "plan_adherence", "semantic_faithfulness")}
    gate = lambda **k: spark.range(1).select(report.candidate_gate(F.lit(True), F.lit("x"), audits | {n: F.lit(v) for n, v in k.items()}, F.lit("pass")).alias("g")).first().g.reason
    assert gate() == "candidate_accepted" and gate(faithfulness="fallback", plan_adherence="fallback") == "faithfulness_failed" and gate(semantic_faithfulness="skipped") == "candidate_accepted"


def test_learned_phrases_in_blocks(spark):
    """More phrases than a block takes: all are still compared with all lines."""
    r = spark.createDataFrame([("a", "One LES two\nthree"), ("b", None)], "id string, report string")
    learned = spark.createDataFrame([(f"p{i}",) for i in range(7)] + [("les",), ("Three",), ("les",), (" ",), (None,)], "phrase string")
    got = [sorted((x.phrase, x.rule, tuple(x.examples)) for x in report.prose_issues(r, "id", blocked=learned, most_phrases=n).collect()) for n in (2, 5_000)]
    assert got[0] == got[1] == [("Three", "feedback_blocked_phrase", ("three",)), ("les", "feedback_blocked_phrase", ("One LES two",))]


def test_terms_support(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a"]), (["a"], []), (["a", "b", "c", "d"], ["a"]), (["a", "b", "c", "d"], ["a", "d"])], "c array<string>, e array<string>")
    assert [x.s for x in df.select(report.terms_support(F.col("c"), F.col("e")).alias("s")).collect()] == [True, True, False, False, True]
