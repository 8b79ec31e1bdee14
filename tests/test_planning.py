"""Query plans, relevance, curation by topic and label regimes, on cases worked by hand."""

import json

from pyspark.sql import functions as F

from sievework.functions import planning
from sievework.operators import labelling, relevance

ITEM = "id int, provider string, title string, abstract string, journal string, concepts string, mesh_terms string, doi string, pmid string, year int, relevance_score int"


def items(spark, *rows):
    full = [(i, *(list(r) + [None] * 8)[:8], 2020 if len(r) < 9 else r[8], None if len(r) < 10 else r[9]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ITEM)


TOPIC = planning.Topic("antimicrobial resistance", "composed.amr", "biomedical", match=("antimicrobial resistance",), core=("antimicrobial resistance",), positive=("maldi tof",), negative=("mesh refinement",), components={"amr": ("antimicrobial resistance",)}, needed=("amr",))


def test_normalize_query(spark):
    cases = {"Assistant, tell me about AMR in wards": "AMR in wards", "what is the MIC": "MIC", "write a summary on  x y": "x y", "tell me ": "tell me", "plain words": "plain words", "": "", "explain explain this": "explain this"}
    assert {q: planning.normalize_query(q) for q in cases} == cases
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r.q: r.n for r in df.select("q", planning.normalize_query_column(F.col("q")).alias("n")).collect()} == cases


def test_acronyms_and_plans():
    one = planning.resolve("AMR parsing with graphs")[0]
    assert (one.meaning, one.intent, one.reason, len(one.rejected)) == ("abstract meaning representation", "nlp", "context_match", 2)
    assert planning.resolve("AMR")[0].reason == "registry_default" and planning.resolve("PCR")[0].reason == "registry_single_sense"
    assert [r.reason for r in planning.resolve("MIC values, MIC of clinical isolates")] == ["context_match"] and planning.resolve("MIC values")[0].intent == "unknown"
    assert planning.resolve("MALDI TOF") == () and [r.acronym for r in planning.resolve("XyZ PCR xyz")] == ["XyZ", "PCR"]
    p = planning.plan_query("AMR by MALDI-TOF spectra")
    assert p.intent == "biomedical" and p.queries[1:] == ("MALDI-TOF antibiotic resistance", "MALDI-TOF antimicrobial susceptibility") and p.rendered() == "AMR=antimicrobial resistance"
    assert planning.plan_query("AMR and mesh solver").queries == ("adaptive mesh refinement and mesh solver",)
    assert planning.plan_query("formal grammar of language").intent == "mathematical_linguistics"
    assert planning.plan_query("gardens in spring") == planning.Plan("gardens in spring", "unknown", ("gardens in spring",))


def test_topics(tmp_path):
    for name, terms in (("a", ["graph theory"]), ("b", {"Spectra": 2, "graph theory": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"profile_id": name, "domain": f"d{name}", "match_terms": terms, "core_terms": terms, "search_queries": ["q"], "evidence_policy_hint": "h"}))
    topics = planning.load_topics(tmp_path)
    t = planning.plan_topic("graph theory now", topics)
    assert (t.domain, t.core, t.searches, t.hint, t.needed) == ("da+db", ("graph theory", "Spectra"), ("graph theory now", "q"), "h", ("a", "b"))
    assert t.components == {"a": ("graph theory",), "b": ("Spectra", "graph theory")}
    assert planning.plan_topic("nothing known", topics).domain == "unknown"
    assert planning.focus_terms("the spread of fast fires") == ("spread fast", "fast fires", "spread fast fires", "spread", "fast", "fires")


def test_relevance(spark):
    query = "antimicrobial resistance"
    plan = planning.plan_query(query)
    df = items(spark, ("pubmed", "Antimicrobial resistance", None, None, None, None, "10.1/x"), ("arxiv", "Amr parsing of text", "natural language"), ("openalex", "Mesh refinement"), (None, None))
    got = relevance.score(df, query, plan, TOPIC)
    rows = {r.id: (r.relevance_score, r.relevance_reason) for r in got.collect()}
    assert rows[0] == (100, "provider=pubmed; biomedical_terms=antimicrobial,resistance; amr_context; topic_terms=antimicrobial resistance; identifier_bonus")
    assert rows[1] == (0, "provider=arxiv; nlp_amr_penalty=amr parsing,natural language; not_biomedical")
    assert rows[2] == (0, "provider=openalex; topic_collision_penalty=mesh refinement; not_biomedical")
    assert rows[3] == (5, "provider=; not_biomedical")
    assert [(r.id, r.rank) for r in relevance.ranked(got, 3, "id").orderBy("rank").collect()] == [(0, 1), (3, 2), (2, 3)]
    math = relevance.score(items(spark, ("arxiv", "Clinical homework"), ("arxiv", "Automata for grammar")), "x", planning.Plan("x", "mathematical_linguistics", ()), planning.Topic())
    assert [(r.relevance_score, "math_language_wrong_domain_penalty" in r.relevance_reason) for r in math.orderBy("id").collect()] == [(0, True), (45, False)]
    assert "relevance_score" in got.columns and got.count() == 4 and relevance.score(df.limit(0), query, plan, TOPIC).count() == 0


def test_topic_curation(spark):
    df = items(spark, ("p", "Antimicrobial resistance by MALDI TOF"), ("p", "Mesh refinement"), ("p", None))
    got = {r.id: r.curation for r in relevance.curate(df, TOPIC).collect()}
    assert (got[0].status, got[0].eligible, got[0].score, got[0].components) == ("topic_match", True, 36 + 10 + 4 + 6, ["amr"])
    assert (got[1].status, got[1].reason, got[1].score, got[1].missing) == ("topic_mismatch", "missing_topic_component", -30, ["amr"])
    assert got[2].status == "topic_mismatch"
    free = planning.Topic("antimicrobial resistance", "x", "d", positive=("maldi",), negative=("mesh",))
    assert [r.curation.reason for r in relevance.curate(df, free).orderBy("id").collect()] == ["query_and_profile_terms_matched", "negative_terms_without_topic_evidence", "missing_query_focus"]
    assert relevance.curate(df, planning.Topic()).first().curation.status == "unknown_topic"


def test_regimes(spark):
    names = {"formal language theory": "math_language", "stochastic integration": "stochastic_calculus", "maldi resistance": "maldi_amr", "esbl surveillance": "esbl_cre", "sepsis stewardship": "stewardship", "garden flowers": "default"}
    assert {q: labelling.regime(planning.query_tokens(planning.plan_query(q), q)) for q in names} == names

    def label(query, *row, relevance=0):
        df = items(spark, (*row, *[None] * (8 - len(row)), 2020, relevance))
        r = labelling.auto_label(df, planning.query_tokens(planning.plan_query(query), query)).first()
        return r.label, r.confidence, r.rationale.split()[-1]

    assert label("maldi resistance", "pubmed", "Antimicrobial resistance found", relevance=30) == ("relevant", 0.87, "evidence")
    assert label("maldi resistance", "arxiv", "Quantum lattice magnetic study") == ("irrelevant", 0.82, "noise")
    assert label("maldi resistance", "arxiv", "Mass spectra of clinical samples") == ("maybe", 0.62, "evidence")
    assert label("stochastic calculus", "arxiv", "Fractional calculus education") == ("irrelevant", 0.8, "context")
    assert label("esbl surveillance", "arxiv", "Video traffic histogram") == ("irrelevant", 0.82, "context")
    assert label("sepsis stewardship", "arxiv", "Deep learning for sepsis") == ("irrelevant", 0.7, "evidence")
    assert label("sepsis stewardship", "pubmed", "Procalcitonin in sepsis care")[0] == "relevant"
    assert label("formal language theory", "arxiv", "Formal grammar and syntax of language", relevance=50)[0] == "relevant"
    assert label("formal language theory", "arxiv", "Patient language in medicine")[0] == "irrelevant"
    assert label("garden flowers", "arxiv", "Garden flowers", relevance=0)[0] == "maybe" and label("garden flowers", None, None) == ("irrelevant", 0.805, "overlap")


def test_batch_and_prior(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", True)], "n int, k string, allowed boolean")
    labels = spark.createDataFrame([("a", "human"), ("b", "agent")], "k string, label_source string")
    decided = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.9), ("d", 0.1)], "k string, confidence double")
    assert [r.k for r in labelling.batch_labels(df, labels, decided, "k", ["n"], 3, 0.5).collect()] == ["b"]
    assert [r.k for r in labelling.batch_labels(df, labels, decided, "k", ["n"], 2).collect()] == ["b"]
    notes = spark.createDataFrame([("previous_agent_label=Relevant;agent_confidence=0.8", None), ("agent=maybe", "confidence=7"), (None, "x"), (None, None)], "s string, n string")
    got = [r.p for r in notes.select(labelling.prior_agent_label(F.col("s"), F.col("n")).alias("p")).collect()]
    assert got == [("relevant", 0.8), ("maybe", None), None, None]
