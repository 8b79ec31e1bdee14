"""Store, candidate, corpus and draft operators on small inputs worked by hand."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import policy
from sievework.operators import candidates, drafts, evaluation, store, topics


def test_lookup_and_update(spark):
    runs = spark.createDataFrame([("a", "new", 5, "t0"), ("b", "new", 6, "t0")], "run_id string, status string, limit_value int, updated_at string")
    assert store.lookup(runs, "run_id", "b").first().limit_value == 6
    for bad in (lambda: store.lookup(runs, "run_id", "c"), lambda: store.update_fields(runs, "run_id", "c", {"status": "x"}, F.lit("t1"))):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        store.update_fields(runs, "run_id", "a", {"status": "x", "color": 1}, F.lit("t1"))
    got = store.update_fields(runs, "run_id", "a", {"limit": 9}, F.lit("t1")).orderBy("run_id").collect()
    assert [tuple(r) for r in got] == [("a", "new", 9, "t1"), ("b", "new", 6, "t0")]
    assert store.update_fields(runs, "run_id", "a", {}, F.lit("t1")) is runs
    assert [r.run_id for r in store.scan(runs, F.col("limit_value") > 4, [F.desc("run_id")]).collect()] == ["b", "a"]


def test_label_events_one_by_one(spark):
    import random

    g, rows = random.Random(1), []
    for k in range(60):
        for n in range(g.randrange(1, 7)):
            rows.append((k, g.choice(["relevant", " MAYBE", "irrelevant", "good"]), g.choice(["human", "agent"]), g.choice([None, 0.5, 1.5]), g.random() < 0.3, n, n))
    want = {}
    for k, label, who, conf, over, at, _ in rows:
        label = label.strip().lower()
        if label not in store.LABELS or conf is not None and conf > 1:
            continue
        if k in want and who == "agent" and not over and want[k][1] == "human":
            continue
        want[k] = (label, who, conf, want[k][3] if k in want else at, at)
    events = spark.createDataFrame(rows, "k int, label string, label_source string, confidence double, overwrite_human boolean, at int, ordinal int")
    got = {r.k: (r.label, r.label_source, r.confidence, r.created_at, r.updated_at) for r in store.apply_labels(events, ["k"]).collect()}
    assert got == want


def test_schema_partitions_and_pages(spark, tmp_path):
    old = spark.createDataFrame([(1, 0.9), (2, None)], "id int, quality double")
    new = store.evolve(old, {"quality": ("double", F.lit(0.5)), "trust": ("double", F.col("quality") * 2), "note": ("string", None)})
    assert [tuple(r) for r in new.orderBy("id").collect()] == [(1, 0.9, 1.8, None), (2, 0.5, 1.0, None)]
    path = str(tmp_path / "units")
    for rows in ([("p", 1), ("p", 2), ("q", 3)], [("p", 9)]):
        store.replace_partitions(spark.createDataFrame(rows, "package string, n int"), path, ["package"])
    assert sorted((r.package, r.n) for r in spark.read.parquet(path).collect()) == [("p", 9), ("q", 3)]
    pages = spark.createDataFrame([(1, ["ab", None, ""])], "id int, pages array<string>")
    assert [(r.page_number, r.text, r.char_count) for r in store.number_pages(pages).collect()] == [(1, "ab", 2), (2, "", 0), (3, "", 0)]


def test_export_round_trip(spark, tmp_path):
    batches = spark.createDataFrame([("b", "scan", "q, \"x\"", 10, "t")], "batch_id string, mode string, query string, limit_value int, created_at string")
    items = spark.createDataFrame([("b", "n1", "s1", True, "fine", "d"), ("b", "n2", "s2", True, "fine", "d")], "batch_id string, normalized string, source string, allowed boolean, reason string, domain string")
    labels = spark.createDataFrame([("b", "n1", "maybe", "agent", 0.4, "line\nbreak"), ("b", "gone", "maybe", "agent", 0.4, "")], "batch_id string, normalized string, label string, label_source string, confidence double, note string")
    queue = spark.createDataFrame([("b", "n1", 3, 77, "why")], "batch_id string, normalized string, review_queue_rank int, review_queue_score int, review_queue_reason string")
    rows = evaluation.export_rows(batches, items, labels, queue)
    assert rows.columns == list(evaluation.EXPORT_FIELDS) and len(rows.columns) == 43
    r = rows.collect()
    assert len(r) == 1 and (r[0].weak_label, r[0].gold_label, r[0].source_reason, r[0].review_queue_rank, r[0].batch_limit) == ("maybe", None, "fine", 3, 10)
    evaluation.write_export(rows, str(tmp_path / "j"))
    line = spark.read.text(str(tmp_path / "j")).first().value
    assert list(json.loads(line)) == sorted(evaluation.EXPORT_FIELDS) and json.loads(line)["label_note"] == "line\nbreak"
    evaluation.write_export(rows, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back.query == 'q, "x"' and back.label_note == "line\nbreak" and back.doi is None


def test_attention_and_gaps(spark):
    items = spark.createDataFrame([("a", "s1", True, 70), ("b", "s2", True, 60), ("c", "s3", False, 90), ("d", "s4", True, 59)], "normalized string, source string, allowed boolean, relevance_score int")
    labels = spark.createDataFrame([("b", "maybe")], "normalized string, label string")
    comparable = spark.createDataFrame([("x", "relevant", "maybe", 0.9), ("y", "maybe", "relevant", None), ("z", "maybe", "maybe", 1.0)], "source string, human string, agent string, confidence double")
    artifacts = spark.createDataFrame([("s1", "stored"), ("s2", "blocked")], "source string, status string")
    rejected = spark.createDataFrame([("s9", "source_gate"), ("s8", "evidence")], "source string, stage string")
    got = {k: [r[0] for r in v.collect()] for k, v in evaluation.attention(items, labels, artifacts, comparable, rejected).items()}
    assert got == {"label_disagreements": ["x", "y"], "high_confidence_mistakes": ["x"], "maybe_labels": ["b"], "high_relevance_unlabeled": ["a"], "failed_pdfs": ["s2"], "source_gate_blocks": ["s9"]}
    assert len(evaluation.evidence_gaps(1, 5, 0, 0, 0, 1)) == 1 and len(evaluation.evidence_gaps(1, 5, 1, 2, 3, 0)) == 5
    claims = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, -1.0), (4, 0.9)], "id int, quality_score double")
    assert [r.id for r in evaluation.report_claims(claims, [F.col("id")], 2).collect()] == [2, 4]


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2401.00001v1</id><title> A
 title </title><summary>Some &lt;b&gt;text</summary><published>2024-01-02T00:00:00Z</published><arxiv:doi>10.1/ABC</arxiv:doi><link title="pdf" type="application/pdf" href="http://arxiv.org/pdf/2401.00001v1"/><link href="http://arxiv.org/abs/2401.00001v1"/></entry>
<entry><id>http://arxiv.org/abs/2401.00002v1</id><title></title></entry></feed>"""
ARTICLES = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><Journal><Title>J  One</Title></Journal><Abstract><AbstractText Label="AIM">to see</AbstractText><AbstractText>and more</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D1">Cells</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D2">cells</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D3">Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_payloads(spark):
    a = candidates.atom_candidates(spark.createDataFrame([(ATOM,)], "payload string")).collect()
    assert len(a) == 1 and (a[0].title, a[0].arxiv_id, a[0].doi, a[0].year, a[0].pdf_url) == ("A title", "2401.00001v1", "10.1/ABC", 2024, "https://arxiv.org/pdf/2401.00001v1")
    details = candidates.article_details(spark.createDataFrame([(ARTICLES,)], "payload string"))
    assert [tuple(r) for r in details.collect()] == [("7", "AIM: to see and more", "Cells; Mice", "J One")]
    c = spark.createDataFrame([("7", "old", "mesh", None), ("8", "kept", "m", "j")], "pmid string, abstract string, mesh_terms string, journal string")
    assert sorted(tuple(r) for r in candidates.merge_details(c, details).collect()) == [("7", "AIM: to see and more", "Cells; Mice", "J One"), ("8", "kept", "m", "j")]
    csl = json.dumps([{"id": "k1", "title": "T", "URL": "", "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2020, 1]]}, "container-title": "V"}, {"title": " "}, {"title": "My Paper"}])
    rows = candidates.csl_entries(spark.createDataFrame([(csl,)], "payload string")).orderBy("place").collect()
    assert [(r.status, r.citation_key, r.source_pointer) for r in rows] == [("valid", "k1", "zotero:k1"), ("rejected", "item", "zotero:item"), ("valid", "my-paper", "zotero:my-paper")]
    assert (rows[0].authors, rows[0].year, rows[0].venue, rows[1].reason) == (["A B"], 2020, "V", "missing_required_field")


def test_links(spark):
    gate = policy.SourcePolicy(allowed=("ok.org",), blocked=(), suffixes=(), prefixes=())
    rows = spark.createDataFrame([("x", None, "https://bad.org/a.pdf", "https://ok.org/a.pdf"), ("arxiv", "1", None, None), ("x", None, "https://ok.org/page", None)], "provider string, arxiv_id string, a string, b string")
    got = rows.select(candidates.resolve_pdf(F.col("provider"), F.col("arxiv_id"), [(F.col("a"), "first"), (F.col("b"), "second")], gate).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [("https://ok.org/a.pdf", "second"), ("https://arxiv.org/pdf/1", "resolved_arxiv_pdf"), (None, "no_safe_pdf_url")]
    one = spark.createDataFrame([(["http://a.org/x", None, "http://a.org/x/pdf"], ["A", "b"], ["B", " "], None, False)], "l array<string>, c array<string>, t array<string>, s string, oa boolean")
    r = one.select(candidates.open_access_pdf(F.col("l")).alias("p"), candidates.concepts(F.col("c"), F.col("t")).alias("c"), candidates.open_access_status(F.col("s"), F.col("oa")).alias("s"), candidates.first_present(F.lit(""), F.col("s"), F.lit("z")).alias("f")).first()
    assert tuple(r) == ("http://a.org/x/pdf", "A; b", "closed", "z")


def test_corpora(spark, tmp_path):
    files = {"good.json": json.dumps({"literature_corpus": [{"title": "Mice studies", "tags": ["cells"], "year": 2020}]}), "list.json": "[1]", "broken.json": "{", "other.json": "{}"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = candidates.parse_paths(f"{tmp_path}/good.json, {tmp_path}/list.json\n{tmp_path}/broken.json:{tmp_path}/other.json:{tmp_path}/none.json")
    entries, bad = candidates.load_corpora(spark, paths)
    assert [(r.title, r.tags, r.year) for r in entries.collect()] == [("Mice studies", ["cells"], 2020)]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {"list.json": "invalid_corpus", "broken.json": "invalid_json", "other.json": "invalid_corpus", "none.json": "missing_file"}
    fields = {"title": F.col("title"), "abstract": F.col("abstract"), "tags": F.array_join("tags", " "), "venue": F.col("venue"), "authors": F.lit(""), "identifiers": F.col("doi")}
    assert [(r.score, r.matched_terms) for r in candidates.route(entries, "the study of cells", fields, [F.col("title")]).collect()] == [(14, ["cell", "study"])]
    assert candidates.route(entries, "the study of cells", fields, [F.col("title")], min_matches=2).count() == 0


def test_topics_and_drafts(spark):
    rows = spark.createDataFrame([(1, "Cells; mice, ab", None, "J One", "Deep  graph nets"), (2, "Biology", "Cells", None, "deep graph nets and more")], "o int, concepts string, mesh_terms string, journal string, text string")
    n = {r.term: r.n for r in topics.term_counts(rows, "o").collect()}
    assert n == {"Cells": 4, "mice": 2, "J One": 2, "Deep graph": 1, "graph nets": 2, "Deep graph nets": 1, "deep graph": 1, "nets more": 1, "deep graph nets": 1, "graph nets more": 1}
    p = topics.mine_profile(" my  topic ", rows, "o").first()
    assert p.positive_terms == ["Cells", "mice", "J One", "graph nets"] and p.search_queries[:2] == ["my topic", "my topic Cells"] and p.profile_id == "session.my-topic"
    table = spark.createDataFrame([(1, "a | b\n c"), (2, None)], "id int, text string")
    assert drafts.markdown_table(table, ["id", "text"], [F.col("id")]) == ["| id | text |", "| --- | --- |", r"| 1 | a \| b c |", "| 2 |  |"]
