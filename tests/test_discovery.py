"""Discovery: quotas, stopping rules and limits over tables of pages, and the data source of recorded pages."""

import json

from pyspark.sql import functions as F

from sievework.operators import discovery
from sievework.sources import readers
from sievework.sources.discovery_source import register, results_of, slug

PAGES = "provider string, variant string, offset int, failed boolean, candidates array<struct<doi:string,pmid:string,arxiv_id:string,source:string>>"


def test_quotas_and_pages(spark):
    rows = [("a", ["x", "y"], 8), ("b", ["x"], 1), ("c", ["x"], 0), ("d", [], 9), ("e", None, None), ("f", ["x"], -3), ("g", ["x", "y", "z"], 3)]
    got = discovery.page_requests(spark.createDataFrame(rows, "k string, variants array<string>, limit int"), "k", 2).collect()
    shown = {}
    for r in got:
        shown.setdefault((r.k, r.provider, r.variant), []).append((r.offset, r.page_limit))
    assert {k: sorted(v) for k, v in shown.items() if k[0] == "a"} == {("a", p, v): [(0, 2)] if p != "pubmed" else [(0, 1)] for p in discovery.PROVIDERS for v in "xy"}
    assert {k: v for k, v in shown.items() if k[0] not in "ag"} == {("b", "openalex", "x"): [(0, 1)]}
    assert len([k for k in shown if k[0] == "g"]) == 9
    big = spark.range(1).select(discovery.page_plan(F.lit(450), 10_000).alias("p")).first().p
    assert [tuple(x) for x in big] == [(0, 200), (200, 200), (400, 50)]


def test_stops_and_limits(spark):
    c = lambda *names: [(n if n.startswith("10.") else None, None, None, n) for n in names]
    pages = [
        ("openalex", "x", 0, False, c("10.1/A", "s1")), ("openalex", "x", 2, False, c("s2")), ("openalex", "x", 4, False, c("never", "seen")), ("openalex", "y", 0, True, c("failed", "page")), ("openalex", "y", 2, False, c("never", "seen")),
        ("arxiv", "x", 0, False, c("10.1/a", "S1")), ("arxiv", "x", 2, False, []), ("arxiv", "x", 4, False, c("never", "seen")), ("arxiv", "y", 0, False, None), ("pubmed", "y", 0, None, c("no", "state")), ("pubmed", "x", 0, False, c("p1", "p2")), ("pubmed", "x", 2, False, c("p3", "p4")), ("pubmed", "x", 4, False, c("p5", "p6")),
    ]
    asked = discovery.page_requests(spark.createDataFrame([("q", ["x", "y"], 36), ("few", ["x"], 4)], "k string, variants array<string>, limit int"), "k", 2)
    got = discovery.discovered(asked, spark.createDataFrame(pages, PAGES), "k").orderBy("k", "rank").collect()
    assert [r.source for r in got if r.k == "q"] == ["10.1/A", "s1", "s2", "p1", "p2", "p3", "p4", "p5", "p6"]
    assert [(r.rank, r.source) for r in got if r.k == "few"] == [(1, "10.1/A"), (2, "s1"), (3, "p1"), (4, "p2")]
    assert discovery.discovered(asked, spark.createDataFrame([], PAGES), "k").count() == 0


def work(k):
    return {"ids": {"doi": f"https://doi.org/10.1/{k}"}, "display_name": f"Title {k}", "publication_year": 2020}


def record(folder, round_, provider, variant, payload):
    at = folder / f"page-{round_}" / provider
    at.mkdir(parents=True, exist_ok=True)
    (at / slug(variant)).write_text(payload)


def test_data_source(spark, tmp_path):
    register(spark)
    results = lambda *ks: json.dumps({"results": [work(k) for k in ks]})
    record(tmp_path, 0, "openalex", "Deep Nets", results(1, 2))
    record(tmp_path, 0, "arxiv", "Deep Nets", "<feed><entry>a</entry></feed>")
    record(tmp_path, 0, "pubmed", "Deep Nets", json.dumps({"esearchresult": {"idlist": ["7", "8"]}}))
    record(tmp_path, 0, "openalex", "other", "not json")
    (tmp_path / "page-0" / "_SUCCESS").touch()
    options = {"path": str(tmp_path), "variants": json.dumps(["Deep Nets", "other"]), "limit": "24", "page_size": "2"}
    batch = spark.read.format("discovery").options(**options).load
    shown = lambda rows: sorted((r.provider, r.variant, r.offset, r.page_limit, r.n) for r in rows)
    first = [("arxiv", "Deep Nets", 0, 2, 1), ("openalex", "Deep Nets", 0, 2, 2), ("pubmed", "Deep Nets", 0, 2, 2)]
    assert shown(batch().collect()) == first
    assert [r.title for r in readers.works(batch().where("provider = 'openalex'")).collect()] == ["Title 1", "Title 2"]

    def drain():
        rows = []
        spark.readStream.format("discovery").options(**options).load().writeStream.foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return rows

    assert shown(drain()) == first
    assert drain() == []
    # a round without its mark isn't read; once complete, only variants whose pages were full go on
    for provider, payload in (("openalex", results(3)), ("arxiv", "<entry/><entry/>"), ("pubmed", "{}")):
        record(tmp_path, 1, provider, "Deep Nets", payload)
    assert drain() == []
    (tmp_path / "page-1" / "_SUCCESS").touch()
    assert shown(drain()) == [("openalex", "Deep Nets", 2, 2, 1)]
    assert shown(batch().collect()) == sorted([*first, ("openalex", "Deep Nets", 2, 2, 1)])


def fetched(provider, variant, offset, page_limit):
    """Stands for a service: three pages of one provider, failing for another variant."""
    if provider != "openalex" or variant == "bad":
        raise OSError("no answer")
    return json.dumps({"results": [work(offset + k) for k in range(page_limit if offset < 4 else 1)]})


def test_data_source_by_a_function(spark):
    register(spark)
    spark.sparkContext.addPyFile(__file__)
    got = spark.read.format("discovery").options(fetch="test_discovery:fetched", variants='["good", "bad"]', limit="60", page_size="2").load().collect()
    assert sorted((r.variant, r.offset, r.n) for r in got) == [("good", 0, 2), ("good", 2, 2), ("good", 4, 1)]


def test_results_of_a_page():
    assert results_of("arxiv", "<feed><entry><id/></entry><entry x='1'/></feed>") == 2 and results_of("pubmed", '{"esearchresult": null}') == 0 and results_of("openalex", '{"results": null}') == 0
