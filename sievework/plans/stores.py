"""Registered queries of the store, label evaluation, candidates, topics and draft review, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import candidates, drafts, evaluation, store, topics
from .registry import LAB, _labels, _t, query

# --- label evaluation and review --------------------------------------------------------------------------------------

_ITEM = "(SELECT doc_id AS normalized, source || '/' || doc_id AS source, source AS batch_id, lang AS title, coalesce(lang, '') <> 'fr' AS allowed, CAST(doc_id % 80 AS INTEGER) AS relevance_score FROM documents)"
_QUEUE = "(SELECT doc_id AS normalized, doc_id + 1 AS review_queue_rank FROM documents WHERE n_chars >= 1500)"


def _items(spark, sf):
    """Documents as screened items: the language as title, two thirds of the languages allowed."""
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("normalized"), F.concat("source", F.lit("/"), "doc_id").alias("source"), F.col("source").alias("batch_id"), F.col("lang").alias("title"), (F.coalesce("lang", F.lit("")) != "fr").alias("allowed"), (F.col("doc_id") % 80).cast("int").alias("relevance_score"))


def _set(spark, sf):
    return _labels(spark, sf).select(F.col("doc_id").alias("normalized"), F.col("source").alias("batch_id"), F.col("human").alias("label"), "label_source", "confidence")


def _queue(spark, sf):
    return _t(spark, sf, "documents").where("n_chars >= 1500").select(F.col("doc_id").alias("normalized"), (F.col("doc_id") + 1).alias("review_queue_rank"))


@query(f"SELECT count(*) AS comparable_count, count(*) FILTER (human = agent) AS correct_count, coalesce(count(*) FILTER (human = agent) / nullif(count(*), 0), 0)::DOUBLE AS accuracy FROM {LAB}")
def label_accuracy(spark, sf):
    return evaluation.accuracy(_labels(spark, sf))


@query(f"SELECT doc_id, confidence, confidence >= 0.85 AS grave FROM {LAB} WHERE human <> agent ORDER BY confidence DESC, source || '/' || doc_id LIMIT 100")
def label_mistakes(spark, sf):
    rows = _labels(spark, sf).withColumn("source", F.concat("source", F.lit("/"), "doc_id"))
    return evaluation.mistakes(rows, limit=100).select("doc_id", "confidence", "grave")


@query(f"""SELECT i.normalized, l.human AS label, coalesce(l.label_source, 'unlabeled') AS label_source, q.review_queue_rank, CAST(row_number() OVER (ORDER BY q.review_queue_rank IS NULL, q.review_queue_rank, CASE coalesce(l.label_source, 'unlabeled') WHEN 'agent' THEN 0 WHEN 'unlabeled' THEN 1 ELSE 2 END, lower(coalesce(i.title, i.source)), i.source) AS INTEGER) AS position
FROM {_ITEM} i LEFT JOIN {LAB} l ON l.doc_id = i.normalized LEFT JOIN {_QUEUE} q ON q.normalized = i.normalized WHERE i.allowed AND i.relevance_score >= 20 QUALIFY position <= 200""")
def review_rows(spark, sf):
    rows = evaluation.review_rows(_items(spark, sf).drop("batch_id"), _set(spark, sf).drop("batch_id"), _queue(spark, sf), min_relevance=20, limit=200)
    return rows.select("normalized", "label", "label_source", "review_queue_rank", "position")


@query(f"""SELECT '1.0' AS schema_version, i.batch_id, 'scan' AS batch_mode, i.normalized, i.source, i.title, i.relevance_score, l.human AS label, l.label_source, CASE WHEN l.label_source = 'human' THEN l.human END AS gold_label, CASE WHEN l.label_source = 'agent' THEN l.human END AS weak_label, l.confidence AS label_confidence, q.review_queue_rank, CAST(NULL AS VARCHAR) AS doi
FROM {_ITEM} i JOIN {LAB} l ON l.doc_id = i.normalized LEFT JOIN {_QUEUE} q ON q.normalized = i.normalized""")
def label_export_rows(spark, sf):
    batches = _t(spark, sf, "documents").select(F.col("source").alias("batch_id"), F.lit("scan").alias("mode")).distinct()
    queue = _queue(spark, sf).join(_items(spark, sf).select("normalized", "batch_id"), "normalized")
    rows = evaluation.export_rows(batches, _items(spark, sf), _set(spark, sf), queue)
    return rows.select("schema_version", "batch_id", "batch_mode", "normalized", "source", "title", "relevance_score", "label", "label_source", "gold_label", "weak_label", "label_confidence", "review_queue_rank", "doi")


@query(f"""SELECT i.*, n.*, a.*, e.* FROM (SELECT count(*) AS screened, count(*) FILTER (NOT allowed) AS blocked, count(*) FILTER (allowed) AS allowed, count(*) FILTER (allowed AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = normalized)) AS unlabeled_allowed FROM {_ITEM}) i,
(SELECT count(*) AS labeled, count(*) FILTER (label_source = 'human') AS human_labels, count(*) FILTER (label_source = 'agent') AS agent_labels FROM {LAB}) n, (SELECT count(*) FILTER (page_id % 5 <> 0) AS stored_pdfs, count(*) FILTER (page_id % 5 = 0) AS failed_pdfs FROM pages) a,
(SELECT count(*) FILTER (c AND r) AS evidence_items, count(*) FILTER (NOT (c AND r)) AS blocked_evidence_items, count(*) FILTER (c AND r AND t = 0) AS trusted_evidence_items, count(*) FILTER (t = 1) AS review_evidence_items, count(*) FILTER (t = 2) AS quarantined_evidence_items FROM (SELECT turn % 4 <> 3 AS c, role = 'assistant' AS r, turn % 3 AS t FROM conversations)) e""")
def run_counts(spark, sf):
    turn = F.col("turn")
    artifacts = _t(spark, sf, "pages").select(F.when(F.col("page_id") % 5 == 0, "blocked").otherwise("stored").alias("status"))
    found = _t(spark, sf, "conversations").select(F.when(turn % 4 != 3, "clean").otherwise("blocked").alias("quality_label"), (F.col("role") == "assistant").alias("reportable"), F.when(turn % 3 == 0, "trusted").when(turn % 3 == 1, "review").otherwise("quarantined").alias("trust_label"))
    return evaluation.run_counts(_items(spark, sf), _set(spark, sf), artifacts, found)


@query(f"SELECT normalized, relevance_score FROM {_ITEM} i WHERE allowed AND relevance_score >= 60 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.normalized) ORDER BY relevance_score DESC, source LIMIT 50")
def high_relevance_unlabeled(spark, sf):
    return evaluation.high_relevance_unlabeled(_items(spark, sf), _set(spark, sf), limit=50).select("normalized", "relevance_score")


@query("SELECT count(*) AS parser_attempt_count, count(*) FILTER (page_id % 5 <> 0) AS stored_pdf_count, count(*) FILTER ((page_id % 10) / 10.0 < 0.6 OR page_id % 6 = 0) AS low_confidence_count FROM pages WHERE page_id % 4 <> 0")
def parser_quality(spark, sf):
    p = F.col("page_id")
    flags = F.when(p % 6 == 0, F.array(F.lit("low_confidence"))).otherwise(F.array(F.lit("short_page")))
    return evaluation.parser_quality(_t(spark, sf, "pages").select(F.when(p % 4 != 0, "text").alias("parser_name"), F.when(p % 5 == 0, "blocked").otherwise("stored").alias("status"), ((p % 10) / 10.0).alias("parse_confidence"), flags.alias("parse_flags")))


@query("SELECT source, count(*) AS screened, count(*) FILTER (coalesce(lang, '') <> 'fr') AS allowed, count(*) FILTER (coalesce(lang, '') = 'fr') AS blocked, count(*) FILTER (n_chars >= 2000) AS stored_pdfs FROM documents GROUP BY source")
def batch_coverage(spark, sf):
    d = _t(spark, sf, "documents").select("source", (F.coalesce("lang", F.lit("")) != "fr").alias("allowed"), F.when(F.col("n_chars") >= 2000, "stored").otherwise("blocked").alias("status"))
    return evaluation.coverage(d.select("source", "allowed"), d.select("source", "status"), ["source"])


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE turn % 4 <> 3) WHERE k <= 2 QUALIFY place <= 12")
def evidence_preview(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("evidence_type"), F.when(F.col("turn") % 4 != 3, "trusted").otherwise("review").alias("trust_label"))
    return evaluation.preview(c, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "place")


@query("""SELECT d.doc_id, p.paper, p.title, p.paper || ' p' || (d.doc_id % 9 + 1) AS citation FROM documents d JOIN (SELECT item_id, left(text, 20) AS title, 'P' || row_number() OVER (ORDER BY item_id) AS paper FROM benchmark WHERE item_id % 5 <> 0) p ON p.item_id = d.doc_id % (SELECT count(*) FROM benchmark) WHERE d.n_chars >= 300""")
def cited_papers(spark, sf):
    b = _t(spark, sf, "benchmark").withColumn("source", F.concat(F.lit("b/"), "item_id"))
    artifacts = b.select(F.col("item_id").alias("artifact_id"), "source", F.when(F.col("item_id") % 5 != 0, "stored").otherwise("blocked").alias("status"))
    found = _t(spark, sf, "documents").select("doc_id", (F.col("doc_id") % max(1, b.count())).alias("artifact_id"), (F.col("doc_id") % 9 + 1).alias("page_number"), F.when(F.col("n_chars") >= 300, "trusted").otherwise("review").alias("trust_label"))
    return evaluation.cited_evidence(artifacts, b.select("source", F.left("text", F.lit(20)).alias("title")), found, [F.col("artifact_id")]).select("doc_id", "paper", "title", "citation")


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality <> 1) AS failed, round(count(*) FILTER (quality = 1) / count(*), 3)::DOUBLE AS pass_rate FROM labels")
def suite_totals(spark, sf):
    return evaluation.suite_totals(_t(spark, sf, "labels").withColumn("passed", F.col("quality") == 1))


@query("SELECT array_to_string(list_sort(list_distinct(list(source) FILTER (source <> ''))), '|') AS source, array_to_string(list_sort(list_distinct(list(lang) FILTER (lang <> ''))), '|') AS lang FROM documents")
def distinct_providers(spark, sf):
    return evaluation.distinct_sorted(_t(spark, sf, "documents"), ["source", "lang"])


# --- store ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 7 ELSE 0 END AS limit_value FROM orders")
def store_update(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("limit_value"), F.col("o_orderdate").alias("updated_at"))
    first = orders.agg(F.min("o_orderkey")).first()[0]
    return store.update_fields(orders, "o_orderkey", first, {"status": "done", "limit": 7}, F.lit("2024-01-01").cast("timestamp")).select("o_orderkey", "status", "limit_value")


@query("SELECT c_custkey AS batch_id, coalesce(s, 0)::BIGINT AS screened_count, coalesce(b, 0)::BIGINT AS blocked_count, (coalesce(s, 0) - coalesce(b, 0))::BIGINT AS allowed_count, coalesce(d, 0)::BIGINT AS deep_read_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS s, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_totalprice > 100000) AS d FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def store_sync_counts(spark, sf):
    runs = store.with_zero_counters(_t(spark, sf, "customer").select(F.col("c_custkey").alias("batch_id")))
    batches = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.count("*").alias("screened_count"), F.count_if(F.col("o_orderstatus") == "F").alias("blocked_count"), F.count_if(F.col("o_totalprice") > 100000).alias("deep_read_count"))
    return store.sync_counts(runs, batches).select("batch_id", *store.COUNTERS)


@query("""SELECT user_id, CASE WHEN s.who = 'human' THEN s.label ELSE l.label END AS label, CASE WHEN s.who = 'human' THEN s.who ELSE l.who END AS label_source, created_at, CASE WHEN s.who = 'human' THEN s.ts ELSE l.ts END AS updated_at FROM (SELECT user_id, min(ts) AS created_at, arg_max(r, (ts, event_id)) FILTER (r.who = 'human' OR event_id % 7 = 0) AS s, arg_max(r, (ts, event_id)) AS l
FROM (SELECT user_id, ts, event_id, {'label': CASE event_type WHEN 'purchase' THEN 'relevant' WHEN 'signup' THEN 'maybe' ELSE 'irrelevant' END, 'who': CASE WHEN event_id % 5 = 0 THEN 'human' ELSE 'agent' END, 'ts': ts} AS r FROM events WHERE event_id % 12 <> 11) GROUP BY user_id)""")
def label_events(spark, sf):
    i = F.col("event_id")
    e = _t(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "purchase", " Relevant").when(F.col("event_type") == "signup", "maybe").otherwise("irrelevant").alias("label"), F.when(i % 5 == 0, "human").otherwise("agent").alias("label_source"), ((i % 12) / 10.0).alias("confidence"), (i % 7 == 0).alias("overwrite_human"), F.col("ts").alias("at"), i.alias("ordinal"))
    return store.apply_labels(e, ["user_id"]).drop("confidence")


@query("SELECT w.page_id, min(i.page_id) AS item_page_id FROM pages w JOIN pages i ON lower(i.url) = lower(w.url) GROUP BY w.page_id")
def match_sources(spark, sf):
    p = _t(spark, sf, "pages")
    wanted = p.select("page_id", F.when(F.col("page_id") % 3 == 0, "none").otherwise(F.concat(F.lit(" "), "url")).alias("source"), F.lower("url").alias("normalized"))
    items = p.select("page_id", F.col("url").alias("source"), F.lower("url").alias("normalized"))
    return store.match_sources(wanted, items, ["page_id"]).select("page_id", "item_page_id")


@query("SELECT doc_id, CAST(k AS INTEGER) AS page_number, CAST(length(p) AS INTEGER) AS char_count FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))")
def pages_numbered(spark, sf):
    return store.number_pages(_t(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("pages"))).select("doc_id", "page_number", "char_count")


# --- candidates, topics, drafts ---------------------------------------------------------------------------------------

_CAND = "(SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'doi:10.1/x' || (page_id % 40) WHEN page_id % 4 = 1 THEN 'pmid:' || (page_id % 30) WHEN page_id % 4 = 2 THEN 'arxiv:ab' || (page_id % 26) ELSE 'source:' || lower(url) END AS key FROM pages)"


@query(f"SELECT key, min(page_id) AS page_id FROM {_CAND} GROUP BY key")
def candidate_identity(spark, sf):
    p = F.col("page_id")
    c = _t(spark, sf, "pages").select("page_id", F.when(p % 4 == 0, F.concat(F.lit("10.1/X"), p % 40)).otherwise("").alias("doi"), F.when(p % 4 == 1, (p % 30).cast("string")).alias("pmid"), F.when(p % 4 == 2, F.concat(F.lit("AB"), p % 26)).alias("arxiv_id"), F.col("url").alias("source"))
    return candidates.dedupe(c, ["page_id"]).select("key", "page_id")


_RT = "list_distinct(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: CASE WHEN t IN ('mathematics', 'mathematical', 'mathematic') THEN 'math' WHEN length(t) > 4 AND t LIKE '%ies' THEN regexp_replace(t, 'ies$', 'y') WHEN length(t) > 4 AND t LIKE '%s' THEN regexp_replace(t, 's$', '') ELSE t END))"
_ASK = "['tion', 'web', 'en', 'crawl']"
_RH = lambda c, w: f"{w} * len(list_intersect({_RT.format(c=c)}, {_ASK}))"


@query(f"""SELECT doc_id, score, matched, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, CAST({_RH('lang', 8)} + {_RH('text', 4)} + {_RH('source', 6)} + {_RH('source', 2)} + {_RH('lang', 1)} + {_RH("source || ' ' || doc_id", 1)} AS INTEGER) AS score, array_to_string(list_sort(list_intersect({_RT.format(c="concat_ws(' ', lang, text, source)")}, {_ASK})), ',') AS matched FROM documents) WHERE score >= 12 QUALIFY rank <= 20""")
def corpus_route_fields(spark, sf):
    fields = {"title": F.col("lang"), "abstract": F.col("text"), "tags": F.col("source"), "venue": F.col("source"), "authors": F.col("lang"), "identifiers": F.concat("source", F.lit(" "), "doc_id")}
    top = candidates.route(_t(spark, sf, "documents"), "What is the Tion of web en crawls?", fields, [F.col("doc_id")])
    return top.select("doc_id", "score", F.array_join("matched_terms", ",").alias("matched"), F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"))


def _records(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit("; "), "source", F.lit(", "), "lang", F.lit(" "), "source").alias("concepts"), F.lit(None).cast("string").alias("mesh_terms"), F.col("source").alias("journal"), "text")


_STOP = ", ".join(f"'{t}'" for t in topics.STOP_TERMS)
_TERMS = f"""(SELECT term, CAST(sum(w) AS BIGINT) AS n, min(doc_id * 100000000 + p) AS first {{more}} FROM (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS p, CASE WHEN p <= nc THEN 2 ELSE 1 END AS w FROM (SELECT doc_id, len(c) AS nc, list_concat(c, list_transform(list_zip(k[:-2], k[2:]), lambda x: x[1] || ' ' || x[2]), list_transform(list_zip(k[:-3], k[2:-2], k[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) AS l
FROM (SELECT doc_id, list_filter([source, lang || ' ' || source, source], lambda t: length(t) >= 3) AS c, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9-]*'), lambda t: length(t) > 2 AND lower(t) NOT IN ({_STOP})) AS k FROM documents {{where}}))) WHERE trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) <> '' GROUP BY term)"""


@query(f"SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank FROM {_TERMS.format(more='', where='')} QUALIFY rank <= 12")
def metadata_terms(spark, sf):
    top = topics.top_terms(_records(spark, sf), "doc_id")
    return top.select("term", "n", F.row_number().over(W.orderBy(F.desc("n"), "first")).alias("rank"))


_GOOD, _BAD = (_TERMS.format(more="", where=f"WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = {q})") for q in (1, 0))


@query(f"WITH good AS (SELECT term, n FROM {_GOOD} ORDER BY n DESC, first LIMIT 12), bad AS (SELECT term, n FROM {_BAD} ORDER BY n DESC, first LIMIT 12) SELECT term, n, 'positive' AS kind FROM good UNION ALL SELECT term, n, 'negative' FROM bad WHERE term NOT IN (SELECT term FROM good)")
def learned_terms(spark, sf):
    marks = _t(spark, sf, "labels").select("doc_id", "quality")
    rows = _records(spark, sf)
    return topics.learned_terms(*(rows.join(marks.where(F.col("quality") == q), "doc_id", "left_semi") for q in (1, 0)), order="doc_id")


@query("""SELECT conv_id, 'R' || row_number() OVER (PARTITION BY conv_id ORDER BY place, turn, rule) AS id, source, rule, severity FROM (SELECT conv_id, 0 AS place, turn, 'prose' AS source, 'source_author_voice' AS rule, 'important' AS severity FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, 1, turn, 'critic', CASE WHEN role = 'user' THEN 'unsupported' ELSE 'critic_rejected' END, CASE WHEN role = 'user' THEN 'blocking' ELSE 'important' END FROM conversations WHERE length(text) >= 400
UNION ALL SELECT conv_id, 2, 0, 'draft_review', 'final_human_check', 'low' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant' OR length(text) >= 400) = 0)""")
def review_issues(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("ordinal", F.col("turn").cast("long"))
    prose = c.where("role = 'assistant'").withColumn("rule", F.lit("source_author_voice"))
    critic = c.where("length(text) >= 400").withColumn("rule", F.when(F.col("role") == "user", "unsupported").otherwise("critic_rejected"))
    return drafts.review_items([("prose", "important", prose), ("critic", "important", critic)], c, "conv_id").select("conv_id", "id", "source", "rule", "severity")


_D = {**drafts.DECISIONS}


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{_D["approve"]}' WHEN 1 THEN '{_D["reject"]}' WHEN 2 THEN '{_D["needs_rewrite"]}' WHEN 3 THEN '{drafts.OTHER_DECISION}' ELSE CASE WHEN quality = 0 OR toxic = 1 THEN '{drafts.BLOCKED}' WHEN doc_id % 6 = 4 THEN '{drafts.QUEUE.format("review-draft")}' ELSE '{drafts.SKIM}' END END AS action FROM labels""")
def next_actions(spark, sf):
    d = F.col("doc_id") % 6
    decision = F.when(d == 0, "approve").when(d == 1, "citation_issue").when(d == 2, "too_confusing").when(d == 3, "")
    action = F.when(F.col("quality") == 0, "block").when(d == 4, "human_review").otherwise("publish")
    return _t(spark, sf, "labels").select("doc_id", drafts.next_action(decision, action, F.col("toxic") == 1).alias("action"))
