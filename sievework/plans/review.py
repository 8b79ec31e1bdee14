"""Registered queries of relevance, topics, labels, page scores and report audits, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planning, text
from ..operators import curation, labelling, relevance, report
from .registry import NORM, TOK, _t, query

WEIGHTS = relevance.Weights(biomedical={"the": 3, "tion": 9, "of the": 10}, maldi={"und": 7}, nlp={"les": 8}, metadata={"en": 6, "de": 4}, provider={"web": 14, "forum": 8}, amr=("les",))
TOPIC = planning.Topic("the tion", "t", "prose", core=("the",), positive=("und", "les"), negative=("ch", "de"), components={"a": ("the", "und"), "b": ("les",)}, needed=("a",))
ASKED = ("and", "les", "the", "tion", "und", "with")


def _items(spark, sf):
    """Documents as candidates: the text as title, the language as concepts, the source as provider."""
    d = _t(spark, sf, "documents")
    null = F.lit(None).cast("string")
    return d.select("doc_id", F.col("source").alias("provider"), F.col("text").alias("title"), null.alias("abstract"), null.alias("journal"), F.col("lang").alias("concepts"), null.alias("mesh_terms"), null.alias("doi"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("pmid"), (F.col("doc_id") % 80).cast("int").alias("relevance_score"))


def _hit(n: str, t: str) -> str:
    return f"contains(' ' || {n} || ' ', ' {t} ')"


def _sum(n: str, table: dict[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {_hit(n, t)} THEN {w} ELSE 0 END" for t, w in table.items()) + ")"


def _names(label: str, n: str, table, most: int) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {_hit(n, t)} THEN '{t}' END" for t in table) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN '{label}=' || array_to_string({found}[:{most}], ',') END"


_BASE = f"(SELECT doc_id, source, {NORM.format(c="concat_ws(' ', text, lang, source)")} AS n, {NORM.format(c='lang')} AS m, {NORM.format(c="concat_ws(' ', text, lang)")} AS r FROM documents)"
_BIO, _META, _MALDI, _CORE = _sum("n", WEIGHTS.biomedical), _sum("m", WEIGHTS.metadata), _sum("n", WEIGHTS.maldi), _sum("n", {"the": 36, "und": 16, "les": 16})
_CLASH = f"({_CORE} = 0 AND ({_hit('n', 'ch')} OR {_hit('n', 'de')}))"


@query(f"""SELECT doc_id, CAST(greatest(0, least(100, 5 + CASE source WHEN 'web' THEN 14 WHEN 'forum' THEN 8 ELSE 0 END + {_BIO} + {_META} + {_MALDI} + {_CORE} - CASE WHEN {_CLASH} THEN least(80, {_sum('n', {'ch': 18, 'de': 18})} + 18) ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 0 END)) AS INTEGER) AS relevance_score,
array_to_string(list_filter(['provider=' || coalesce(source, ''), {_names('biomedical_terms', 'n', WEIGHTS.biomedical, 5)}, {_names('metadata_terms', 'm', WEIGHTS.metadata, 5)}, {_names('maldi_context', 'n', WEIGHTS.maldi, 3)}, {_names('topic_terms', 'n', ('the', 'und', 'les'), 6)},
CASE WHEN {_CLASH} THEN {_names('topic_collision_penalty', 'n', ('ch', 'de'), 4)} END, CASE WHEN doc_id % 2 = 0 THEN 'identifier_bonus' END, CASE WHEN {_BIO} = 0 AND {_META} = 0 AND {_MALDI} = 0 THEN 'not_biomedical' END], lambda x: x IS NOT NULL), '; ') AS relevance_reason FROM {_BASE}""")
def relevance_reasons(spark, sf):
    scored = relevance.score(_items(spark, sf), "the tion", planning.Plan("the tion", "unknown", ()), TOPIC, WEIGHTS)
    return scored.select("doc_id", "relevance_score", "relevance_reason")


_N = lambda *ts: "(" + " + ".join(f"CAST({_hit('r', t)} AS INTEGER)" for t in ts) + ")"
_A, _B = f"({_hit('r', 'the')} OR {_hit('r', 'und')})", _hit("r", "les")


@query(f"""SELECT doc_id, score, CASE WHEN NOT a OR q = 0 THEN 'topic_mismatch' WHEN NOT ev THEN 'weak_topic_match' ELSE 'topic_match' END AS status,
CASE WHEN NOT a THEN 'missing_topic_component' WHEN q = 0 AND NOT ev AND neg > 0 THEN 'negative_terms_without_topic_evidence' WHEN q = 0 THEN 'missing_query_focus' WHEN NOT ev THEN 'missing_profile_terms' ELSE 'query_and_profile_terms_matched' END AS reason
FROM (SELECT doc_id, CAST(12 * q + 10 * c + 4 * p + 6 * (CAST(a AS INTEGER) + CAST(b AS INTEGER)) - 20 * CAST(NOT a AS INTEGER) - 10 * neg AS INTEGER) AS score, a, q, c + p > 0 AS ev, neg FROM (SELECT doc_id, {_A} AS a, {_B} AS b, {_N('tion')} AS q, {_N('the')} AS c, {_N('und', 'les')} AS p, {_N('ch', 'de')} AS neg FROM {_BASE}))""")
def topic_curation(spark, sf):
    return relevance.curate(_items(spark, sf), TOPIC).select("doc_id", "curation.score", "curation.status", "curation.reason")


@query(f"""SELECT label, confidence, count(*) AS n_items FROM (SELECT label, round(CASE label WHEN 'relevant' THEN least(0.95, 0.62 + 0.08 * n + r / 250.0) WHEN 'maybe' THEN least(0.8, 0.55 + 0.07 * n + r / 300.0) ELSE least(0.9, 0.68 + greatest(0, 25 - r) / 200.0) END, 3)::DOUBLE AS confidence
FROM (SELECT *, CASE WHEN n >= 3 OR r >= 65 THEN 'relevant' WHEN n >= 2 OR (n >= 1 AND r >= 15) OR r >= 25 THEN 'maybe' ELSE 'irrelevant' END AS label
FROM (SELECT CAST(doc_id % 80 AS DOUBLE) AS r, CAST(len(list_intersect({TOK.format(c="concat_ws(' ', text, lang)")}, ['les', 'tion', 'und'])) AS DOUBLE) AS n FROM documents))) GROUP BY ALL""")
def regime_labels(spark, sf):
    return labelling.auto_label(_items(spark, sf), ASKED).groupBy("label", "confidence").agg(F.count("*").alias("n_items"))


@query("""SELECT doc_id, label, CASE WHEN c BETWEEN 0 AND 1 THEN c END AS confidence FROM (SELECT doc_id, quality AS q, CASE WHEN quality = 1 THEN 'relevant' ELSE 'maybe' END AS label, CAST((doc_id % 15) / 10.0 AS DOUBLE) AS c FROM labels)""")
def prior_labels(spark, sf):
    c = F.format_string("previous_agent_label=%s;agent_confidence=%s", F.when(F.col("quality") == 1, "Relevant").otherwise("maybe"), (F.col("doc_id") % 15 / 10.0).cast("decimal(4,1)").cast("string"))
    noted = _t(spark, sf, "labels").select("doc_id", c.alias("signals"))
    return noted.select("doc_id", labelling.prior_agent_label(F.col("signals"), F.lit(None).cast("string")).alias("p")).where("p is not null").select("doc_id", "p.*")


@query("""SELECT doc_id, round(1 - CASE WHEN n < 20 THEN 0.25 ELSE 0 END - CASE WHEN s THEN 0.45 ELSE 0 END - CASE WHEN w THEN 0.1 ELSE 0 END, 3)::DOUBLE AS confidence, array_to_string(list_filter([CASE WHEN n < 20 THEN 'short_page' END, CASE WHEN s THEN 'column_stitching' END, CASE WHEN w THEN 'wide_spacing' END], lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\t-\\r\\x{85}\\p{Z}]+')) AS n, contains(text, 'Articles seTo') OR contains(text, 'reSearch strategy') AS s, contains(text, repeat(' ', 16)) AS w FROM documents)""")
def page_parse(spark, sf):
    pages = _t(spark, sf, "documents").select("doc_id", curation.parse_score(F.col("text")).alias("p"))
    return pages.select("doc_id", "p.confidence", F.array_join("p.flags", ",").alias("flags"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'unsupported_block_status' WHEN turn % 4 = 0 THEN 'no_page_anchored_evidence' WHEN turn % 3 = 0 THEN 'missing_page_citation' WHEN turn % 2 = 0 THEN 'unknown_page_citation' ELSE 'page_anchored' END AS reason, CAST(CASE WHEN turn % 5 <> 0 AND turn % 4 <> 0 AND turn % 3 <> 0 AND turn % 2 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS evidence_count FROM conversations""")
def paragraph_audit(spark, sf):
    t = F.col("turn")
    said = F.concat(F.lit("Said "), F.when(t % 3 == 0, "").when(t % 2 == 0, "[P1 p2; P9  p9]").otherwise("[P1  p2]"))
    blocks = _t(spark, sf, "conversations").select("conv_id", "turn", F.concat("conv_id", F.lit("-"), "turn").alias("block_id"), F.when(t % 5 != 0, "SUPPORTED").alias("status"), said.alias("paragraph"), F.when(t % 4 != 0, F.array(F.lit("P1 p2"))).alias("citations"))
    return report.paragraph_audit(blocks).select("conv_id", "turn", "reason", "evidence_count")


@query("""SELECT doc_id, CAST(least(100, CASE WHEN c THEN 40 ELSE 100 END, CASE WHEN f THEN 45 ELSE 100 END, CASE WHEN b THEN 55 ELSE 100 END, CASE WHEN s THEN 85 ELSE 100 END, CASE WHEN p THEN 70 ELSE 100 END, CASE WHEN NOT c AND NOT f AND (k OR s) THEN 85 ELSE 100 END) AS INTEGER) AS score,
CASE WHEN c OR f THEN 'blocked' WHEN NOT k AND NOT s THEN 'publishable' ELSE 'needs_review' END AS verdict, array_to_string(list_filter([CASE WHEN c THEN 'citation_audit_failed' END, CASE WHEN f THEN 'faithfulness_failed' END, CASE WHEN b THEN 'tier_b_failed' END, CASE WHEN s THEN 'semantic_verifier_not_run' END, CASE WHEN p THEN 'prose_quality_failed' END,
CASE WHEN c OR f THEN NULL WHEN NOT k AND NOT s THEN 'critic_passed' WHEN k THEN 'critic_not_run' ELSE 'critic_not_passed' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT doc_id, doc_id % 7 = 0 AS c, doc_id % 5 = 0 AS f, doc_id % 4 = 0 AS b, doc_id % 2 = 0 AS s, doc_id % 9 = 0 AS p, doc_id % 3 = 0 AS k FROM documents)""")
def trust_ladder(spark, sf):
    d, bad = F.col("doc_id"), lambda n, word="fallback": F.when(F.col("doc_id") % n == 0, word).otherwise("pass")
    status = {"citation": bad(7), "faithfulness": bad(5), "tier_a": F.lit("pass"), "tier_b": bad(4), "plan_adherence": F.lit("unknown"), "semantic_faithfulness": bad(2, "skipped"), "prose_quality": bad(9), "critic": bad(3, "not_run")}
    t = _t(spark, sf, "documents").select(d, report.report_trust(status).alias("t"))
    return t.select("doc_id", "t.score", "t.verdict", F.array_join("t.reasons", ",").alias("reasons"))


@query("""SELECT conv_id, count(*) AS critic_count, CAST(sum(turn % 2) AS BIGINT) AS issue_count, array_to_string(list_sort(list_distinct(list(role) FILTER (turn % 2 <> 0))), ',') AS failed_kinds, CASE WHEN count(*) FILTER (turn % 2 <> 0) = 0 THEN 'pass' ELSE 'fallback' END AS status FROM conversations GROUP BY conv_id""")
def critic_panel(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", F.col("role").alias("kind"), F.lit("pass").alias("verdict"), (F.col("turn") % 2).alias("issue_count"))
    return report.critic_panel(c, "conv_id").select("conv_id", "critic_count", "issue_count", F.array_join("failed_critic_kinds", ",").alias("failed_kinds"), "status")


@query("""SELECT l_orderkey, array_to_string(list_transform(list_sort(list_distinct(list({'a': l_suppkey, 'b': l_linenumber}))), lambda x: 'P' || x.a || ' p' || x.b), '; ') AS ordered, '[' || array_to_string(list_transform(list_sort(list_distinct(list({'a': l_suppkey, 'b': l_linenumber}))), lambda x: x.a || ', p. ' || x.b), '; ') || ']' AS shown FROM lineitem GROUP BY l_orderkey""")
def citation_display(spark, sf):
    c = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.sort_citations(F.collect_set(F.concat(F.lit("P"), "l_suppkey", F.lit(" p"), "l_linenumber"))).alias("c"))
    return c.select("l_orderkey", F.array_join("c", "; ").alias("ordered"), text.display_citations(F.col("c")).alias("shown"))
