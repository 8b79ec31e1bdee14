"""Registered queries of repair and bounded revision, with their SQL for DuckDB.

A conversation's assistant turns are the drafts and its users' next turns what a verifier says of them; citations are put
around the texts by a row's own numbers. Orders are reports and their line items the answers at each attempt.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import relational, repair, report, revision
from .audits import _LIST, _pick, _terms
from .registry import _t, query

ALLOWED = ("P1 p1", "P2 p2", "P3 p1", "P1 p3", "P2 p1")
_FOLD = lambda c: f"replace(lower({c}), 'ß', 'ss')"
_UNIQUE = lambda c: f"list_filter({c}, lambda e, i: list_position({c}, e) = i)"
_SQUEEZED = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_CITED = "(?i)\\bP\\d+\\s+p\\d+\\b"
_LOOSE = lambda c: f"list_transform(regexp_extract_all({c}, '{_CITED}'), lambda m: {_SQUEEZED('m')})"


def _sentences_sql(c: str) -> str:
    kept = f"regexp_replace(regexp_replace({c}, '(^|[^A-Za-z])([A-Z])\\.\\s+([a-z])', '\\1\\2' || chr(2) || ' \\3', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g')"
    tidy = f"list_transform(string_split_regex({kept}, chr(1) || '|\\n+'), lambda s: {_SQUEEZED('replace(s, chr(2), chr(46))')})"
    return f"list_filter({tidy}, lambda s: NOT regexp_matches(s, '^(#|-*$)'))"


def _words_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '(?i)P\\d+\\s+p\\d+', ' ', 'g'), '[^A-Za-z0-9 βµ-]+', ' ', 'g')"
    return f"list_filter(string_split_regex({_FOLD(bare)}, ' +'), lambda w: length(w) > 3)"


_RUNS = "flatten([" + ", ".join(f"list_transform(range(1, greatest(len(w) - {k - 2}, 1)), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (2, 3, 4, 5)) + "])"
_DRAFT = "'[P' || (turn % 3 + 1) || ' p' || (conv_id % 4 + 1) || '] ' || text || ' [P' || (conv_id % 3 + 1) || ' p' || (turn % 4) || '].'"
_TOLD = "CASE (conv_id + turn) % 5 WHEN 1 THEN 'see  p1  P2 or P' || (conv_id % 3 + 1) || ' p1' WHEN 2 THEN regexp_extract(text, '[A-Za-z]{4,}', 0) WHEN 3 THEN '' ELSE text END"
_CONTEXT = f"""WITH drafts AS (SELECT conv_id, turn, {_DRAFT} AS draft FROM conversations WHERE role = 'assistant'), fails AS (SELECT conv_id, turn - 1 AS turn, {_TOLD} AS f FROM conversations WHERE role = 'user'),
cut AS (SELECT conv_id, turn, draft, {_sentences_sql('draft')} AS s, coalesce(f, '') AS f FROM drafts LEFT JOIN fails USING (conv_id, turn)), words AS (SELECT *, {_words_sql('f')} AS w, {_UNIQUE(_LOOSE('f'))} AS cited FROM cut),
terms AS (SELECT *, CASE WHEN len(w) = 1 THEN w ELSE {_RUNS} END AS ts FROM words),
hit AS (SELECT *, list_filter(s, lambda x: len(list_filter(ts, lambda t: contains({_FOLD('x')}, t))) > 0) AS named, list_filter(s, lambda x: len(list_filter(cited, lambda c: regexp_matches(x, '[\\[;] *' || c || ' *[\\];]'))) > 0) AS shared FROM terms),
chosen AS (SELECT *, CASE WHEN len(named) > 0 THEN 'terms' WHEN len(cited) > 0 THEN 'citations' ELSE 'opening' END AS level, CASE WHEN len(named) > 0 THEN named WHEN len(cited) > 0 THEN shared ELSE s[1:2] END AS c FROM hit),
behind AS (SELECT *, {_UNIQUE('c')} AS failed, list_concat(cited, flatten(list_transform(c, lambda x: {_LOOSE('x')}))) AS b FROM chosen), named AS (SELECT *, CASE WHEN len(b) > 0 THEN b ELSE regexp_extract_all(draft, '\\[(P\\d+ p\\d+)\\]', 1) END AS n FROM behind)"""


def _contexts(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    said = _t(spark, sf, "conversations")
    draft = F.concat(F.lit("[P"), s(t % 3 + 1), F.lit(" p"), s(c % 4 + 1), F.lit("] "), "text", F.lit(" [P"), s(c % 3 + 1), F.lit(" p"), s(t % 4), F.lit("]."))
    k = (c + t) % 5
    told = F.when(k == 1, F.concat(F.lit("see  p1  P2 or P"), s(c % 3 + 1), F.lit(" p1"))).when(k == 2, F.regexp_extract("text", "[A-Za-z]{4,}", 0)).when(k == 3, "").otherwise(F.col("text"))
    drafts = said.where("role = 'assistant'").select("conv_id", "turn", draft.alias("draft"), F.array(*[F.lit(x) for x in ALLOWED]).alias("allowed"))
    failures = said.where("role = 'user'").select("conv_id", (t - 1).alias("turn"), F.lit(0).alias("ordinal"), told.alias("text"))
    return repair.repair_context(drafts, failures, ["conv_id", "turn"])


@query(f"{_CONTEXT} SELECT conv_id, turn, level, array_to_string(failed, ' / ') AS failed_sentences, array_to_string(list_filter({_UNIQUE('n')}, lambda x: list_contains({_LIST(ALLOWED)}, x)), '; ') AS implicated FROM named")
def repair_context(spark, sf):
    return _contexts(spark, sf).select("conv_id", "turn", "level", F.array_join("failed_sentences", " / ").alias("failed_sentences"), F.array_join("implicated", "; ").alias("implicated"))


_ENTRIES = "(SELECT conv_id, turn - 2 AS turn, turn AS ordinal, ['P' || (conv_id % 3 + 1) || ' p' || (turn % 4), 'P1 p1'] AS cs, text, conv_id % 2 = 0 AS tabled FROM conversations WHERE role = 'assistant' AND turn >= 2)"


@query(f"""{_CONTEXT}, entries AS (SELECT e.*, list_filter({_UNIQUE('n')}, lambda x: list_contains({_LIST(ALLOWED)}, x)) AS i FROM {_ENTRIES} e JOIN named USING (conv_id, turn)), own AS (SELECT *, list_filter(cs, lambda x, k: list_contains(i, x) AND list_position(cs, x) = k) AS o FROM entries)
SELECT conv_id, turn, ordinal, 0 AS place, array_to_string(o, '; ') AS citations, text FROM own WHERE len(o) > 0 AND NOT (tabled AND list_contains(o, cs[1])) UNION ALL SELECT conv_id, turn, ordinal, 0, cs[1], 'row of ' || ordinal FROM own WHERE len(o) > 0 AND tabled AND list_contains(o, cs[1])""")
def repair_rows(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    first = F.concat(F.lit("P"), (c % 3 + 1).cast("string"), F.lit(" p"), (t % 4).cast("string"))
    tabled = F.when(c % 2 == 0, F.array(F.struct(first.alias("citation"), F.concat(F.lit("row of "), t.cast("string")).alias("text"))))
    entries = _t(spark, sf, "conversations").where("role = 'assistant' AND turn >= 2").select("conv_id", (t - 2).alias("turn"), t.alias("ordinal"), F.array(first, F.lit("P1 p1")).alias("citations"), "text", tabled.alias("table_rows"))
    out = repair.repair_rows(_contexts(spark, sf), entries, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "ordinal", "place", F.array_join("citations", "; ").alias("citations"), "text")


_ENDINGS = (" [P1 p1].", " [P1 p1].", " [P2 p2; P1 p1].", " [P9 p9].", "")
_WORD = "regexp_extract(text, '[A-Za-z]{5,}', 0)"
_SAYS = f"""CASE length(text) % 5 WHEN 0 THEN '{{"verdict": "pass", "unsupported_claims": []}}' WHEN 1 THEN 'no object here' ELSE 'Answer: {{"status": "Fail", "unsupported_claims": ["' || {_WORD} || '", " "]}} end' END"""
_BARE = "trim(regexp_replace(text, '[.!?#\\n-]+', ' ', 'g'))"


@query(f"""WITH made AS (SELECT conv_id, (turn + 1) // 2 AS attempt, length(text) % 7 <> 0 AS success, {_BARE} || {_LIST(_ENDINGS)}[CAST((conv_id + (turn + 1) // 2) % 5 AS INTEGER) + 1] AS t, CASE WHEN (conv_id + (turn + 1) // 2) % 5 = 3 THEN 'unknown_citation' WHEN (conv_id + (turn + 1) // 2) % 5 = 4 THEN 'missing_citations' ELSE 'evidence_bound' END AS gate FROM conversations WHERE role = 'assistant'),
says AS (SELECT conv_id, turn // 2 AS attempt, {_SAYS} AS v, {_WORD} AS word FROM conversations WHERE role = 'user' AND turn > 0), drafts AS (SELECT conv_id, {_BARE} || ' [P1 p1].' AS draft FROM conversations WHERE turn = 0),
j AS (SELECT d.conv_id, k AS attempt, coalesce(t, '') AS t, d.draft, CASE WHEN NOT coalesce(success, false) THEN 'model_unavailable' ELSE gate END AS composer_reason, v, word FROM drafts d CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) LEFT JOIN made m ON m.conv_id = d.conv_id AND m.attempt = k LEFT JOIN says s ON s.conv_id = d.conv_id AND s.attempt = k),
r AS (SELECT *, CASE WHEN composer_reason = 'evidence_bound' THEN CASE WHEN v IS NULL THEN 'verifier_unavailable' WHEN v = 'no object here' THEN 'verifier_unparseable' WHEN contains(v, 'pass') THEN 'verified' ELSE 'verifier_rejected' END END AS verifier_reason FROM j),
w AS (SELECT *, coalesce(bool_and(coalesce(verifier_reason = 'verifier_rejected', false)) OVER (PARTITION BY conv_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open, lag(t) OVER (PARTITION BY conv_id ORDER BY attempt) AS prior, lag(word) OVER (PARTITION BY conv_id ORDER BY attempt) AS complaint FROM r)
SELECT conv_id, CAST(attempt AS INTEGER) AS attempt, attempt = 3 OR NOT coalesce(verifier_reason = 'verifier_rejected', false) AS last, CASE WHEN verifier_reason = 'verified' THEN 'pass' ELSE 'fallback' END AS status, CASE verifier_reason WHEN 'verified' THEN 'revision_verified' WHEN 'verifier_rejected' THEN 'revision_rejected' ELSE coalesce(verifier_reason, 'revision_not_trusted') END AS reason, composer_reason, verifier_reason,
CASE WHEN attempt > 1 AND length(complaint) >= 4 AND contains({_FOLD('prior')}, lower(complaint)) THEN 'terms' ELSE 'opening' END AS level, CASE WHEN verifier_reason = 'verified' THEN trim(t) END AS accepted FROM w WHERE open""")
def revision_rounds(spark, sf):
    drafts, answers = _revised(spark, sf)
    out = revision.section_revisions(drafts, revision.recorded(answers, ["conv_id"]), ["conv_id"])
    return out.select("conv_id", "attempt", "last", "status", "reason", "composer_reason", "verifier_reason", "level", "accepted")


def _revised(spark, sf):
    said, t = _t(spark, sf, "conversations"), F.col("text")
    bare, n = F.trim(F.regexp_replace(t, r"[.!?#\n-]+", " ")), F.floor((F.col("turn") + 1) / 2)
    made = said.where("role = 'assistant'").select("conv_id", n.alias("attempt"), (F.length(t) % 7 != 0).alias("success"), F.concat(bare, _pick(_ENDINGS, F.col("conv_id") + n)).alias("text"))
    word = F.regexp_extract(t, "[A-Za-z]{5,}", 0)
    says = F.when(F.length(t) % 5 == 0, '{"verdict": "pass", "unsupported_claims": []}').when(F.length(t) % 5 == 1, "no object here").otherwise(F.concat(F.lit('Answer: {"status": "Fail", "unsupported_claims": ["'), word, F.lit('", " "]} end')))
    told = said.where("role = 'user' AND turn > 0").select("conv_id", F.floor(F.col("turn") / 2).alias("attempt"), F.lit(True).alias("verifier_success"), says.alias("verifier_text"))
    allowed = F.array(F.lit("P1 p1"), F.lit("P2 p2"))
    drafts = said.where("turn = 0").select("conv_id", F.concat(bare, F.lit(" [P1 p1].")).alias("draft"), F.array().cast("array<string>").alias("failures"), allowed.alias("allowed"), F.array().cast("array<string>").alias("gaps"))
    return drafts, made.join(told, ["conv_id", "attempt"], "full")


_PASSES = "(l_returnflag <> 'A' OR l_quantity > 10) AND l_tax > 0 AND month(l_shipdate) <> 7"


@query(f"""WITH j AS (SELECT o_orderkey, k AS attempt, CASE WHEN l_orderkey IS NULL OR l_discount = 0.05 THEN 'revision_unavailable' WHEN month(l_shipdate) = 3 THEN 'empty_revision' WHEN {_PASSES} AND l_linestatus = 'F' AND l_quantity > 20 THEN 'revision_accepted' ELSE 'revision_rejected' END AS reason, {_PASSES} AS ok, CAST(l_suppkey AS VARCHAR) AS said
FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1) ON l_orderkey = o_orderkey AND l_linenumber = k),
w AS (SELECT *, coalesce(bool_and(reason = 'revision_rejected' AND ok) OVER (PARTITION BY o_orderkey ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open FROM j)
SELECT o_orderkey, attempts, status, reason, final FROM (SELECT o_orderkey, CAST(attempt AS INTEGER) AS attempts, CASE WHEN reason = 'revision_accepted' THEN 'pass' ELSE 'fallback' END AS status, reason, CASE WHEN reason = 'revision_accepted' THEN said ELSE o_orderstatus END AS final, row_number() OVER (PARTITION BY o_orderkey ORDER BY attempt DESC) AS back FROM w JOIN (SELECT o_orderkey, o_orderstatus FROM orders) USING (o_orderkey) WHERE open) WHERE back = 1""")
def report_revisions(spark, sf):
    reports = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("report"))
    state = lambda ok: F.when(ok, "pass").otherwise("fallback")
    states = {"citation": state((F.col("l_returnflag") != "A") | (F.col("l_quantity") > 10)), "prose_quality": F.lit("pass"), "faithfulness": state(F.col("l_tax") > 0), "plan_adherence": F.lit("pass"), "semantic": state(F.month("l_shipdate") != 7), "critic": state((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20))}
    text = F.when(F.month("l_shipdate") == 3, " ").otherwise(F.col("l_suppkey").cast("string"))
    first = relational.first_per_key(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    answers = first.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("attempt"), (F.col("l_discount") != 0.05).alias("success"), text.alias("text"), *[c.alias(k) for k, c in states.items()])
    attempts = revision.report_revisions(reports, revision.recorded(answers, ["o_orderkey"]), ["o_orderkey"], 4)
    return revision.final_drafts(reports, attempts, ["o_orderkey"], "report")


# --- claims of a report: a conversation is a report, a turn a line, the next turn's text its evidence ---------------------

_FLAT = "trim(regexp_replace(regexp_replace(text, '[.!?\\[\\]#|*:-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT conv_id, turn, {_FLAT} AS t, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next, CASE WHEN conv_id % 2 = 0 THEN 'Methods' ELSE 'Main Results' END AS section FROM conversations),
c AS (SELECT *, CASE turn % 4 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN 'No evidence of kind ' || turn % 5 ELSE t END AS said, CASE turn % 4 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n FROM l),
k AS (SELECT *, {_terms('said')} AS ts, {_terms("coalesce(CASE WHEN turn % 4 = 0 THEN next END, '')")} AS es FROM c), u AS (SELECT *, CASE WHEN turn % 4 = 2 THEN 'material_gap' WHEN n = 0 AND len(ts) < 3 THEN 'structural' WHEN n = 0 THEN 'factual' WHEN n > 1 THEN 'synthesis' WHEN section = 'Methods' THEN 'method' ELSE 'result' END AS claim_type FROM k WHERE said <> ''),
s AS (SELECT *, CASE WHEN claim_type = 'material_gap' THEN 'material_gap' WHEN n = 0 THEN 'uncited' WHEN n = 2 OR next IS NULL THEN 'unknown_citation' WHEN len(ts) = 0 OR len(list_intersect(ts, es)) >= CASE WHEN len(ts) <= 3 THEN 1 ELSE 2 END THEN 'supported' ELSE 'weak_support' END AS support_status FROM u WHERE claim_type <> 'structural')
SELECT conv_id, 'C' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS claim_unit_id, section, claim_type, said AS text, support_status, CASE support_status WHEN 'material_gap' THEN 'material_gap' WHEN 'supported' THEN 'supported' WHEN 'weak_support' THEN 'weak' ELSE 'unsupported' END AS verdict, CASE WHEN claim_type = 'material_gap' THEN turn % 5 = conv_id % 5 END AS gap_allowed,
CASE WHEN n = 2 THEN 'P' || turn || ' p1,P9 p' || turn WHEN n = 1 AND next IS NULL THEN 'P1 p' || turn ELSE '' END AS unknown_citations, CASE WHEN n > 0 AND next IS NOT NULL THEN CASE WHEN n = 1 THEN 'E' || turn ELSE '' END ELSE '' END AS evidence_row_ids FROM s""")
def claim_units(spark, sf):
    said, t, s = _t(spark, sf, "conversations"), F.col("turn"), lambda c: c.cast("string")
    flat = F.trim(F.regexp_replace(F.regexp_replace("text", r"[.!?\[\]#|*:-]+", " "), r"\s+", " "))
    line = F.when(t % 4 == 0, F.concat(flat, F.lit(" [P1 p"), s(t), F.lit("]."))).when(t % 4 == 1, flat).when(t % 4 == 2, F.concat(F.lit("- MATERIAL GAP: No evidence of kind "), s(t % 5), F.lit("."))).otherwise(F.concat(flat, F.lit(" ["), s(t), F.lit(", p. 1; P9 p"), s(t), F.lit("]")))
    line = F.when((t % 4 == 2) | (flat != ""), line)
    head = F.when(F.col("conv_id") % 2 == 0, "## Methods\n").otherwise("## Main  Results\n")
    reports = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("l")).select("conv_id", F.concat(head, F.array_join(F.col("l.x"), "\n")).alias("report"))
    by = W.partitionBy("conv_id").orderBy("turn")
    rows = said.withColumn("next", F.lead("text").over(by)).where((t % 4 == 0) & F.col("next").isNotNull())
    one = F.lit(1.0)
    index = report.evidence_index(rows.select("conv_id", t.alias("ordinal"), F.concat(F.lit("E"), s(t)).alias("row_id"), F.concat(F.lit("P1 p"), s(t)).alias("citation"), F.col("next").alias("text"), F.lit("result").alias("evidence_type"), one.alias("quality_score"), one.alias("parse_confidence"), one.alias("trust_score"), F.lit("").alias("support_status"), F.lit("clean").alias("quality_label")), "conv_id")
    gaps = said.select("conv_id", F.concat(F.lit("No evidence of kind "), s(F.col("conv_id") % 5)).alias("message")).distinct()
    units = report.claim_units(reports, index, gaps, "conv_id")
    return units.select("conv_id", "claim_unit_id", "section", "claim_type", "text", "support_status", "verdict", "gap_allowed", F.array_join("unknown_citations", ",").alias("unknown_citations"), F.array_join("evidence_row_ids", ",").alias("evidence_row_ids"))
