"""Registered queries of discovery, query understanding and run records, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import planning
from ..operators import constraints, discovery, evidence_plan, gated, records, report, understanding
from ..operators import model_labels as models
from ..sources import readers
from .audits import _LIST, _SQ, _pick
from .registry import NORM, _t, query

# --- discovery: an event is a candidate, a user's events of one kind are what a provider has for a variant ---------------

_PAGE = 5
_FOUND = f"""(SELECT provider, variant, (k // {_PAGE}) * {_PAGE} AS "offset", (user_id + k // {_PAGE}) % 7 = 0 AS failed, list(source ORDER BY k) AS cs FROM (SELECT user_id, ['openalex', 'arxiv', 'pubmed'][CAST(event_id % 3 AS INTEGER) + 1] AS provider, 'user ' || user_id AS variant, 'S' || (event_id % 50) AS source, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS k FROM events) GROUP BY ALL)"""


@query(f"""WITH asked AS (SELECT u, lim, vp, variant, pp, provider, CASE WHEN q <= 0 THEN 0 ELSE greatest(1, CAST(ceil(q / 2.0) AS INTEGER)) END AS total FROM (SELECT u, lim, vp, variant, pp, provider, lim // 3 + CASE WHEN pp < lim % 3 THEN 1 ELSE 0 END AS q
FROM (SELECT user_id AS u, user_id % 65 AS lim FROM (SELECT DISTINCT user_id FROM events)), LATERAL (VALUES (0, 'user ' || u), (1, 'user ' || (u + 1))) AS v(vp, variant), (VALUES (0, 'openalex'), (1, 'arxiv'), (2, 'pubmed')) AS p(pp, provider))),
paged AS (SELECT *, least({_PAGE}, total - "offset") AS page_limit FROM (SELECT *, unnest(range(0, total, {_PAGE})) AS "offset" FROM asked)),
met AS (SELECT a.*, cs, NOT coalesce(failed, true) AND coalesce(len(cs), 0) > 0 AS good FROM paged a LEFT JOIN {_FOUND} f ON f.provider = a.provider AND f.variant = a.variant AND f."offset" = a."offset"),
ok AS (SELECT *, good AND coalesce(bool_and(good AND len(cs) >= page_limit) OVER (PARTITION BY u, pp, vp ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS counts FROM met),
rows_ AS (SELECT u, lim, provider, variant, pp, vp, "offset", unnest(cs) AS source, generate_subscripts(cs, 1) AS i FROM ok WHERE counts), first AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY u, lower(source) ORDER BY pp, vp, "offset", i) = 1)
SELECT user_id, rank, provider, variant, source FROM (SELECT u AS user_id, CAST(row_number() OVER (PARTITION BY u ORDER BY pp, vp, "offset", i) AS INTEGER) AS rank, provider, variant, source, lim FROM first) WHERE rank <= lim""")
def discovery_ranked(spark, sf):
    e, n = _t(spark, sf, "events"), F.col("event_id")
    named = F.get(F.array(*[F.lit(p) for p in discovery.PROVIDERS]), (n % 3).cast("int"))
    kept = e.select("user_id", named.alias("provider"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("variant"), n, (F.row_number().over(W.partitionBy("user_id", n % 3).orderBy(n)) - 1).alias("k"))
    none = F.lit(None).cast("string")
    one = F.struct("k", none.alias("doi"), none.alias("pmid"), none.alias("arxiv_id"), F.concat(F.lit("S"), (n % 50).cast("string")).alias("source"))
    page = F.floor(F.col("k") / _PAGE).cast("int")
    pages = kept.groupBy("provider", "variant", (page * _PAGE).alias("offset"), ((F.col("user_id") + page) % 7 == 0).alias("failed")).agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    users = e.select("user_id").distinct()
    variants = F.array(*[F.concat(F.lit("user "), (F.col("user_id") + k).cast("string")) for k in (0, 1)])
    asked = discovery.page_requests(users.select("user_id", variants.alias("variants"), (F.col("user_id") % 65).cast("int").alias("limit")), "user_id", _PAGE)
    return discovery.discovered(asked, pages, "user_id").select("user_id", "rank", "provider", "variant", "source")


# --- acronyms and topics of each query ----------------------------------------------------------------------------------

_HINTS = (" AMR isolates of the pathogen, amr", " AMR parsing and Mesh graphs", " AMR", " AST or MIC", " AST susceptibility by MALDI TOF", " NLP, CNN and XyZ9 text", " adaptive mesh grid AMR, text", " LLMs LLM", "")
_SPOKEN = f"(SELECT conv_id, turn, text || {_LIST(_HINTS)}[CAST((conv_id + turn) % 9 AS INTEGER) + 1] AS q FROM conversations)"
_REGISTRY = "(VALUES " + ", ".join(f"({_SQ(a)}, {i}, {_SQ(m)}, {_SQ(n)}, {_LIST(c)}, {needs})" for a, i, m, n, c, needs, silent in understanding.registry_rows() if not silent) + ") AS r(acronym, sense, meaning, intent, ctx, needs)"
_SILENT = _LIST([a for a, senses in planning.ACRONYMS.items() if all(x.silent for x in senses)])


@query(f"""WITH q AS (SELECT conv_id, turn, ' ' || {NORM.format(c='q')} || ' ' AS said, list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Za-z][A-Za-z0-9]{{1,7}}$') AND length(regexp_replace(w, '[^A-Z]', '', 'g')) >= 2) AS f FROM {_SPOKEN}),
d AS (SELECT conv_id, turn, said, list_filter(f, lambda w, i: list_position(list_transform(f, lambda x: upper(x)), upper(w)) = i) AS a FROM q), t AS (SELECT conv_id, turn, said, unnest(a) AS token, generate_subscripts(a, 1) - 1 AS place FROM d),
v AS (SELECT t.*, r.*, len(list_filter(ctx, lambda c: contains(said, ' ' || {NORM.format(c='c')} || ' '))) AS votes, count(*) OVER (PARTITION BY conv_id, turn, place) AS senses FROM t JOIN {_REGISTRY} ON r.acronym = upper(token)),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, place ORDER BY votes DESC, sense) AS k, list(meaning) OVER (PARTITION BY conv_id, turn, place ORDER BY sense ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM v),
s AS (SELECT conv_id, turn, place, acronym, meaning, intent, CASE WHEN senses = 1 THEN CASE WHEN needs THEN 'context_match' ELSE 'registry_single_sense' END WHEN votes > 0 THEN 'context_match' ELSE 'registry_default' END AS reason, list_filter(every, lambda m: m <> meaning) AS rejected FROM best WHERE k = 1 AND NOT (senses = 1 AND needs AND votes = 0))
SELECT t.conv_id, t.turn, CAST(t.place AS INTEGER) AS place, coalesce(s.acronym, token) AS acronym, coalesce(meaning, token) AS meaning, coalesce(intent, 'unknown') AS intent, coalesce(reason, 'unresolved_acronym') AS reason, coalesce(array_to_string(rejected, '; '), '') AS rejected
FROM t LEFT JOIN s ON s.conv_id = t.conv_id AND s.turn = t.turn AND s.place = t.place WHERE NOT list_contains({_SILENT}, upper(token))""")
def acronym_senses(spark, sf):
    registry = spark.createDataFrame(understanding.registry_rows(), understanding.REGISTRY)
    asked = _t(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", _pick(_HINTS, F.col("conv_id") + F.col("turn"))).alias("query"))
    return understanding.acronym_senses(asked, registry, ["conv_id", "turn"]).withColumn("rejected", F.array_join("rejected", "; "))


#: Profiles whose terms stand in the tables' prose: id, domain, hint, match, required, core, positive, searches.
_PROFILES = (
    ("first", "unknown", None, ("nicht", "De la"), (), ("les  des", "core ONE"), ("Nicht", "plus"), ("first search",)), ("second", "roman", "careful", (), ("la", "los"), ("que", "en  el", "Core one"), (), ("second search", "FIRST  search")),
    ("third", "german", "careful", ("der die", "und", "und"), ("die", "der", "das"), (), ("plus", "more"), ()), ("fourth", "roman", "Other", ("the of", "and"), (), ("never heard",), ("MORE",), ("fourth search",)),
)
_LISTED = {"match": 3, "required": 4, "core": 5, "positive": 6, "searches": 7}
_P = "(VALUES " + ", ".join(f"({i}, {_SQ(p[0])}, {_SQ(p[1])}, {_SQ(p[2]) if p[2] else 'NULL'}, " + ", ".join(f"{_LIST(p[k])}::VARCHAR[]" for k in _LISTED.values()) + ")" for i, p in enumerate(_PROFILES)) + ") AS p(place, profile_id, domain, hint, match, required, core, positive, searches)"
_IN = lambda xs: f"len(list_filter({xs}, lambda x: contains(said, ' ' || {NORM.format(c='x')} || ' ')))"

def _union_sql(name: str, source: str) -> str:
    """name(key, l): the ordered union of source(key, place, i, v)."""
    return f"{name} AS (SELECT key, list(v ORDER BY place, i) AS l FROM (SELECT key, place, i, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS v FROM ({source}) WHERE v IS NOT NULL AND trim(v) <> '' QUALIFY row_number() OVER (PARTITION BY key, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) ORDER BY place, i) = 1) GROUP BY key)"


_UNIONS = [_union_sql(f"u_{c}", f"SELECT key, place, unnest({c}) AS v, generate_subscripts({c}, 1) AS i FROM m" + (" UNION ALL SELECT key, -1, q, 0 FROM m" if c == "searches" else "")) for c in _LISTED] + [_union_sql("u_domain", "SELECT key, place, CASE WHEN domain <> 'unknown' THEN domain END AS v, 1 AS i FROM m"), _union_sql("u_hint", "SELECT key, place, hint AS v, 1 AS i FROM m")]


@query(f"""WITH q AS (SELECT conv_id * 100 + turn AS key, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, ' ' || {NORM.format(c='text')} || ' ' AS said FROM conversations),
s AS (SELECT *, CASE WHEN len(required) > 0 AND {_IN('required')} = len(required) THEN 4 ELSE 0 END + 2 * CASE WHEN len(match) > 0 THEN {_IN('match')} ELSE {_IN('core')} END AS score, {_IN('list_concat(match, core)')} > 0 AS needed FROM q, {_P}), m AS (SELECT * FROM s WHERE score > 0), {', '.join(_UNIONS)},
h AS (SELECT key, string_agg(profile_id, '+' ORDER BY place) AS ids, coalesce(string_agg(profile_id, ',' ORDER BY place) FILTER (needed), '') AS needed FROM m GROUP BY key)
SELECT q.key, CASE WHEN ids IS NULL THEN 'unknown' ELSE 'composed.' || ids END AS profile_id, CASE WHEN ids IS NULL THEN 'unknown' ELSE coalesce(array_to_string(u_domain.l, '+'), '') END AS domain, array_to_string(u_hint.l, '+') AS hint, coalesce(needed, '') AS needed,
{', '.join(f"CASE WHEN ids IS NULL THEN {'q.q' if c in ('core', 'searches') else repr('')} ELSE coalesce(array_to_string(u_{c}.l, '|'), '') END AS {c}" for c in _LISTED)} FROM q LEFT JOIN h USING (key) {' '.join(f"LEFT JOIN u_{c} ON u_{c}.key = q.key" for c in [*_LISTED, 'domain', 'hint'])}""")
def topic_plans(spark, sf):
    none = F.array().cast("array<string>")
    rows = [(i, p[0], p[1], p[2], *[list(p[k]) for k in _LISTED.values()]) for i, p in enumerate(_PROFILES)]
    profiles = spark.createDataFrame(rows, "place int, profile_id string, domain string, hint string, match array<string>, required array<string>, core array<string>, positive array<string>, searches array<string>").withColumns({"negative": none, "preferences": none})
    asked = _t(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.col("text").alias("query"))
    out = understanding.topic_plans(asked, profiles, ["key"])
    return out.select("key", "profile_id", "domain", "hint", F.array_join("needed", ",").alias("needed"), *[F.array_join(c, "|").alias(c) for c in _LISTED])


# --- a model's labels: a function of the payload stands for the model -----------------------------------------------------


def _stub(payloads: list[str]) -> list:
    """Answers of all kinds by an item's year, which holds the length of its text."""
    import json

    out = []
    for p in payloads:
        n = json.loads(p)["candidate"]["year"]
        label, sure = ("relevant", "maybe", "irrelevant")[n % 3], n % 101 / 100
        good = {"label": label, "confidence": sure, "rationale": f" length  {n} ", "evidence_terms": [f"t{n % 5}", "u v"], "exclusion_reason": None if n % 2 else "  off topic "}
        bad = {0: {"label": "Relevant"}, 1: {"confidence": "0.5"}, 2: {"rationale": "  "}, 3: {"evidence_terms": ["a", " "]}, 4: {"confidence": 1.5}, 5: {"exclusion_reason": 7}, 6: {"evidence_terms": []}, 7: {"confidence": True}}.get(n % 16, {})
        out.append(ValueError("busy") if n % 16 == 8 else "no object" if n % 16 == 9 else "[1]" if n % 16 == 10 else json.dumps(good | bad))
    return out


@query("""WITH d AS (SELECT doc_id, n_chars AS n, n_chars % 16 AS k, quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
e AS (SELECT *, CASE k WHEN 0 THEN 'invalid_label' WHEN 1 THEN 'invalid_confidence' WHEN 2 THEN 'empty_rationale' WHEN 3 THEN 'invalid_evidence_terms' WHEN 4 THEN 'invalid_confidence' WHEN 5 THEN 'invalid_exclusion_reason' WHEN 7 THEN 'invalid_confidence' WHEN 8 THEN 'call_failed: busy' WHEN 9 THEN 'not_an_object' WHEN 10 THEN 'not_an_object' END AS err, coalesce(quality = 1, false) AS human FROM d)
SELECT doc_id, CASE WHEN human THEN 'skipped_human' WHEN err IS NOT NULL THEN 'skipped_error' WHEN n % 101 < 40 THEN 'skipped_low_confidence' ELSE 'applied' END AS outcome, CASE WHEN ok THEN ['relevant', 'maybe', 'irrelevant'][CAST(n % 3 AS INTEGER) + 1] END AS label, CASE WHEN ok THEN round((n % 101) / 100.0, 3)::DOUBLE END AS confidence, CASE WHEN ok THEN 'length ' || n END AS rationale,
CASE WHEN ok THEN CASE WHEN k = 6 THEN '' ELSE 't' || (n % 5) || ',u v' END END AS evidence_terms, CASE WHEN ok AND n % 2 = 0 THEN 'off topic' END AS exclusion_reason, CASE WHEN NOT human THEN err END AS error FROM (SELECT *, NOT human AND err IS NULL AS ok FROM e)""")
def model_labels(spark, sf):
    human = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    items = _t(spark, sf, "documents").select("doc_id", F.col("source").alias("provider"), F.col("text").alias("abstract"), F.col("n_chars").cast("int").alias("year")).join(human, "doc_id", "left")
    asked = items.select("doc_id", F.when(F.col("quality") == 1, "human").alias("label_source"), model_labels_payload(items.columns).alias("payload"))
    out = models.label_items(asked, ["doc_id"], _stub, least=0.4).decisions
    return out.withColumn("evidence_terms", F.array_join("evidence_terms", ","))


def model_labels_payload(columns: list[str]):
    return models.label_payload(F.lit("what is known"), F.struct(F.lit("unknown").alias("intent")), columns)


# --- checks of a corpus: an event is a case, a user's events are a file ---------------------------------------------------

_CASE = """CASE WHEN event_id % 23 = 0 THEN '{' WHEN event_id % 19 = 0 THEN '["case"]' ELSE '{"case_id": ' || CASE WHEN event_id % 11 = 0 THEN '5' WHEN event_id % 11 = 1 THEN '"silver.' || event_id || '"' ELSE '"gold.' || (event_id % 4001) || '"' END || ', "type": "' || CASE WHEN event_id % 7 = 0 THEN event_type ELSE 'ranking' END || '", "description": ' || CASE event_id % 13 WHEN 0 THEN '"  "' WHEN 1 THEN 'null' ELSE '"about ' || user_id || '"' END || ', "expected": ' || CASE WHEN event_id % 17 = 0 THEN '[]' ELSE props END || '}' END"""


@query(f"""WITH c AS (SELECT user_id, event_id, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT user_id, event_id, {_CASE} AS j FROM events)), k AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.case_id') = 'VARCHAR' AND starts_with(json_extract_string(j, '$.case_id'), 'gold.') THEN json_extract_string(j, '$.case_id') END AS case_id FROM c),
d AS (SELECT *, case_id IS NOT NULL AND row_number() OVER (PARTITION BY case_id ORDER BY user_id, event_id) > 1 AS again FROM k)
SELECT * FROM (SELECT user_id, event_id, CASE WHEN j IS NULL THEN 'unreadable' WHEN json_type(j) <> 'OBJECT' THEN 'not_an_object' WHEN case_id IS NULL THEN 'bad_case_id' WHEN again THEN 'duplicate_case_id' WHEN NOT list_contains({_LIST(constraints.CASE_TYPES)}, json_extract_string(j, '$.type')) THEN 'unsupported_type'
WHEN coalesce(json_type(j, '$.description'), '') <> 'VARCHAR' OR trim(json_extract_string(j, '$.description')) = '' THEN 'no_description' WHEN coalesce(json_type(j, '$.expected'), '') <> 'OBJECT' THEN 'no_expected' END AS rule, case_id FROM d) WHERE rule IS NOT NULL""")
def case_violations(spark, sf):
    cases = _t(spark, sf, "events").select("user_id", "event_id", F.expr(_CASE).alias("json"))
    return constraints.violations(cases, "gold.", ["user_id", "event_id"])


# --- records of runs ------------------------------------------------------------------------------------------------------


def _row_sql(columns: list[str]) -> str:
    return "concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(columns)) + ")"


_HEX = lambda k: f"list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(substr(h, {1 + k * 14}, 14), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS HUGEINT))), lambda a, b: a * 16 + b)"


def _digest_sql(source: str, keys: str, columns: list[str]) -> str:
    by = f"{keys}, " if keys else ""
    parts = ", ".join(f"sum({_HEX(k)}) AS d{k}" for k in range(4))
    return f"(SELECT {by}n AS rows, sha256(concat_ws('-', n, CAST(d0 AS HUGEINT), CAST(d1 AS HUGEINT), CAST(d2 AS HUGEINT), CAST(d3 AS HUGEINT))) AS digest FROM (SELECT {by}count(*) AS n, {parts} FROM (SELECT {by}sha256({_row_sql(columns)}) AS h FROM {source}){f' GROUP BY {keys}' if keys else ''}))"


@query(f"SELECT * FROM {_digest_sql('conversations', 'role', ['conv_id', 'turn', 'text'])} UNION ALL SELECT 'all', * FROM {_digest_sql('documents', '', ['doc_id', 'text', 'lang', 'source', 'n_chars'])}")
def table_digests(spark, sf):
    whole = records.digest(_t(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return records.digest(_t(spark, sf, "conversations").select("role", "conv_id", "turn", "text"), ["role"]).unionByName(whole.withColumn("role", F.lit("all")))


_ITEM = "(SELECT source, CAST(doc_id AS VARCHAR) AS normalized, lang AS provider, 'about ' || (doc_id % 3) AS query_variant, n_chars >= 300 AS allowed FROM documents)"


@query(f"""WITH i AS (SELECT source, count(*) AS screened_count, count(*) FILTER (NOT coalesce(allowed, false)) AS blocked_count, coalesce(array_to_string(list_sort(list(DISTINCT provider) FILTER (provider <> '')), ','), '') AS providers, array_to_string(list_sort(list(DISTINCT query_variant)), ',') AS variants FROM {_ITEM} GROUP BY source),
a AS (SELECT source, count(*) AS pdf_attempt_count, count(*) FILTER (n_chars >= 1000) AS stored_pdf_count, count(*) FILTER (n_chars >= 1000 AND doc_id % 10 < 6) AS low, round(avg((doc_id % 10) / 10.0) FILTER (n_chars >= 1000), 3)::DOUBLE AS mean FROM documents GROUP BY source),
l AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS relevant, count(*) FILTER (quality = 1 AND toxic = 1) AS maybe, count(*) FILTER (quality = 0) AS irrelevant, count(*) FILTER (doc_id % 2 = 0) AS human FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT i.source, screened_count, screened_count - blocked_count AS allowed_count, providers, variants, pdf_attempt_count, stored_pdf_count, low AS low_confidence_count, mean AS average_parse_confidence, coalesce(relevant, 0) AS relevant, coalesce(maybe, 0) AS maybe, coalesce(irrelevant, 0) AS irrelevant, coalesce(human, 0) AS human_labels, digest AS items_digest
FROM i JOIN a USING (source) LEFT JOIN l USING (source) JOIN {_digest_sql(_ITEM, 'source', ['normalized', 'provider', 'query_variant', 'allowed'])} g USING (source)""")
def batch_passports(spark, sf):
    d, n = _t(spark, sf, "documents"), F.col("doc_id")
    items = d.select("source", n.cast("string").alias("normalized"), F.col("lang").alias("provider"), F.concat(F.lit("about "), (n % 3).cast("string")).alias("query_variant"), (F.col("n_chars") >= 300).alias("allowed"))
    artifacts = d.select("source", F.when(F.col("n_chars") >= 1000, "stored").otherwise("failed").alias("status"), ((n % 10) / 10.0).alias("parse_confidence"))
    label = F.when(F.col("quality") == 0, "irrelevant").when(F.col("toxic") == 1, "maybe").otherwise("relevant")
    labels = _t(spark, sf, "labels").join(d.select("doc_id", "source"), "doc_id").select("source", label.alias("label"), F.when(n % 2 == 0, "human").otherwise("agent").alias("label_source"))
    p = records.batch_passports(d.select("source").distinct(), items, artifacts, labels, "source")
    return p.select("source", "batch.screened_count", "batch.allowed_count", F.array_join("search.providers_observed", ",").alias("providers"), F.array_join("search.query_variants_observed", ",").alias("variants"), "artifacts.pdf_attempt_count", "artifacts.stored_pdf_count", "artifacts.low_confidence_count", "artifacts.average_parse_confidence", "screening_labels.relevant", "screening_labels.maybe", "screening_labels.irrelevant", "screening_labels.human_labels", F.col("repro_lock.items_digest").alias("items_digest"))


# --- evidence plans: an order is a report, its line items are the evidence ------------------------------------------------

_KINDS = ("claim", "method", "result", "limitation", "dataset_population", "method_detail", "note")
_PLACES = ("claims", "methods", "results", "limitations", "", "", "populations")
_SECTIONS = ("background", "methods", "results", "limitations", "all")
_TEXTS = ("plain words", "Keywords: a", "formally given", "more words", "x")
_LINE = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)"


@query(f"""WITH own AS (SELECT l_orderkey AS k, {_LIST(_SECTIONS)}[CAST(l_orderkey % 5 AS INTEGER) + 1] AS section, n AS ordinal, 'E' || (n % 4) AS row_id, {_LIST(_PLACES)}[CAST(l_partkey % 7 AS INTEGER) + 1] AS tab, 'P' || (l_suppkey % 3) || ' p' || (n % 2) AS citation, {_LIST(_TEXTS)}[CAST(l_suppkey % 5 AS INTEGER) + 1] AS t, {_LIST(_KINDS)}[CAST(l_partkey % 7 AS INTEGER) + 1] AS kind, l_partkey AS p, l_suppkey AS s FROM {_LINE} WHERE l_tax <> 0.08),
used AS (SELECT *, CASE WHEN t LIKE 'Keywords%' THEN 'front_matter' WHEN t LIKE 'formally%' THEN 'formula_detail' WHEN list_contains({_LIST(report.ROLES)}, kind) THEN kind ELSE 'claim' END AS role FROM own WHERE CASE WHEN tab <> '' THEN section = 'all' OR list_contains(CASE section WHEN 'background' THEN ['claims', 'methods', 'results', 'populations'] ELSE [section] END, tab) ELSE section = 'all' OR list_contains(CASE section WHEN 'background' THEN ['claim', 'method', 'result', 'dataset_population'] WHEN 'methods' THEN ['method'] WHEN 'results' THEN ['result'] ELSE ['limitation'] END, kind) END),
ours AS (SELECT *, CASE role WHEN 'front_matter' THEN 'exclude' WHEN 'formula_detail' THEN 'appendix' WHEN 'method_detail' THEN 'appendix' ELSE 'include' END AS action FROM used),
base AS (SELECT * FROM ours QUALIFY row_number() OVER (PARTITION BY k, section, row_id, citation ORDER BY ordinal DESC) = 1),
theirs AS (SELECT l_orderkey AS k, n AS place, 'E' || (n % 3) AS row_id, 'P' || (l_suppkey % 3) || ' p' || (n % 2) AS citation, CASE WHEN l_partkey % 3 = 0 THEN 'exclude' WHEN l_partkey % 3 = 1 THEN 'drop' ELSE '' END AS action FROM {_LINE} WHERE l_orderkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, 'E' || (n % 3), 'P' || (l_suppkey % 3) || ' p' || (n % 2) ORDER BY n) = 1),
valid AS (SELECT b.k, section, place, b.row_id, b.citation, CASE WHEN t.action = 'exclude' THEN 'exclude' ELSE b.action END AS action, 'pass' AS status FROM base b JOIN theirs t ON t.k = b.k AND t.row_id = b.row_id AND t.citation = b.citation),
merged AS (SELECT * FROM valid UNION ALL SELECT k, section, ordinal, row_id, citation, action, 'fallback' FROM ours o WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.k = o.k)),
c AS (SELECT k, section, status, action, citation, min(place) AS place FROM merged GROUP BY ALL), r AS (SELECT k, section, status, action, row_id, min(place) AS place FROM merged GROUP BY ALL),
cs AS (SELECT k, section, status, {', '.join(f"coalesce(string_agg(citation, ';' ORDER BY place, citation) FILTER (action = '{a}'), '') AS {a}_citations" for a in evidence_plan.ACTIONS)} FROM c GROUP BY ALL), rs AS (SELECT k, {', '.join(f"coalesce(string_agg(row_id, ';' ORDER BY place, row_id) FILTER (action = '{a}'), '') AS {a}_row_ids" for a in evidence_plan.ACTIONS)} FROM r GROUP BY ALL)
SELECT k, section, status AS planner_status, {', '.join(f'{a}_{n}' for a in evidence_plan.ACTIONS for n in ('citations', 'row_ids'))} FROM cs JOIN rs USING (k)""")
def evidence_plans(spark, sf):
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    line = _t(spark, sf, "lineitem").withColumn("n", n)
    s = lambda c: c.cast("string")
    k, at = F.col("l_orderkey"), F.col("n")
    section = _pick(_SECTIONS, k)
    citation = F.concat(F.lit("P"), s(F.col("l_suppkey") % 3), F.lit(" p"), s(at % 2))
    trust = F.when(F.col("l_tax") == 0.08, "suspect").when(F.col("l_tax") == 0.0, None).otherwise("trusted")
    own = line.select(k.alias("k"), section.alias("section"), at.alias("ordinal"), F.concat(F.lit("E"), s(at % 4)).alias("row_id"), _pick(_PLACES, F.col("l_partkey")).alias("table"), citation.alias("citation"), _pick(_TEXTS, F.col("l_suppkey")).alias("text"), _pick(_KINDS, F.col("l_partkey")).alias("evidence_type"), trust.alias("trust_label"))
    action = F.when(F.col("l_partkey") % 3 == 0, "exclude").when(F.col("l_partkey") % 3 == 1, "drop")
    one = F.struct(at.alias("place"), F.struct(F.concat(F.lit("E"), s(at % 3)).alias("row_id"), citation.alias("citation"), action.alias("action")).alias("r"))
    said = line.groupBy(k.alias("k"), section.alias("section")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    answers = said.select("k", "section", (F.col("k") % 3 > 0).alias("success"), F.concat(F.lit("Plan: "), F.to_json(F.struct(F.col("x.r").alias("rows")))).alias("answer"))
    plans = evidence_plan.section_plans(evidence_plan.reconciled(evidence_plan.planned_rows(own, ["k"]), evidence_plan.planner_rows(answers, ["k"]), ["k"]), ["k"])
    return plans.select("k", "section", "planner_status", *[F.array_join(f"{a}_{x}", ";").alias(f"{a}_{x}") for a in evidence_plan.ACTIONS for x in ("citations", "row_ids")])


# --- tuning: an order is a proposal, its line items are its actions and the reports of its gates ---------------------------

_TARGETS = ("report_prose_quality", "topic_profile", "", "other", "citation_audit", "topic_routing")
_SUITES = ("gold", "real-smoke", "core")


@query(f"""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN ['core'] WHEN o_orderkey % 4 = 1 THEN ['gold', ' '] ELSE [] END AS own, CASE WHEN o_orderkey % 7 = 0 THEN ['real-smoke', 'core'] END AS named, CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'approved' END AS decision, CASE WHEN o_orderkey % 9 = 0 THEN 'applied' ELSE 'not_applied' END AS state FROM orders),
g AS (SELECT k, CASE WHEN k % 11 = 0 THEN NULL ELSE decision END AS decision, CASE WHEN k % 11 = 0 THEN NULL ELSE state END AS state, CASE WHEN k % 11 <> 0 AND named IS NOT NULL THEN named WHEN len(own) > 0 THEN list_filter(own, lambda x: trim(x) <> '') ELSE ['gold', 'real-smoke'] END AS gates FROM p),
r AS (SELECT l_orderkey AS k, list(gate) AS passed FROM (SELECT l_orderkey, {_LIST(_SUITES)}[CAST(l_partkey % 3 AS INTEGER) + 1] AS gate, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL) WHERE ok GROUP BY l_orderkey), o AS (SELECT g.*, list_filter(gates, lambda x: NOT list_contains(coalesce(passed, []), x)) AS failed FROM g LEFT JOIN r USING (k)),
t AS (SELECT *, CASE WHEN coalesce(decision, '') <> 'approved' THEN 'not_approved' WHEN coalesce(state, '') <> 'not_applied' THEN 'not_applyable' WHEN len(failed) > 0 THEN 'eval_gate_failed' END AS reason FROM o)
SELECT k, CASE WHEN reason IS NULL THEN 'applied' WHEN reason = 'eval_gate_failed' THEN 'blocked' ELSE 'refused' END AS outcome, reason, array_to_string(failed, ',') AS failed_gates, coalesce(n, 0) AS n_rules, coalesce(files, '') AS files FROM t LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n, string_agg(DISTINCT f, ',' ORDER BY f) AS files FROM (SELECT l_orderkey, CASE {_LIST(_TARGETS)}[CAST(l_suppkey % 6 AS INTEGER) + 1] {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in gated.RULE_FILES.items())} ELSE 'general.json' END AS f FROM lineitem) WHERE l_orderkey IN (SELECT k FROM t WHERE reason IS NULL) GROUP BY l_orderkey) USING (k)""")
def tuning_outcomes(spark, sf):
    k = F.col("o_orderkey")
    words = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    orders = _t(spark, sf, "orders")
    proposals = orders.select(k.alias("k"), F.when(k % 4 == 0, words("core")).when(k % 4 == 1, words("gold", " ")).alias("required"))
    decisions = orders.where(k % 11 != 0).select(k.alias("k"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("approved").alias("decision"), F.when(k % 9 == 0, "applied").otherwise("not_applied").alias("apply_status"), F.when(k % 7 == 0, words("real-smoke", "core")).alias("required"))
    line = _t(spark, sf, "lineitem")
    reports = line.select(F.col("l_orderkey").alias("k"), _pick(_SUITES, F.col("l_partkey")).alias("gate"), F.when(F.col("l_returnflag") != "R", "pass").otherwise("fail").alias("status"))
    none = F.lit(None).cast("string")
    actions = line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"), _pick(_TARGETS, F.col("l_suppkey")).alias("target"), none.alias("action"), F.col("l_quantity").cast("string").alias("value"), none.alias("reason"))
    outcomes = gated.tuning_outcomes(proposals, decisions, reports, "k")
    rules = gated.tuning_rules(outcomes, actions, "k").groupBy("k").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file")).alias("files"))
    return outcomes.join(rules, "k", "left").select("k", "outcome", "reason", F.array_join("failed_gates", ",").alias("failed_gates"), F.coalesce("n", F.lit(0)).alias("n_rules"), F.coalesce(F.array_join("files", ","), F.lit("")).alias("files"))


# --- links to PDFs: the tables' pages, each with a head of its own --------------------------------------------------------

_TAGS = (
    "<meta name='citation_pdf_url' content='https://a.org/x.pdf?a=1&amp;b=2'>", '<LINK REL="alternate PDF" HREF="/get/pdf">', '<link rel=next href="/y.pdf">', '<link type="Application/PDF" href="z?type=pdf">', '<meta property="og:pdf" content="https://a.org/pdf/7">', '<meta name="DC.Identifier" content="doi:10.1/x">',
    '<a class="a > b" href=/v/pdfft#top>x</a>', '<a href="paper.PDF;v=1">y</a><abbr href="no.pdf">', "<meta name='' property='og:pdf' content='pdf'>", '<a data-href="n.pdf">z</a><meta content="m.pdf" name="other">', "",
)
_PATH = "regexp_replace(regexp_replace(lower(h), '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*', ''), '[?#;].*$', '')"


def _attr_sql(name: str) -> str:
    pattern = f"""(?is)[\\s"'']{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))"""
    groups = " || ".join(f"regexp_extract(t, '{pattern}', {k})" for k in (1, 2, 3))
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN replace({groups}, '&amp;', '&') END"


@query(f"""WITH tags AS (SELECT page_id, unnest(g) AS t, generate_subscripts(g, 1) AS i FROM (SELECT page_id, regexp_extract_all({_LIST(_TAGS)}[CAST(page_id % {len(_TAGS)} AS INTEGER) + 1] || html || {_LIST(_TAGS)}[CAST((page_id * 3 + 1) % {len(_TAGS)} AS INTEGER) + 1], '(?is)<(?:a|link|meta)[\\s/](?:"[^"]*"|''[^'']*''|[^"''>])*>') AS g FROM pages)),
h AS (SELECT page_id, i, CASE WHEN regexp_matches(t, '^<a[\\s/]', 'i') THEN {_attr_sql('href')} WHEN regexp_matches(t, '^<link', 'i') THEN CASE WHEN contains(lower(coalesce({_attr_sql('rel')}, '')), 'pdf') OR lower({_attr_sql('type')}) = 'application/pdf' THEN {_attr_sql('href')} END WHEN lower(coalesce(nullif({_attr_sql('name')}, ''), {_attr_sql('property')}, '')) IN ('citation_pdf_url', 'dc.identifier', 'og:pdf') THEN {_attr_sql('content')} END AS h FROM tags)
SELECT page_id, string_agg(h, ' ' ORDER BY i) AS hrefs FROM h WHERE h <> '' AND ({_PATH} IN ('pdf', 'pdfft') OR regexp_matches({_PATH}, '(?:\\.pdf|/pdf|/pdfft)$|/pdf/')) GROUP BY page_id""")
def pdf_links(spark, sf):
    n = F.col("page_id")
    html = F.concat(_pick(_TAGS, n), "html", _pick(_TAGS, n * 3 + 1))
    return _t(spark, sf, "pages").select("page_id", readers.pdf_hrefs(html).alias("h")).where(F.size("h") > 0).select("page_id", F.array_join("h", " ").alias("hrefs"))
