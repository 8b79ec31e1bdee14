"""Registered queries of claims' wording, faithfulness, plans, prose, pages, gates and identifiers, with their SQL for DuckDB.

The tables' prose holds few of the phrases that the audits look for, so some queries add phrases by a row's own numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planning, text
from ..operators import curation, labelling, report
from .registry import CLAIMS, SENTS, TOK, _claims, _t, query, sentence_split
from .review import _items as _candidates

_SQ = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = lambda xs: "[" + ", ".join(_SQ(x) for x in xs) + "]"


def _pick(values, n):
    """One of the texts, by the remainder of a column."""
    return F.get(F.array(*[F.lit(v) for v in values]), n % len(values))


# --- wording of claims ------------------------------------------------------------------------------------------------

_ENDS = ("", " and it proved a survival  benefit, proven", " Keywords: a", " formally stated", " did not improve [x", " achieved more", " AN UPPER CASE ENDING OF MANY WORDS")
_END = f"{_LIST(_ENDS)}[CAST(seq % {len(_ENDS)} AS INTEGER) + 1]"
_COUNT = lambda c: f"(length(t) - length(replace(t, '{c}', '')))"
_ANY = lambda ps: "(" + " OR ".join(f"contains(lower(t), {_SQ(p)})" for p in ps) + ")"
_FOUND = "flatten([" + ", ".join(f"list_transform(regexp_extract_all(lower(t), {_SQ(p)}), lambda m: regexp_replace(m, '\\s+', ' ', 'g'))" for p in report.OVERSTATED) + "])"
_RISKS = f"list_filter({_FOUND}, lambda x, i: list_position({_FOUND}, x) = i)"
_FRONT, _FORMULA = r"\b(?:keywords?\s*:|original research\s+published\s*:|received\s*:|accepted\s*:|published\s*:)", r"\bformally\b|\blearning objective\b|\bloss function\b|[ℒ∑𝜆𝛼𝛽µμ]|(?:^|\s)[A-Z]\s*=|=\s*[A-Z_a-z(]"


@query(f"""SELECT doc_id, seq, CAST(CASE WHEN n < 6 THEN -1 ELSE least(n, 40) + CASE WHEN {_ANY(('achieved', 'show', 'identified', 'agreement', 'sensitivity'))} THEN 6 ELSE 0 END - CASE WHEN {_COUNT('[')} <> {_COUNT(']')} THEN 2 ELSE 0 END
- CASE WHEN length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) > greatest(12, floor(length(t) / 3)) THEN 1 ELSE 0 END END AS INTEGER) AS quality, CASE WHEN {_ANY(report.NEGATIVE)} THEN 'negative' WHEN {_ANY(report.POSITIVE)} THEN 'positive' ELSE 'neutral' END AS stance, role,
CASE role WHEN 'front_matter' THEN 'exclude' WHEN 'formula_detail' THEN 'appendix' ELSE 'include' END AS action, array_to_string({_RISKS}, '; ') AS risks FROM (SELECT *, len(regexp_extract_all(t, '[^ \\t\\n\\x0b\\f\\r]+')) AS n, CASE WHEN regexp_matches(t, '{_FRONT}', 'i') THEN 'front_matter' WHEN regexp_matches(t, '{_FORMULA}', 'i') THEN 'formula_detail' ELSE kind END AS role
FROM (SELECT doc_id, seq, kind, sentence || {_END} AS t FROM {CLAIMS}))""")
def claim_wording(spark, sf):
    c = _claims(spark, sf).select("doc_id", "seq", "evidence_type", F.concat("text", _pick(_ENDS, F.col("seq"))).alias("t"))
    t = F.col("t")
    out = c.select("doc_id", "seq", report.claim_quality(t).alias("quality"), report.stance(t).alias("stance"), report.role(F.col("evidence_type"), t).alias("r"), F.array_join(report.overstatements(t), "; ").alias("risks"))
    return out.select("doc_id", "seq", "quality", "stance", "r.role", "r.action", "risks")


def _terms(c: str) -> str:
    bare = f"lower(regexp_replace(regexp_replace({c}, '\\[[^\\]]+\\]', ' ', 'g'), '[^A-Za-z0-9 βµ-]+', ' ', 'g'))"
    words = f"list_transform(string_split_regex({bare}, ' +'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g'))"
    return f"list_distinct(list_filter({words}, lambda w: w <> '' AND NOT list_contains({_LIST(report.EMPTY_WORDS)}, w) AND (length(w) > 2 OR regexp_matches(w, '^[0-9]+$'))))"


@query(f"""SELECT doc_id, seq, overlap, n_terms, n_terms = 0 OR overlap >= CASE WHEN n_terms <= 3 THEN 1 ELSE 2 END AS supported FROM (SELECT s.doc_id, s.seq, len(list_intersect(c, b.t)) AS overlap, len(c) AS n_terms
FROM (SELECT doc_id, seq, {_terms('sentence')} AS c FROM {SENTS}) s JOIN (SELECT item_id, {_terms('text')} AS t FROM benchmark) b ON b.item_id = s.doc_id % (SELECT count(*) FROM benchmark))""")
def lexical_support(spark, sf):
    n_items = max(1, _t(spark, sf, "benchmark").count())
    claims = sentence_split(spark, sf).select("doc_id", "seq", report.terms(F.col("sentence")).alias("c"), (F.col("doc_id") % n_items).alias("item_id"))
    j = claims.join(_t(spark, sf, "benchmark").select("item_id", report.terms(F.col("text")).alias("t")), "item_id")
    return j.select("doc_id", "seq", F.size(F.array_intersect("c", "t")).cast("long").alias("overlap"), F.size("c").cast("long").alias("n_terms"), report.terms_support(F.col("c"), F.col("t")).alias("supported"))


# --- audits of reports ------------------------------------------------------------------------------------------------

_STATES = ("supported", "uncited", "weak_support", "unknown_citation", "material_gap")
_VERDICTS = ("supported", "supported", "weak", "unsupported", "overstated", "material_gap", "supported")
_UNITS = f"(SELECT doc_id, seq, CASE WHEN doc_id % 3 = 0 THEN 'supported' ELSE {_LIST(_STATES)}[CAST((doc_id + seq // 6) % 5 AS INTEGER) + 1] END AS s, CASE WHEN doc_id % 4 = 0 THEN 'supported' ELSE {_LIST(_VERDICTS)}[CAST((doc_id + seq // 4) % 7 AS INTEGER) + 1] END AS v, doc_id % 2 = 0 AS opening FROM {SENTS})"


@query(f"""SELECT *, CASE WHEN a = 0 THEN 'pass' ELSE 'fallback' END AS tier_a_status, CASE WHEN b = 0 THEN 'pass' ELSE 'fallback' END AS tier_b_status, CASE WHEN a + b = 0 THEN 'pass' ELSE 'fallback' END AS status FROM (SELECT d.doc_id, count(*) FILTER (s IN ('uncited', 'unknown_citation') AND NOT opening) AS a,
count(*) FILTER (v IN ('weak', 'overstated')) AS b, count(*) FILTER (v <> 'material_gap') AS checked_claim_unit_count, {', '.join(f"count(*) FILTER (v = '{v}') AS n_{v}" for v in dict.fromkeys(_VERDICTS))} FROM documents d LEFT JOIN {_UNITS} u USING (doc_id) GROUP BY d.doc_id)""".replace("SELECT *, CASE WHEN a", "SELECT * EXCLUDE (a, b), CASE WHEN a"))
def faithfulness_tiers(spark, sf):
    d, q = F.col("doc_id"), F.col("seq")
    opening = F.when(d % 2 == 0, report.INTRODUCTIONS[0]).otherwise("")
    states = {"support_status": F.when(d % 3 == 0, "supported").otherwise(_pick(_STATES, d + F.floor(q / 6))), "verdict": F.when(d % 4 == 0, "supported").otherwise(_pick(_VERDICTS, d + F.floor(q / 4)))}
    units = sentence_split(spark, sf).withColumns(states | {"sentence": F.concat(opening, "sentence")})
    return report.faithfulness(_t(spark, sf, "documents"), units, "doc_id")


_PLAN = {"results": (("P2 p1",), ("P1 p1", "P3 p3"), ("P1 p3", "P9 p9"), ("P9 p9",), ()), "methods": (("P3 p2",), ("P2 p2",), ("P1 p4", "P2 p4"))}
_MOVES = [(s, i, f"m{i}", list(c)) for s, moves in _PLAN.items() for i, c in enumerate(moves, 1)]
_MOVED = "(VALUES " + ", ".join(f"('{s}', {i}, '{label}', {_LIST(c)})" for s, i, label, c in _MOVES if c) + ") AS v(section, ordinal, label, cs)"
_SAID = f"(SELECT doc_id, CASE WHEN seq % 2 = 0 THEN 'results' ELSE 'methods' END AS section, seq, 'P' || (seq % 3 + 1) || ' p' || (seq % 4 + 1) AS citation FROM {CLAIMS})"


@query(f"""WITH said AS {_SAID}, opening AS (SELECT doc_id, section, citation, min(seq) AS pos FROM said GROUP BY ALL), wanted AS (SELECT doc_id, section, ordinal, label, unnest(cs) AS citation, generate_subscripts(cs, 1) AS i FROM documents, {_MOVED}),
moves AS (SELECT w.doc_id, w.section, ordinal, label, min(pos) AS pos, count(pos) AS n, count(*) AS total, coalesce(string_agg(w.citation, '; ' ORDER BY i) FILTER (pos IS NULL), '') AS missing FROM wanted w LEFT JOIN opening o ON o.doc_id = w.doc_id AND o.section = w.section AND o.citation = w.citation GROUP BY ALL),
placed AS (SELECT *, CASE WHEN n = total THEN pos END AS whole, last_value(CASE WHEN n = total THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id, section ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM moves)
SELECT doc_id, rule, section, label AS item, missing AS citations FROM (SELECT *, CASE WHEN n = 0 THEN 'missing_planned_move' WHEN n < total THEN 'partial_planned_move' WHEN whole < before THEN 'out_of_order_planned_move' END AS rule FROM placed) WHERE rule IS NOT NULL
UNION ALL SELECT doc_id, 'unplanned_claim', section, 'C' || seq, citation FROM said s WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.doc_id = s.doc_id AND w.section = s.section AND w.citation = s.citation)""")
def planned_moves(spark, sf):
    q = F.col("seq")
    section = F.when(q % 2 == 0, "## Main Results").otherwise("Methods  used")
    key = F.concat(F.lit("P"), (q % 3 + 1).cast("string"), F.lit(" p"), (q % 4 + 1).cast("string"))
    units = _claims(spark, sf).select("doc_id", section.alias("section"), q.alias("line_no"), F.lit(0).alias("part"), F.array(key).alias("citations"), F.concat(F.lit("C"), q.cast("string")).alias("claim_unit_id"))
    plan = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("ordinal"), F.lit(label).alias("label"), F.array(*[F.lit(x) for x in c]).cast("array<string>").alias("citations")) for s, i, label, c in _MOVES])
    moves = _t(spark, sf, "documents").select("doc_id", F.explode(plan).alias("m")).select("doc_id", "m.*")
    return report.plan_adherence(moves, units, "doc_id").select("doc_id", "rule", "section", "item", F.array_join("citations", "; ").alias("citations"))


_PROSE = ("", "\n## Results  \nAcross 3 papers, the evidence includes more [P1 p2; P3 p4; 5, p. 6; P7 p7; P8 p8]", "\nIn this work  we present [x; P1 p2] a row dump\n|  In this work |")
_RULES = {"raw_evidence_dump_phrase": r"\bevidence\s+includes\b|\bAcross\s+\d+\s+papers?,\s+[^.]*\bevidence\b", "source_author_voice": r"\bin this work\b|\bin this paper\b|\bwe present\b|\bwe developed\b|\bwe demonstrate\b|\bour study\b", "awkward_report_phrase": r"study''s study|\bsupported rows\b|\brow dump\b"}
_LEARNED = ("LES ", "tion the", "  ")
_WRITTEN = f"(SELECT doc_id, text || {_LIST(_PROSE)}[CAST(doc_id % 3 AS INTEGER) + 1] AS t FROM documents)"
_LINES = f"(SELECT doc_id, k, trim(x) AS raw, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split_regex(t, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(t, '\\r?\\n'), 1) AS k FROM {_WRITTEN}))"
_OWN = f"(SELECT doc_id, k, line FROM {_LINES} WHERE line <> '' AND NOT regexp_matches(line, '^[#|]|^[|:\\-\\s]+$'))"
_GROUPS = f"(SELECT doc_id, unnest(list_distinct(g)) AS g, unnest(list_transform(list_distinct(g), lambda x: list_position(g, x))) AS k FROM (SELECT doc_id, regexp_extract_all(t, '\\[[^\\]]+\\]') AS g FROM {_WRITTEN}))"
_SIZE = "len(list_filter(string_split(regexp_replace(g, '[\\[\\]]', '', 'g'), ';'), lambda x: regexp_matches(trim(x), '^P\\d+\\s+p\\d+$|^\\d+,?\\s+[pP]\\.?\\s*\\d+$')))"


@query(f"""WITH own AS {_OWN}, hits AS ({' UNION ALL '.join(f"SELECT doc_id, '{rule}' AS rule, NULL AS phrase, line, min(k) AS k FROM own WHERE regexp_matches(line, '{p}', 'i') GROUP BY doc_id, line" for rule, p in _RULES.items())}
UNION ALL {' UNION ALL '.join(f"SELECT doc_id, 'feedback_blocked_phrase', {_SQ(p)}, raw, min(k) FROM {_LINES} WHERE raw <> '' AND contains(lower(raw), lower({_SQ(p)})) GROUP BY doc_id, raw" for p in _LEARNED if p.strip())}
UNION ALL SELECT doc_id, 'internal_citation_syntax', NULL, g, k FROM {_GROUPS} WHERE {_SIZE} > 0 AND regexp_matches(g, 'P\\d+\\s+p\\d+') UNION ALL SELECT doc_id, 'oversized_citation_bundle', NULL, g, k FROM {_GROUPS} WHERE {_SIZE} > 4
UNION ALL SELECT doc_id, 'missing_required_heading', NULL, '## Results', 1 FROM {_WRITTEN} WHERE NOT list_contains(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: rtrim(x)), '## Results'))
SELECT doc_id, rule, phrase, string_agg(line, ' / ' ORDER BY k) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule, phrase ORDER BY k) AS place FROM hits) WHERE place <= 5 GROUP BY doc_id, rule, phrase""")
def prose_audit(spark, sf):
    written = _t(spark, sf, "documents").select("doc_id", F.concat("text", _pick(_PROSE, F.col("doc_id"))).alias("report"))
    learned = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in _LEARNED])).alias("phrase"))
    return report.prose_issues(written, "doc_id", ("## Results",), learned).select("doc_id", "rule", "phrase", F.array_join("examples", " / ").alias("examples"))


_GAP = "CASE WHEN turn % 4 = 0 THEN '' ELSE role END"


@query(f"SELECT conv_id, message, arg_min('r' || turn, turn) AS reason, min(turn) AS turn FROM (SELECT conv_id, turn, {_GAP} AS message FROM conversations) WHERE message <> '' GROUP BY conv_id, message")
def gap_messages(spark, sf):
    gaps = _t(spark, sf, "conversations").select("conv_id", "turn", F.expr(_GAP).alias("message"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("reason"))
    return report.material_gaps(gaps, "conv_id", "turn").select("conv_id", "message", "reason", "turn")


_REFS = "(SELECT doc_id, unnest(['P1', 'P2']) AS paper, lang || '/' || source AS title, 2000 + doc_id % 25 AS year FROM documents)"


@query(f"""SELECT c.doc_id, seq, 'E' || row_number() OVER (PARTITION BY c.doc_id ORDER BY seq) AS row_id, CASE kind WHEN 'dataset_population' THEN 'populations' ELSE kind || 's' END AS table_name, r.title AS paper_title, r.year FROM {CLAIMS} c LEFT JOIN {_REFS} r ON r.doc_id = c.doc_id AND r.paper = c.paper""")
def evidence_tables(spark, sf):
    null = F.lit(None).cast("string")
    d = _t(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("P1"), F.lit("P2"))).alias("label"), F.concat_ws("/", "lang", "source").alias("title"), (2000 + F.col("doc_id") % 25).alias("year"), null.alias("journal"), null.alias("doi"), "source")
    return report.evidence_tables(_claims(spark, sf), d, "doc_id", ["seq"]).select("doc_id", "seq", "row_id", F.col("table").alias("table_name"), "paper_title", "year")


# --- gates over a model's answers -------------------------------------------------------------------------------------

_DRAFTS = ("  ", "Words of some kind stand here [P9 p9].", "Words of some kind stand here.", "Words of some kind stand here [P1  p2; P1 p2].", "Some words lack any proof. Others stand here [P1 p2].", "Words stand here [P1 p2].\n## Material Gap\nMATERIAL GAP: known\nMATERIAL GAP: more than that [P1 p2].")
_ANSWERS = ("no json", '```json\n{"verdict": "Pass"}\n```', '{"verdict": "pass", "unsupported_claims": ["x"]}', '{"status": "fail"}', "{}")
_COMPOSED = ("empty_model_output", "unknown_citation", "missing_citations", "evidence_bound", "uncited_factual_sentence", "material_gap_expansion")
_VERIFIED = ("verifier_unparseable", "verified", "verifier_rejected", "verifier_rejected", "verifier_rejected")


@query(f"""SELECT conv_id, turn, usable, composed, CASE d WHEN 1 THEN 'unknown_citation' WHEN 0 THEN 'missing_citations' WHEN 2 THEN 'missing_citations' ELSE CASE WHEN NOT ok THEN 'verifier_unavailable' ELSE {_LIST(_VERIFIED)}[CAST(turn % 5 AS INTEGER) + 1] END END AS verified,
CASE WHEN NOT ok THEN 'model_unavailable' WHEN d = 0 THEN 'empty_model_output' WHEN turn % 7 = 2 THEN 'citation_audit_failed' WHEN turn % 7 = 4 THEN 'plan_adherence_failed' WHEN turn % 7 = 5 THEN 'semantic_faithfulness_failed' WHEN role = 'user' THEN 'critic_rejected' ELSE 'candidate_accepted' END AS candidate
FROM (SELECT *, d IN (3, 4, 5) AND turn % 3 <> 0 AS usable, CASE WHEN NOT ok THEN 'model_unavailable' ELSE {_LIST(_COMPOSED)}[CAST(d AS INTEGER) + 1] END AS composed FROM (SELECT conv_id, turn, role, turn % 8 <> 7 AS ok, (conv_id + turn) % 6 AS d FROM conversations))""")
def model_gates(spark, sf):
    n, ok = F.col("turn"), F.col("turn") % 8 != 7
    draft = _pick(_DRAFTS, F.col("conv_id") + n)
    required, gaps = F.array(F.lit("P1 p2")), F.array(F.lit("known"))
    word = lambda hit, bad="fail": F.when(hit, bad).otherwise("pass")
    audits = {"citation": word(n % 7 == 2), "prose_quality": F.lit("pass"), "faithfulness": F.lit("pass"), "plan_adherence": word(n % 7 == 4), "semantic_faithfulness": word(n % 7 == 5, "fallback")}
    return _t(spark, sf, "conversations").select(
        "conv_id", "turn", report.usable_paragraph(F.when(n % 3 != 0, "SUPPORTED"), draft, required).alias("usable"), report.composer_gate(ok, draft, required, gaps)["reason"].alias("composed"),
        report.verifier_gate(ok, _pick(_ANSWERS, n), draft, required)["reason"].alias("verified"), report.candidate_gate(ok, draft, audits, word(F.col("role") == "user", "fallback"))["reason"].alias("candidate"),
    )


# --- pages ------------------------------------------------------------------------------------------------------------

_BREAKS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_SQUEEZED = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_HEAD, _FOOT = ("The header of conversation ", "\nResis-\ntance to MALDI-\ntof and inter-\nNATIONAL rules\nRESULTS:\nPage 12\ndoi: 10.1/x")


@query(f"""WITH own AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex('{_HEAD}' || conv_id || chr(10) || text || CASE WHEN turn % 2 = 0 THEN {_SQ(_FOOT)} ELSE '' END, {_BREAKS}), lambda x: {_SQUEEZED('x')}), lambda x: x <> '') AS l FROM conversations),
ends AS (SELECT conv_id, lower(unnest(list_distinct(list_concat(l[:2], l[greatest(len(l) - 1, 1):])))) AS x FROM own), gone AS (SELECT conv_id, x FROM ends WHERE length(x) >= 8 AND NOT list_contains({_LIST(curation.PAGE_HEADINGS)}, rtrim(regexp_replace(x, ':+$', ''))) GROUP BY conv_id, x HAVING count(*) >= 2),
kept AS (SELECT conv_id, turn, list_filter(l, lambda x: NOT list_contains(coalesce(g, []), lower(x)) AND NOT regexp_matches(x, '^(?:page\\s*)?\\d{{1,4}}$', 'i') AND NOT (contains(lower(x), 'www.') AND (contains(lower(x), 'journal') OR contains(lower(x), 'frontiers'))) AND NOT regexp_matches(x, '\\b(?:doi|issn)\\s*[:/]', 'i')) AS l FROM own LEFT JOIN (SELECT conv_id, list(x) AS g FROM gone GROUP BY conv_id) USING (conv_id))
SELECT conv_id, turn AS page_number, t AS text FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(l, chr(10)), '(^|[^A-Za-z])([A-Z]+)-\\n([A-Za-z]+)', '\\1\\2-\\3', 'g'), '([A-Za-z]+)-\\n([A-Z]+)([^A-Za-z]|$)', '\\1-\\2\\3', 'g'), '([A-Za-z]+)-\\n([A-Za-z]+)', '\\1\\2', 'g')) AS t FROM kept) WHERE t <> ''""")
def cleaned_pages(spark, sf):
    n = F.col("turn")
    whole = F.concat(F.lit(_HEAD), F.col("conv_id").cast("string"), F.lit("\n"), "text", F.when(n % 2 == 0, _FOOT).otherwise(""))
    return curation.clean_pages(_t(spark, sf, "conversations").select("conv_id", n.alias("page_number"), whole.alias("text")), "conv_id")


_TAILS = ("", "\nReferences:\nSmith 2001", "\n REFERENCES \n")
_LISTED = "1. Smith J, a trial (2001)\n2. Jones K, Lancet\n3. Brown L (1999)\n4 none"
_PAGE = f"(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN {_SQ(_LISTED)} WHEN doc_id % 7 = 5 THEN 'references' || chr(10) || text ELSE text || {_LIST(_TAILS)}[CAST(doc_id % 3 AS INTEGER) + 1] END AS t FROM documents)"


@query(f"""SELECT doc_id, CASE WHEN whole THEN '' ELSE body END AS body, CASE WHEN whole THEN t ELSE tail END AS tail FROM (SELECT *, trim(tail) = '' AND len(list_filter(l, lambda x: regexp_matches(trim(x), '^\\d{{1,4}}\\.\\s+[A-Z][A-Za-z''’-]+'))) >= 3
AND len(list_filter(l, lambda x: regexp_matches(x, '\\(\\d{{4}}\\)|\\b(?:J|Journal|Clin|Clinical|Microbiol|Antimicrob|Infect|Med|Pharm|PLoS|Front|Lancet|BMJ)\\b'))) >= 3 AS whole FROM (SELECT *, CASE WHEN pos = 0 THEN t ELSE array_to_string(l[:pos - 1], chr(10)) END AS body, CASE WHEN pos = 0 THEN '' ELSE array_to_string(l[pos + 1:], chr(10)) END AS tail
FROM (SELECT *, coalesce(list_position(list_transform(l, lambda x: regexp_replace(lower({_SQUEEZED('x')}), ':+$', '')), 'references'), 0) AS pos FROM (SELECT doc_id, t, string_split_regex(t, {_BREAKS}) AS l FROM {_PAGE}))))""")
def reference_tails(spark, sf):
    d = F.col("doc_id")
    page = F.when(d % 7 == 3, _LISTED).when(d % 7 == 5, F.concat(F.lit("references\n"), "text")).otherwise(F.concat("text", _pick(_TAILS, d)))
    return _t(spark, sf, "documents").select("doc_id", curation.split_references(page).alias("s")).select("doc_id", "s.body", "s.tail")


@query("""SELECT conv_id, round(avg(1.0::DOUBLE - CASE WHEN n < 20 THEN 0.25 ELSE 0 END - CASE WHEN w THEN 0.1 ELSE 0 END), 3) AS parse_confidence, count(*) AS n_pages, CASE WHEN a IS NULL AND b IS NULL THEN '' WHEN b IS NULL THEN 'short_page' WHEN a IS NULL THEN 'wide_spacing' WHEN a <= b THEN 'short_page,wide_spacing' ELSE 'wide_spacing,short_page' END AS flags
FROM (SELECT *, min(turn) FILTER (n < 20) OVER (PARTITION BY conv_id) AS a, min(turn) FILTER (w) OVER (PARTITION BY conv_id) AS b FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[^\\t-\\r\\x{85}\\p{Z}]+')) AS n, contains(text, repeat(' ', 16)) AS w FROM conversations)) GROUP BY conv_id, a, b""")
def document_scores(spark, sf):
    scored = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("page_number"), curation.parse_score(F.col("text")).alias("parse"))
    return curation.document_parse(scored, "conv_id").select("conv_id", "parse_confidence", "n_pages", F.array_join("parse_flags", ",").alias("flags"))


@query("SELECT user_id, r.attempt, r.confidence, r.n_pages FROM (SELECT user_id, arg_max({'attempt': event_id, 'confidence': c, 'n_pages': p}, (c, p, -event_id)) AS r FROM (SELECT user_id, event_id, event_id % 5 AS c, event_id % 3 AS p FROM events) GROUP BY user_id)")
def best_parses(spark, sf):
    e = F.col("event_id")
    attempts = _t(spark, sf, "events").select("user_id", e.alias("attempt"), (e % 5).alias("confidence"), (e % 3).alias("n_pages"))
    return curation.best_parse(attempts, "user_id").select("user_id", "attempt", "confidence", "n_pages")


# --- requests, labels and identifiers ---------------------------------------------------------------------------------

_ASKS = ("", "Assistant, find papers about ", "assistant: what is known about ", "Please ", "ASSISTANT - ", "Find ", "Show me ", "search for ")
_OPENED = "CASE " + " ".join(f"WHEN regexp_matches(b, {_SQ('^' + o)}, 'i') THEN trim(regexp_replace(b, {_SQ('^' + o)}, '', 'i'))" for o in planning.OPENINGS) + " ELSE b END"


@query(f"""SELECT conv_id, turn, coalesce(nullif({_OPENED}, ''), w) AS query FROM (SELECT *, trim(regexp_replace(w, '^(?:assistant)\\b[\\s,:-]*', '', 'i')) AS b FROM (SELECT conv_id, turn, {_SQUEEZED(f"{_LIST(_ASKS)}[CAST((conv_id + turn) % 8 AS INTEGER) + 1] || CASE WHEN turn % 5 = 1 THEN '' ELSE text END")} AS w FROM conversations))""")
def review_query_normalise(spark, sf):
    asked = F.concat(_pick(_ASKS, F.col("conv_id") + F.col("turn")), F.when(F.col("turn") % 5 == 1, "").otherwise(F.col("text")))
    return _t(spark, sf, "conversations").select("conv_id", "turn", planning.normalize_query_column(asked).alias("query"))


_TOPICS = ("", " stochastic integral", " calculus students of the homework", " martingale", " stochastic", " resistance in hospital", " carbapenemase", " beta lactamase", " resistant surveillance isolates")
_BAG = f"(SELECT doc_id, 8.0::DOUBLE * (doc_id % 10) AS r, {TOK.format(c=f'concat_ws({chr(39)} {chr(39)}, text || {_LIST(_TOPICS)}[CAST(doc_id % 9 AS INTEGER) + 1], lang)')} AS t FROM documents)"
_HAS = lambda xs: f"list_has_any(t, {_LIST(xs)})"
_N = lambda xs: f"len(list_intersect(t, {_LIST(xs)}))"


def _regime_sql(rules, asked) -> str:
    """Rules as (label, condition, cap, base, divisor, rationale, step, count); the condition of the last is TRUE."""
    case = lambda f: "CASE " + " ".join(f"WHEN {r[1]} THEN {f(r)}" for r in rules) + " END"
    value = lambda r: f"round(least({r[2]}::DOUBLE, {r[3]}::DOUBLE + {r[6]}::DOUBLE * ({r[7]}) + r / {r[4]}::DOUBLE), 3)"
    return f"SELECT doc_id, {case(lambda r: _SQ(r[0]))} AS label, {case(value)} AS confidence, {case(lambda r: _SQ(r[5]))} AS rationale FROM (SELECT *, {_N(asked)} AS n FROM {_BAG})"


def _regime(spark, sf, asked):
    extra = _pick(_TOPICS, F.col("doc_id"))
    items = _candidates(spark, sf).withColumns({"title": F.concat("title", extra), "relevance_score": (8 * (F.col("doc_id") % 10)).cast("int")})
    return labelling.auto_label(items, asked).select("doc_id", "label", "confidence", "rationale")


_CALC, _CLASH = labelling.SETS["stochastic_calculus"], labelling.SETS["stochastic_calculus_collision"]
_STOCHASTIC = ("calculus", "les", "martingale", "stochastic", "tion", "und")
_NAMED = _HAS(("brownian", "girsanov", "ito", "martingale", "martingales", "semimartingale", "semimartingales", "stratonovich"))


@query(_regime_sql([
    ("relevant", f"{_NAMED} OR ({_HAS(('stochastic',))} AND {_HAS(('calculus', 'differential', 'equations', 'integral', 'integration'))})", 0.95, 0.7, 300, "metadata matches stochastic-calculus topic evidence", 0.04, _N(_CALC)),
    ("irrelevant", f"{_HAS(('calculus',))} AND {_HAS(_CLASH)}", 0.9, 0.72, 400, "metadata matches generic calculus collision without stochastic context", 0.04, _N(_CLASH)),
    ("maybe", "n >= 2 OR r >= 35", 0.78, 0.55, 350, "metadata partially matches stochastic-calculus query", 0.06, "n"), ("irrelevant", "TRUE", 0.88, 0.68, 400, "metadata lacks stochastic-calculus evidence", 0, "0"),
], _STOCHASTIC))
def regime_stochastic(spark, sf):
    return _regime(spark, sf, _STOCHASTIC)


_SURVEYED = ("cre", "hospital", "les", "surveillance", "tion", "und")
_RESISTS, _WARD, _OFF = _HAS(labelling.RESISTANCE), _HAS(labelling.WARDS), labelling.SETS["surveillance_off_domain"]


@query(_regime_sql([
    ("relevant", f"{_RESISTS} AND {_WARD}", 0.95, 0.72, 300, "metadata matches clinical resistance surveillance", 0.05, "n"),
    ("irrelevant", f"{_HAS(_OFF)} OR (list_has_all(t, ['beta', 'lactamase']) AND NOT {_WARD})", 0.9, 0.7, 350, "metadata lacks clinical ESBL/CRE surveillance context", 0.04, _N(_OFF)),
    ("irrelevant", f"NOT {_RESISTS}", 0.88, 0.68, 350, "metadata lacks ESBL/CRE resistance evidence", 0, "0"), ("maybe", "TRUE", 0.78, 0.55, 350, "metadata partially matches ESBL/CRE surveillance", 0.06, "n"),
], _SURVEYED))
def regime_surveillance(spark, sf):
    return _regime(spark, sf, _SURVEYED)


_DOIS = (" https://doi.org/10.1/", "DOI:10.2/", "http://DX.doi.org/10.3/", "10.4/")


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(trim(x), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '^doi:', '', 'i') AS doi, try_cast(nullif(regexp_extract(y, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INTEGER) AS year, trim(regexp_replace(lower(source || ' / ' || doc_id || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
list_sort(list_transform({TOK.format(c='text')}, lambda w: CASE WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END)) AS stems, CASE WHEN lower(lang) = lower(source) THEN lang ELSE lang || '; ' || source END AS joined
FROM (SELECT *, {_LIST(_DOIS)}[CAST(doc_id % 4 AS INTEGER) + 1] || doc_id AS x, 'v' || n_chars || ' ' || (1700 + doc_id % 500) || ' ' || n_chars AS y FROM documents)""".replace("w[:-2]", "left(w, length(w) - 1)"))
def identifiers(spark, sf):
    d, s = F.col("doc_id"), lambda c: c.cast("string")
    asked = F.concat(F.lit("v"), s(F.col("n_chars")), F.lit(" "), s(1700 + d % 500), F.lit(" "), s(F.col("n_chars")))
    return _t(spark, sf, "documents").select(
        "doc_id", text.normalize_doi(F.concat(_pick(_DOIS, d), s(d))).alias("doi"), text.year(asked).alias("year"), text.slug(F.concat("source", F.lit(" / "), s(d), F.lit("!"))).alias("slug"),
        F.array_sort(F.transform(text.tokens(F.col("text")), text.stem)).alias("stems"), text.join_unique(F.array("lang", F.upper("lang"), "source", "lang")).alias("joined"),
    )
