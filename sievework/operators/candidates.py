"""Candidates: identity, provider payloads, open-access links, corpus imports and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.text import clean_markup, join_unique, normalize_doi, slug, year
from .relational import first_per_key

#: What a field of a corpus entry weighs for a term of the question.
FIELD_WEIGHTS = {"title": 8, "abstract": 4, "tags": 6, "venue": 2, "authors": 1, "identifiers": 1}
#: Words that do not count in a question, and words that mean mathematics.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "in", "is", "it", "me", "of", "on", "or", "that", "the", "to", "using", "what", "with")
MATH = ("mathematics", "mathematical", "mathematic")
ATOM = "struct<entry:array<struct<title:string,summary:string,id:string,published:string,doi:string,link:array<struct<_title:string,_type:string,_href:string>>>>>"
ARTICLES = "struct<PubmedArticle:array<struct<MedlineCitation:struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<Journal:struct<Title:string>,Abstract:struct<AbstractText:array<struct<_VALUE:string,_Label:string>>>>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string>>>>>>>>"
PEOPLE, ISSUED = "array<struct<given:string,family:string,literal:string>>", "struct<`date-parts`:array<array<string>>>"
CORPUS = "array<struct<citation_key:string,title:string,authors:array<struct<family:string,given:string,literal:string>>,year:int,doi:string,abstract:string,venue:string,tags:array<string>,source_pointer:string,source_type:string,obtained_via:string>>"


def clean(c: Column) -> Column:
    """Markup off, white space single; an empty text is null."""
    return F.nullif(clean_markup(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def candidate_key(doi: Column, pmid: Column, arxiv_id: Column, source: Column) -> Column:
    """What makes two candidates one: doi, else pmid, else arXiv id, else source."""
    named = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}:"), c))
    return F.coalesce(named("doi", F.lower(doi)), named("pmid", pmid), named("arxiv", F.lower(arxiv_id)), F.concat(F.lit("source:"), F.lower(F.coalesce(source, F.lit("")))))


def dedupe(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The first of each candidate by ``order``; columns doi, pmid, arxiv_id, source."""
    keyed = candidates.withColumn("key", candidate_key(*[F.col(c) for c in ("doi", "pmid", "arxiv_id", "source")]))
    return first_per_key(keyed, ["key"], order)


def atom_candidates(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Candidates of Atom feeds; a title, an id and a page are needed. The PDF link is the one titled so, else of that type, else made of the id."""
    feed = F.from_xml(F.regexp_replace(F.col(col), r"<(/?)[A-Za-z]+:", "<$1"), ATOM)
    e = payloads.select(F.explode(feed["entry"]).alias("e")).select("e.*")
    own = F.regexp_extract(F.trim("id"), r"/abs/([^?#]+?)/?$", 1)
    link = lambda test: F.get(F.filter("link", test), 0)["_href"]
    pdf = F.coalesce(link(lambda x: x["_title"] == "pdf"), link(lambda x: x["_type"] == "application/pdf"), F.concat(F.lit("https://arxiv.org/pdf/"), own))
    pdf = F.regexp_replace(pdf, "^http://", "https://")
    rows = e.select(F.lit("arxiv").alias("provider"), clean(F.col("title")).alias("title"), F.nullif(normalize_doi(F.col("doi")), F.lit("")).alias("doi"), own.alias("arxiv_id"), year(F.col("published")).alias("year"), F.trim("id").alias("url"), pdf.alias("pdf_url"), pdf.alias("source"), clean(F.col("summary")).alias("abstract"))
    return rows.where("title is not null and url <> '' and arxiv_id <> ''")


def article_details(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """pmid, abstract (labelled parts joined), mesh_terms and journal of article XML; the last of an id counts within a payload."""
    a = payloads.select(F.explode(F.from_xml(F.col(col), ARTICLES)["PubmedArticle"]["MedlineCitation"]).alias("m"))
    part = lambda t: F.when(F.coalesce(clean(t["_Label"]), F.lit("")) != "", F.concat(clean(t["_Label"]), F.lit(": "), clean(t["_VALUE"]))).otherwise(clean(t["_VALUE"]))
    parts = F.filter(F.transform("m.Article.Abstract.AbstractText", part), lambda x: x.isNotNull())
    mesh = F.filter(F.transform("m.MeshHeadingList.MeshHeading", lambda h: clean(h["DescriptorName"]["_VALUE"])), lambda x: x.isNotNull())
    rows = a.select(clean(F.col("m.PMID._VALUE")).alias("pmid"), F.nullif(F.array_join(parts, " "), F.lit("")).alias("abstract"), F.nullif(join_unique(mesh), F.lit("")).alias("mesh_terms"), clean(F.col("m.Article.Journal.Title")).alias("journal"))
    return rows.where("pmid is not null")


def merge_details(candidates: DataFrame, details: DataFrame) -> DataFrame:
    """Candidates with the details of their pmid: abstract and journal where there are any, mesh terms always; others as they are."""
    own = details.select("pmid", F.struct("abstract", "mesh_terms", "journal").alias("_d"))
    rows = candidates.join(own, "pmid", "left")
    has = F.col("_d").isNotNull()
    return rows.withColumns({"abstract": F.coalesce("_d.abstract", "abstract"), "journal": F.coalesce("_d.journal", "journal"), "mesh_terms": F.when(has, F.col("_d.mesh_terms")).otherwise(F.col("mesh_terms"))}).select(*candidates.columns)


def open_access_status(status: Column, is_oa: Column) -> Column:
    return F.coalesce(clean(status), F.when(is_oa, "oa").when(~is_oa, "closed"))


def pdf_path(url: Column) -> Column:
    """Whether an address looks like that of a PDF by its path."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return path.endswith(".pdf") | path.endswith("/pdf") | path.contains("/pdf/")


def open_access_pdf(links: Column) -> Column:
    """The first of an ordered array of addresses that looks like a PDF, or null."""
    tidy = F.transform(links, lambda x: clean(x))
    return F.get(F.filter(tidy, lambda x: F.coalesce(pdf_path(x), F.lit(False))), 0)


def concepts(*names: Column) -> Column:
    """Arrays of names in order, each name once whatever its case, joined by '; '; null without any."""
    every = F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names])
    return F.nullif(join_unique(F.filter(F.transform(every, lambda x: clean(x)), lambda x: x.isNotNull())), F.lit(""))


def resolve_pdf(provider: Column, arxiv_id: Column, links: list[tuple[Column, str]], gate: policy.SourcePolicy) -> Column:
    """struct(url, reason): the arXiv address, else the first link (with its reason) that looks like a PDF and passes the gate."""
    ok = lambda c: F.coalesce(policy.gate(c, gate)["allowed"] & (pdf_path(c) | F.lower(c).endswith("/pdfft")), F.lit(False))
    made = F.when((provider == "arxiv") & (arxiv_id != ""), F.struct(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id).alias("url"), F.lit("resolved_arxiv_pdf").alias("reason")))
    for c, reason in links:
        made = made.when(ok(c), F.struct(policy.gate(c, gate)["normalized"].alias("url"), F.lit(reason).alias("reason")))
    return made.otherwise(F.struct(F.lit(None).cast("string").alias("url"), F.lit("no_safe_pdf_url").alias("reason")))


# --- corpora ----------------------------------------------------------------------------------------------------------


def csl_entries(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Corpus entries of CSL JSON (a list, or an object with items), with status and reason: without a title an item is rejected."""
    kind = "array<map<string,string>>"
    listed = F.from_json(F.when(F.trim(col).startswith("["), F.col(col)).otherwise(F.get_json_object(col, "$.items")), kind)
    i = payloads.select(F.posexplode(listed).alias("at", "m")).select((F.col("at") + 1).alias("place"), "m")
    own = lambda *names: clean(F.coalesce(first_present(*[F.element_at("m", F.lit(n)) for n in names]), F.lit("")))
    title = own("title")
    name = F.coalesce(own("id", "citation-key", "citationKey"), slug(title))
    people = F.transform(F.from_json(F.element_at("m", F.lit("author")), PEOPLE), lambda a: F.coalesce(clean(a["literal"]), F.trim(F.concat_ws(" ", a["given"], a["family"]))))
    when = F.get(F.get(F.from_json(F.element_at("m", F.lit("issued")), ISSUED)["date-parts"], 0), 0).try_cast("int")
    pointer = F.coalesce(own("URL"), F.concat(F.lit("zotero:"), name))
    status = F.when(title.isNull(), "rejected").otherwise("valid")
    return i.select("place", status.alias("status"), F.when(title.isNull(), "missing_required_field").alias("reason"), name.alias("citation_key"), title.alias("title"), people.alias("authors"), when.alias("year"), own("DOI", "doi").alias("doi"), own("abstract").alias("abstract"), own("container-title", "publisher").alias("venue"), pointer.alias("source_pointer"), F.lit("zotero").alias("source_type"))


def parse_paths(value: str | list[str] | None, separator: str = ":") -> list[str]:
    """Paths of a setting: parts between commas, line feeds and the separator, trimmed, blank ones out."""
    raw = [] if value is None else [value] if isinstance(value, str) else list(value)
    return [p.strip() for text in raw for p in text.replace("\n", ",").replace(separator, ",").split(",") if p.strip()]


def load_corpora(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries of corpus files, and path and reason of each file that gives none: missing_file, invalid_json or invalid_corpus.

    Files are JSON objects with a list literature_corpus, each read whole by one task.
    """
    missing, there = [], []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        (there if fs.exists(path) else missing).append(p)
    gone = spark.createDataFrame([(p, "missing_file") for p in missing], "path string, reason string")
    if not there:
        return spark.createDataFrame([], f"path string, x {CORPUS}").select("path", F.explode("x").alias("e")).select("path", "e.*"), gone
    raw = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    entries = F.get_json_object("value", "$.literature_corpus")
    parsed = raw.select("path", F.try_parse_json("value").alias("m"), F.when(entries.startswith("["), F.from_json(entries, CORPUS)).alias("x"))
    bad = parsed.where("x is null").select("path", F.when(F.col("m").isNull(), "invalid_json").otherwise("invalid_corpus").alias("reason"))
    return parsed.where("x is not null").select("path", F.explode("x").alias("e")).select("path", "e.*"), bad.unionByName(gone)


def route_tokens(c: Column) -> Column:
    """Distinct tokens of a field in the form in which questions and fields are compared."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.transform(found, lambda t: F.when(t.isin(*MATH), "math").when(t.endswith("ies") & (F.length(t) > 4), F.regexp_replace(t, "ies$", "y")).when(t.endswith("s") & (F.length(t) > 4), F.regexp_replace(t, "s$", "")).otherwise(t)))


def route(entries: DataFrame, question: str, fields: dict[str, Column], order: list[Column], min_score: int = 12, min_matches: int = 1, limit: int = 20) -> DataFrame:
    """Entries that answer a question, best first, with score and matched_terms; none at all if under ``min_matches`` do.

    Each term counts a field's weight once for each field that holds it. ``fields``: columns by the names of FIELD_WEIGHTS.
    """
    asked = F.filter(route_tokens(F.lit(question)), lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))
    hits = {name: F.array_intersect(route_tokens(c), asked) for name, c in fields.items()}
    score = sum((FIELD_WEIGHTS[n] * F.size(h) for n, h in hits.items()), F.lit(0))
    rows = entries.withColumns({"score": score, "matched_terms": F.array_sort(F.array_distinct(F.concat(*hits.values())))}).where(F.col("score") >= min_score)
    top = rows.orderBy(F.desc("score"), *order).limit(max(0, limit))
    enough = top.agg((F.count("*") >= max(1, min_matches)).alias("use"))
    return top.join(F.broadcast(enough.where("use")), how="cross").drop("use")
