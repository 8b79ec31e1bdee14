"""Readers of the formats the engine takes: manifests, corpora, provider payloads, page text; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_markup, inverted_index_text, normalize_doi, trailing_id, year
from ..operators.candidates import atom_candidates

WORKS = "struct<results:array<struct<ids:struct<doi:string,pmid:string,pmcid:string>,display_name:string,publication_year:int,primary_location:struct<landing_page_url:string,pdf_url:string,source:struct<display_name:string>>,open_access:struct<oa_status:string,oa_url:string>,abstract_inverted_index:map<string,array<int>>,concepts:array<struct<display_name:string>>>>>"


def spread(df: DataFrame) -> DataFrame:
    """A table of few row groups, dealt over all cores: a scan has no more tasks than row groups, however costly its rows are.

    A table with more row groups than cores, which any large one has, is left as it is, so what is shuffled is bounded.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sources of manifest files, each either CSV, if a comma is among its first 4,096 characters, or a list.

    CSV: the first column, rows that start with "source" left out. Lists: one a line, comments left out. Blank ones go in both.
    """
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.left("value", F.lit(4096)).contains(",").alias("csv"), F.explode(F.split("value", r"\r\n|\r|\n")).alias("line"))
    quoted = F.replace(F.regexp_extract("line", r'^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    first = F.when(F.startswith("line", F.lit('"')), quoted).otherwise(F.substring_index("line", ",", 1))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    source = F.when(F.col("csv"), F.when(~F.lower(first).startswith("source"), bare(first))).otherwise(F.when(~bare(F.col("line")).startswith("#"), bare(F.col("line"))))
    return lines.select(source.alias("source")).where("source <> ''")


def works(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Candidates of JSON works payloads; a title and a source are needed."""
    w = payloads.select(F.explode(F.from_json(col, WORKS)["results"]).alias("w"))
    doi = normalize_doi(F.col("w.ids.doi"))
    source = F.coalesce(F.nullif(doi, F.lit("")), F.col("w.primary_location.pdf_url"), F.col("w.primary_location.landing_page_url"))
    out = w.select(F.lit("openalex").alias("provider"), F.trim("w.display_name").alias("title"), source.alias("source"), doi.alias("doi"), trailing_id(F.col("w.ids.pmid")).alias("pmid"), F.col("w.publication_year").alias("year"), inverted_index_text(F.col("w.abstract_inverted_index")).alias("abstract"), F.col("w.primary_location.source.display_name").alias("journal"), F.array_join(F.transform("w.concepts", lambda c: c["display_name"]), "; ").alias("concepts"), F.col("w.open_access.oa_status").alias("oa_status"))
    return out.where("title is not null and title <> '' and source is not null")


def summaries(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """Candidates of JSON summary payloads: a map of ids to records, and the list of ids to take."""
    kind = "struct<title:string,uid:string,pubdate:string,fulljournalname:string,articleids:array<struct<idtype:string,value:string>>>"
    ids = F.from_json(F.get_json_object(col, "$.result.uids"), "array<string>")
    rec = payloads.select(col, F.explode(ids).alias("pmid")).select("pmid", F.from_json(F.element_at(F.from_json(F.get_json_object(col, "$.result"), "map<string,string>"), F.col("pmid")), kind).alias("r"))
    doi = F.get(F.filter("r.articleids", lambda a: a["idtype"] == "doi"), 0)["value"]
    return rec.where("r.title is not null").select(F.lit("pubmed").alias("provider"), F.trim("r.title").alias("title"), "pmid", doi.alias("doi"), F.coalesce(doi, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/"))).alias("source"), year(F.col("r.pubdate")).alias("year"), F.col("r.fulljournalname").alias("journal"))


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of Atom feeds, one feed a file."""
    return atom_candidates(spark.read.text(path, wholetext=True), "value")


def pages(text: Column) -> Column:
    """struct(page_number, text) of pages parted by form feeds; blank pages go, numbers stay."""
    split = F.transform(F.split(text, "\f"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text")))
    return F.filter(split, lambda p: F.trim(F.regexp_replace(p["text"], r"\s+", " ")) != "")


def hrefs(html: Column) -> Column:
    """Targets of anchors, in order."""
    return F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), 1)


#: Meta names whose content is a PDF's address.
PDF_META = ("citation_pdf_url", "dc.identifier", "og:pdf")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare, with the commonest entities read; null where it is missing."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    for old, new in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return F.when(tag.rlike(pattern), value)


def pdf_hrefs(html: Column) -> Column:
    """Targets that look like PDFs, in order: of anchors, of links of a PDF's relation or type, and of the meta names ``PDF_META``.

    A target looks like one if its path ends in .pdf, /pdf or /pdfft, is pdf or pdfft, or passes through /pdf/.
    """
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<(?:a|link|meta)[\s/](?:"[^"]*"|'[^']*'|[^"'>])*>"""), 0)
    low = lambda t, name: F.lower(F.coalesce(_attribute(t, name), F.lit("")))
    linked = lambda t: F.when(low(t, "rel").contains("pdf") | (low(t, "type") == "application/pdf"), _attribute(t, "href"))
    named = lambda t: F.lower(F.coalesce(F.nullif(_attribute(t, "name"), F.lit("")), _attribute(t, "property"), F.lit("")))
    target = lambda t: F.when(t.rlike(r"(?i)^<a[\s/]"), _attribute(t, "href")).when(t.rlike("(?i)^<link"), linked(t)).when(named(t).isin(*PDF_META), _attribute(t, "content"))
    path = lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", ""), "[?#;].*$", "")
    return F.filter(F.transform(tags, target), lambda h: h.isNotNull() & (h != "") & (path(h).isin("pdf", "pdfft") | path(h).rlike(r"(?:\.pdf|/pdf|/pdfft)$|/pdf/")))


def plain(html: Column) -> Column:
    return clean_markup(html)


def front_matter(text: Column) -> Column:
    """A map of the ``key: value`` lines between two lines of three dashes at a note's start."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder tree with size, hash and whether they begin as a PDF does; others are rejected with a reason."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ok = F.startswith("content", F.lit(b"%PDF-"))
    return df.select("path", "length", F.sha2("content", 256).alias("sha256"), F.when(ok, F.lit("stored")).otherwise("blocked").alias("status"), F.when(~ok, F.lit("unsupported_file_type")).alias("reason"))


def sorted_json(df: DataFrame) -> DataFrame:
    """Rows as JSON with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))
