"""Pages to evidence: cleaning, parse scores, sections, quality flags, quotas and the page and document gates.

Pages have a document key, page_number and text. Everything is per page but for repeated edge lines (one aggregate per document
and line) and the quotas (windows per document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import settled
from .evidence import FRONT_MATTER, INJECTION

#: Ligatures, headings and the sections they open, and the sections that a type may stand in.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
PAGE_HEADINGS = ("abstract", "background", "objective", "methods", "method", "materials and methods", "results", "discussion", "conclusion", "conclusions", "limitations", "limitation")
SECTIONS = {
    "abstract": "abstract", "background": "abstract", "objective": "abstract", "objectives": "abstract", "methods": "methods", "method": "methods", "materials and methods": "methods", "methodology": "methods", "dataset": "methods",
    "population": "methods", "results": "results", "findings": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "limitations": "limitations", "limitation": "limitations",
    "references": "references", "acknowledgements": "references", "acknowledgments": "references",
}
SUPPORTS = {
    "claim": ("unknown", "abstract", "discussion", "conclusion"), "method": ("unknown", "abstract", "methods"), "result": ("unknown", "abstract", "results", "discussion", "conclusion"),
    "dataset_population": ("unknown", "abstract", "methods", "results"), "limitation": ("unknown", "abstract", "discussion", "conclusion", "limitations"),
}
#: Fixed values.
INLINE = r"Abstract|Background|Objective|Methods?|Results?|Conclusion|Limitations?|Dataset|Population"
#: Fixed values.
LEADING = ("results and discussion", "materials and methods", "result and discussion", "introduction", "methodology", "conclusions", "limitations", "background", "objectives", "discussion", "conclusion", "limitation", "population", "objective", "abstract", "findings", "methods", "results", "dataset", "method", "result")
#: Patterns of the evidence types, tried in this order.
TYPES = {
    "limitation": r"\blimitations?\b|\blimited by\b|\bsingle[- ]center\b|\bsmall sample\b|\bfurther validation\b",
    "result": r"\bresults?\b|\bachieved\b|\b(?:improved|increased|decreased|reduced)\b|\b(?:accuracy|sensitivity|specificity|auc|auroc|f1[- ]score)\b|\bp\s*[<=>]\s*0?\.\d+|\bsignificant(?:ly)?\b",
    "method": r"\bwe (?:used|use|analyzed|analysed|trained|evaluated|performed)\b|\bthis (?:review|study) used\b|\busing\b|\b(?:classifier|model|regression|machine learning|random forest)\b|\bspectra were\b",
    "dataset_population": r"\bdatasets?\b|\bcohort\b|\bpopulation\b|\bpatients?\b|\bparticipants?\b|\bclinical isolates?\b|\bisolates?\b|\bsamples?\b|\bspecimens?\b|\bn\s*=\s*\d+",
    "claim": r"\bwe (?:show|demonstrate|present|propose|develop|developed|report)\b|\bthis study (?:shows|demonstrates|presents|reports)\b|\bour findings\b|\bobjective\b",
}
#: Signs of stitched columns (whatever the case, and as written).
STITCHED = (
    r"\btable\s+\d+\s*\|", r"\bfigure\s+\d+\s*\|", r"\bfrontiers in\b.*\bwww\.", r"\bwww\.[^\s]+", r"\binterpretation of however\b", r"\bthus interpretation of however\b",
    r"\b(?:the|this|a|an|we|they)\s+[a-z]+\s+(?:both|however|the|they|when|thus)\b", r"\bthey this\b", r"\b(?:maldi|tof)-in\b", r"\bthe sample microbial\b", r"\bavailability of many within\b", r"\bin the a number of\b",
    r"\ba number of .* matrices sample\b", r"\btables?\s+\d+\b", r"\bfigures?\s+\d+\b", r"\busing unfortunately\b", r"\bof understanding leads\b", r"\bfrom are manifold\b", r"\barticles\s+seTo\b", r"\breregion\b", r"\bmutationinduced\b",
    r"\bregularizagating\b", r"\braising awareness of malaysia\b", r"\bthe discovery resistance\b", r"\brelatable and appropriate journals\b", r"\bdespite the more\b", r"\btheir mass aminoglycoside\b", r"\bresulted in the caused\b", r"\bgramsingle\b",
    r"\bfda two significant areas\b", r"\buse formulary\b", r"\bsuccessfully studies reported\b", r"\bprotect highly seems\b", r"\bmost over the patient\b", r"\btight plasmids\b", r"\bit is bank\b", r"\bwrote the introis\b", r"\bthe marized using\b",
    r"\bescheriand\b", r"\b(?:β|beta|-)?lactam lactamases\b", r"\blower respiratory tract\s+\d+$", r"^secondary of microorganisms\b", r"\ba previous study mic range\b.*\bin parallel\b", r"\bminimum the use\b", r"\bpathogen\s+ance\b",
    r"\bin only gentamicin\b", r"\bresistance pattern addition\b", r"^the resistant was\b", r",\s+the most critical group\b", r"\bhigh prevalence bacteriological profile\b", r"\bcurrent microbial isolates from wound swabs\b",
    r"\bone study compared mic results using broth in susceptibility\b", r"\boverall median phenotypic results\b", r"\bbruker\s+after exposure\b.*\bdaltonics\b", r"\bclinprottools\b.*\bbruker\s+after exposure\b",
    r"\bafter exposure of\s+[-–−]\s*lactam antibiotics to\s+[-–−]\s*lactamase producing\s+daltonics\b",
)
STITCHED_AS_WRITTEN = (r"\breSearch strategy\b", r"^(?:[A-Z][a-z]+ [A-Z],\s*){2,}")
#: Fixed values.
EMBEDDED = ("article quality assessment", "availability of data and materials", "data extraction", "limitations of this study", "microbial resistance patterns", "search strategy")
#: Fixed values.
STARTERS = ("Article", "Articles", "Background", "Both", "By", "Coding", "Data", "Each", "For", "If", "Information", "Initial", "Interviews", "Methods", "Microbial", "No", "Objective", "Poultry", "Results", "Secondly", "The", "This", "Thus", "Unfortunately")
#: Fixed values.
ANCHORS = r"\b(?:this review|this study|our findings|article retrieval and screening|structured search|inclusion/exclusion|clinical isolates|validation cohort|auroc|auc|sensitivity|specificity)\b"

STRINGS = "array<string>"


def finds(c: Column, pattern: str, case: bool = False) -> Column:
    """Whether a pattern is found, with letters, digits and blanks of every script."""
    return c.rlike(("(?U)" if case else "(?iU)") + pattern)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + pattern))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    return count(c, r"\b[A-Za-z0-9][A-Za-z0-9-]*\b")


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


# --- pages ------------------------------------------------------------------------------------------------------------


def clean_pages(pages: DataFrame, doc: str, edge: int = 2) -> DataFrame:
    """doc, page_number and cleaned text; pages left empty go, the others keep their number.

    Lines that stand among the first or last ``edge`` of two or more pages go, as do page numbers, journal addresses and
    DOI or ISSN lines. A word broken at a line's end is joined, with its hyphen if either half is all capitals.
    """
    text = F.col("text")
    for old, new in LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    own = pages.select(doc, "page_number", F.filter(F.transform(lines(text), squeezed), lambda x: x != "").alias("l"))
    n = F.size("l")
    ends = F.array_distinct(F.concat(F.slice("l", 1, edge), F.slice("l", F.greatest(n - edge + 1, F.lit(1)), edge)))
    heading = lambda x: F.lower(F.rtrim(F.regexp_replace(x, ":+$", ""))).isin(*PAGE_HEADINGS)
    worth = F.filter(ends, lambda x: (F.length(x) >= 8) & ~heading(x))
    twice = own.where(n > 0).select(doc, F.explode(worth).alias("x")).groupBy(doc, F.lower("x").alias("x")).agg(F.count("*").alias("k")).where("k >= 2")
    gone = twice.groupBy(doc).agg(F.collect_set("x").alias("gone"))
    low = lambda x: F.lower(x)
    furniture = lambda x: finds(x, r"^(?:page\s*)?\d{1,4}$") | (low(x).contains("www.") & (low(x).contains("journal") | low(x).contains("frontiers"))) | finds(x, r"\b(?:doi|issn)\s*[:/]")
    none = F.array().cast(STRINGS)
    joined = own.join(gone, doc, "left").select(doc, "page_number", F.array_join(F.filter("l", lambda x: ~F.array_contains(F.coalesce("gone", none), F.lower(x)) & ~furniture(x)), "\n").alias("text"))
    return joined.withColumn("text", F.trim(join_hyphens(F.col("text")))).where("text <> ''")


def join_hyphens(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(c, r"(?<![A-Za-z])([A-Z]+)-\n([A-Za-z]+)", "$1-$2"), r"([A-Za-z]+)-\n([A-Z]+)(?![A-Za-z])", "$1-$2")
    return F.regexp_replace(kept, r"([A-Za-z]+)-\n([A-Za-z]+)", "$1$2")


def parse_score(c: Column) -> Column:
    """struct(confidence, flags) of a page's text."""
    short, stitched, wide = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")) < 20, c.contains("Articles seTo") | c.contains("reSearch strategy"), c.contains(" " * 16)
    value = 1.0 - F.when(short, 0.25).otherwise(0.0) - F.when(stitched, 0.45).otherwise(0.0) - F.when(wide, 0.1).otherwise(0.0)
    return F.struct(F.round(F.greatest(F.lit(0.0), value), 3).alias("confidence"), F.array_compact(F.array(F.when(short, F.lit("short_page")), F.when(stitched, F.lit("column_stitching")), F.when(wide, F.lit("wide_spacing")))).alias("flags"))


def document_parse(scored: DataFrame, doc: str) -> DataFrame:
    """Mean confidence of a document's pages (columns page_number, parse: struct(confidence, flags)) and its flags, each once, by first page."""
    each = scored.select(doc, F.col("parse.confidence").alias("c"), "page_number", "parse.flags")
    flags = each.select(doc, "page_number", F.explode("flags").alias("f")).groupBy(doc, "f").agg(F.min("page_number").alias("p")).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "f"))), lambda x: x["f"]).alias("parse_flags"))
    mean = each.groupBy(doc).agg(F.round(F.avg("c"), 3).alias("parse_confidence"), F.count("*").alias("n_pages"))
    return mean.join(flags, doc, "left").withColumn("parse_flags", F.coalesce("parse_flags", F.array().cast(STRINGS)))


def best_parse(attempts: DataFrame, doc: str) -> DataFrame:
    """Of several parses of a document (confidence, n_pages, attempt): the surest, then the longest, then the first."""
    rest = [c for c in attempts.columns if c != doc]
    return attempts.groupBy(doc).agg(F.max_by(F.struct(*rest), F.struct("confidence", "n_pages", -F.col("attempt"))).alias("r")).select(doc, "r.*")


def reference_list(c: Column) -> Column:
    """Whether a page looks like a list of references: three or more numbered entries, and three or more lines with a year or journal."""
    own = F.filter(F.transform(lines(c), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.size(F.filter(own, lambda x: x.rlike(r"^\d{1,4}\.\s+[A-Z][A-Za-z'’-]+")))
    marked = F.size(F.filter(own, lambda x: finds(x, r"\(\d{4}\)|\b(?:J|Journal|Clin|Clinical|Microbiol|Antimicrob|Infect|Med|Pharm|PLoS|Front|Lancet|BMJ)\b", case=True)))
    return (numbered >= 3) & (marked >= 3)


def split_references(c: Column) -> Column:
    """struct(body, tail) of a page, cut at its first line ``references``; a page that is a list of references is all tail."""
    own = lines(c)
    at = F.array_position(F.transform(own, lambda x: F.regexp_replace(F.lower(squeezed(x)), ":+$", "")), "references").cast("int")
    body = F.when(at > 1, F.array_join(F.slice(own, F.lit(1), F.greatest(at - 1, F.lit(1))), "\n")).when(at == 1, "").otherwise(c)
    tail = F.when(at > 0, F.array_join(F.slice(own, F.greatest(at + 1, F.lit(1)), F.greatest(F.size(own) - at, F.lit(0))), "\n")).otherwise("")
    whole = (F.trim(tail) == "") & reference_list(c)
    return F.struct(F.when(whole, "").otherwise(body).alias("body"), F.when(whole, c).otherwise(tail).alias("tail"))


def sectioned_sentences(c: Column) -> Column:
    """struct(section, sentence) in order; a line that is only a heading opens a section, ``unknown`` stands before the first."""
    table = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    mark = lambda x: F.try_element_at(table, squeezed(F.lower(F.regexp_replace(F.trim(x), "^:+|:+$", ""))))
    flat = F.array_join(F.transform(lines(c), lambda x: F.coalesce(F.concat(F.lit("\x01"), mark(x), F.lit("\x02")), x)), " ")
    blocks = F.split(flat, "\x01")
    out = F.transform(blocks, lambda b: F.transform(split_sentences(F.regexp_replace(b, "^[a-z]+\x02", "")), lambda s: F.struct(F.coalesce(F.nullif(F.regexp_extract(b, "^([a-z]+)\x02", 1), F.lit("")), F.lit("unknown")).alias("section"), s.alias("sentence"))))
    return F.flatten(out)


def split_sentences(c: Column) -> Column:
    """Sentences without outer blanks and full stops; an inline heading with a colon begins one."""
    ready = F.regexp_replace(F.regexp_replace(c, rf"(?iU)\b({INLINE}):", ". $1:"), "[\r\n]+", " ")
    return F.filter(F.transform(F.split(ready, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", "")), lambda s: s != "")


def sanitize(c: Column, most: int = 500) -> Column:
    """Printable text without "page x of y", squeezed, cut to ``most`` characters with three dots."""
    bare = squeezed(F.regexp_replace(F.regexp_replace(c, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}]", " "), r"(?iU)\bpage\s+\d+\s+of\s+\d+\b", " "))
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.rtrim(F.substring(bare, 1, most - 3)), F.lit("...")))


def strip_heading(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), rf"(?iU)^(?:{'|'.join(LEADING)})\s*(?::|\.|-)?\s+", ""), r"^[ .]+|[ .]+$", "")


# --- quality ----------------------------------------------------------------------------------------------------------


def layout_flags(c: Column) -> list[tuple[str, Column]]:
    """Signs of broken layout, in order, as flag and condition."""
    low = F.lower(c)
    bound = {h: rf"(?<![a-z0-9]){h}(?![a-z0-9])" for h in EMBEDDED}
    times = {h: F.regexp_count(low, F.lit(p)) for h, p in bound.items()}
    at = {h: F.regexp_instr(low, F.lit(p)) for h, p in bound.items()}
    several = sum((F.when(t > 0, 1).otherwise(0) for t in times.values()), F.lit(0)) >= 2
    late = F.lit(False)
    for h in EMBEDDED:
        hit, most = at[h] > 21, F.lit(False)
        if h == "search strategy":
            most = F.rtrim(F.substring(low, F.greatest(at[h] - 16, F.lit(1)), F.least(at[h] - 1, F.lit(16)))).endswith("structured")
        late, several = late | (hit & ~most), several | (times[h] >= 2)
    caps = F.regexp_extract_all(c, F.lit(r"(?U)\b(?:[A-Z][A-Z-]{2,}|AND|OF|FOR|THE|IN|TO)(?:\s+(?:[A-Z][A-Z-]{2,}|AND|OF|FOR|THE|IN|TO)){2,}\b"), 0)
    loud = F.exists(caps, lambda m: F.exists(F.split(m, r"\s+"), lambda w: F.length(F.regexp_replace(w, "^-+|-+$", "")) >= 7))
    t = F.trim(c)
    signs, brackets, words = F.regexp_count(t, F.lit("[~∈∞∗∑∫√≤≥<>⊂⊕⊖⨏̃τ−]")), F.regexp_count(t, F.lit(r"[()\[\]{}]")), word_count(t)
    operators = F.regexp_count(t, F.lit(r"[A-Za-z]\s*[=<>]\s*[A-Za-z0-9~]|[A-Za-z]\s*[-+]\s*~|~\s*[A-Za-z0-9]"))
    formula = (
        ((signs + brackets >= 18) & (operators >= 2)) | ((words <= 20) & (signs + brackets >= 6) & (operators >= 2)) | (t.rlike(r"^[<>=~({\[]") & (t.contains(",,") | t.contains("~")) & (words <= 16))
        | ((signs >= 4) & t.rlike(r"[:=]\s*[\{\[\(]?\s*\d+\s*,\s*$")) | (t.rlike(r"\b[A-Za-z][A-Za-z0-9]*\([^)]{0,20}~[^)]*\)") & (signs >= 3))
    )
    spaced = count(c, r"\b(?:[A-Za-z]\s+){3,}[A-Za-z]\b")
    dense = (count(c, r"\b(?:NA|NS|HAI|UTI|AGE|WI|BSI|CoNS)\b") >= 3) & (F.regexp_count(c, F.lit(r"\d+(?:\.\d+)?\s*\(\d+(?:\.\d+)?\)")) >= 2)
    dangling = finds(t, r"\b(?:and|or|of|for|to|with|using|as|in|by|from|through|a|an|the)$|\b(?:i\.e|e\.g)$|\(\[\d+\s*,\s*(?:thm|theorem|lemma|prop|proposition)$")
    return [
        ("table_fragment", c.contains("|") | c.contains("•") | dense),
        ("sentence_fragment", (t == "") | t.rlike(r"^(?:\(?\d+\)?|[:;,])") | t.rlike(r"^\p{IsLowercase}")),
        ("hyphenation_break", finds(c, r"\b[A-Za-z]{3,}-\s+[A-Za-z]{2,}\b", case=True)),
        ("column_stitching", finds(c, "|".join(STITCHED)) | finds(c, "|".join(STITCHED_AS_WRITTEN), case=True)),
        ("symbol_loss", c.contains("�") | finds(c, r"(?<![A-Za-zβ])[-–−]\s*lactam(?:ase)?\b")),
        ("embedded_heading", loud | several | late),
        ("column_stitching", finds(c, rf"\b[a-z][a-z]+\s+(?:{'|'.join(STARTERS)})\b", case=True)),
        ("sentence_fragment", dangling),
        ("formula_fragment", formula),
        ("ocr_spacing", (spaced >= 2) | ((spaced >= 1) & (F.regexp_count(c, F.lit(r"[~=()\[\]{}]")) >= 8))),
        ("table_fragment", finds(c, r"^(?:table|figure)\s+\d+.*$")),
    ]


def quality_flags(c: Column) -> Column:
    """The flags of a sentence, each once, in order; an empty array means clean."""
    front = "|".join(FRONT_MATTER)
    rules = [("short_fragment", (F.length(c) < 20) | (word_count(c) <= 4)), ("instruction_injection", finds(c, "|".join(INJECTION))), ("front_matter", finds(c, front)), *layout_flags(c)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules])))


def evidence_type(c: Column, types: dict[str, str] | None = None) -> Column:
    kinds = types or TYPES
    return F.coalesce(*[F.when(finds(c, pattern), F.lit(name)) for name, pattern in kinds.items()])


def supported(section: Column, kind: Column) -> Column:
    """Whether evidence of a type may stand in a section."""
    table = F.create_map(*[x for k, v in SUPPORTS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(F.array_contains(F.try_element_at(table, kind), section), F.lit(False))


def page_vulnerable(c: Column) -> Column:
    """Whether a sentence is too weak to trust on a badly parsed page."""
    n = word_count(F.trim(c))
    return (n <= 8) | ((n <= 14) & finds(F.trim(c), r"^(?:using|by|for|from|in|with|based on)\b")) | finds(F.trim(c), r"\b(?:and|or|of|for|with|using)\s+\d{2,4}$")


def document_vulnerable(c: Column) -> Column:
    strong = finds(c, ANCHORS) | (finds(c, r"\b(?:minimum inhibitory|mic)\b") & finds(c, r"(?:[<>]=?\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*(?:ug|µg|μg|mg|mm|%))")) | (finds(c, r"\b(?:pubmed|embase|cochrane)\b") & finds(c, r"\b(?:search|databases?|studies)\b"))
    return page_vulnerable(c) | ~strong


def curate(pages: DataFrame, doc: str, types: dict[str, str] | None = None, least_confidence: float = 0.6, per_type: int = 8, most: int = 40, most_blocked: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted evidence, blocked evidence, and counts of blocked evidence by flag.

    Pages may have parse_confidence (default 1) and parse_flags. A document's accepted rows are the first ``per_type`` of a type
    and ``most`` in all, by page and place; past the page that fills ``most``, nothing is blocked or counted. The blocked rows
    listed are a document's first ``most_blocked``; the counts are of all. Rows have seq, their place on the page.
    """
    none = F.array().cast(STRINGS)
    p = pages.withColumn("_c", F.coalesce("parse_confidence", F.lit(1.0)) if "parse_confidence" in pages.columns else F.lit(1.0)).withColumn("_f", F.coalesce("parse_flags", none) if "parse_flags" in pages.columns else none)
    p = p.select(doc, "page_number", "_c", "_f", split_references(F.coalesce("text", F.lit(""))).alias("s"))
    rows = F.concat(
        F.transform(sectioned_sentences(F.col("s.body")), lambda x: F.struct(F.lit(False).alias("ref"), x["section"].alias("section"), x["sentence"].alias("sentence"))),
        F.transform(F.when(F.trim("s.tail") == "", none).otherwise(split_sentences(F.col("s.tail"))), lambda x: F.struct(F.lit(True).alias("ref"), F.lit("references").alias("section"), x.alias("sentence"))),
    )
    s = p.select(doc, "page_number", "_c", "_f", F.posexplode(rows).alias("seq", "r")).select(doc, "page_number", "_c", "_f", "seq", "r.ref", "r.section", sanitize(F.col("r.sentence")).alias("raw"))
    s = settled(settled(s, "raw", F.col("raw")), "evidence_type", evidence_type(F.col("raw"), types)).where("evidence_type is not null")
    s = settled(s, "own", F.when(F.col("ref"), F.array(F.lit("reference_section"))).otherwise(quality_flags(F.col("raw"))))
    clean, low = F.size("own") == 0, F.col("_c") < least_confidence
    s = settled(s, "text", F.when(clean | F.col("ref"), strip_heading(F.col("raw"))).otherwise(F.col("raw"))).where(~clean | ((F.col("text") != "") & supported(F.col("section"), F.col("evidence_type"))))
    paged = F.when(low & ~F.col("ref"), F.array(F.lit("low_page_parse_confidence"))).otherwise(none)
    s = s.withColumns({"quality_flags": F.array_distinct(F.concat("own", paged)), "quality_score": F.when(~clean, 0.2).otherwise(F.when(low, F.col("_c")).otherwise(1.0)), "parse_confidence": F.when(F.col("ref"), 1.0).otherwise(F.col("_c")), "parse_flags": F.when(F.col("ref"), none).otherwise(F.col("_f"))})
    page = W.partitionBy(doc, "page_number")
    bad = F.count_if(~F.col("ref") & (F.size("quality_flags") > 0)).over(page)
    s = s.withColumn("poor", (bad >= 2) & (bad >= 0.5 * F.count_if(~F.col("ref")).over(page)))
    weak = F.col("poor") & (F.size("quality_flags") == 0) & page_vulnerable(F.col("text"))
    s = s.withColumn("late", F.when(F.col("ref"), 2).when(weak, 1).otherwise(0)).withColumn("quality_flags", F.when(F.col("late") == 1, F.array(F.lit("page_parse_quality"))).otherwise(F.col("quality_flags"))).withColumn("quality_score", F.when(F.col("late") == 1, F.least("quality_score", F.lit(0.4))).otherwise(F.col("quality_score")))
    s = s.withColumn("ok", F.size("quality_flags") == 0)
    order = W.partitionBy(doc, "ok", "evidence_type").orderBy("page_number", "seq")
    s = s.withColumn("k", F.row_number().over(order)).withColumn("fits", F.col("ok") & (F.col("k") <= per_type))
    s = s.withColumn("place", F.row_number().over(W.partitionBy(doc, "fits").orderBy("page_number", "seq")))
    end = F.max(F.when(F.col("fits") & (F.col("place") == most), F.col("page_number"))).over(W.partitionBy(doc))
    s = s.withColumn("end", end)
    out = [doc, "page_number", "seq", "evidence_type", "text", F.when(F.col("ok"), "clean").otherwise("blocked").alias("quality_label"), "quality_score", "quality_flags", "parse_confidence", "parse_flags"]
    accepted = s.where(F.col("fits") & (F.col("place") <= most)).select(*out, "place")
    blocked = s.where(~F.col("ok") & (F.col("end").isNull() | (F.col("page_number") <= F.col("end"))))
    first = blocked.select(*out, F.row_number().over(W.partitionBy(doc).orderBy("page_number", "late", "seq")).alias("place")).where(F.col("place") <= most_blocked)
    counts = blocked.select(doc, F.explode("quality_flags").alias("flag")).groupBy(doc, "flag").agg(F.count("*").alias("n"))
    return accepted, first, counts


def document_gate(accepted: DataFrame, blocked: DataFrame, doc: str, least: int = 20, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Accepted and blocked after the gate: of documents with many blocked rows (references aside), accepted rows without a strong anchor are blocked too."""
    both = accepted.withColumn("_in", F.lit(True)).unionByName(blocked.withColumn("_in", F.lit(False)))
    counts = F.col("_in") | ~F.array_contains("quality_flags", "reference_section")
    own, per = F.count_if(counts & ~F.col("_in")).over(W.partitionBy(doc)), F.count_if(counts).over(W.partitionBy(doc))
    both = both.withColumn("_gated", F.col(doc).isNotNull() & (own >= least) & (own >= share * per)).withColumn("_out", F.col("_in") & F.col("_gated") & document_vulnerable(F.col("text")))
    kept, rest = both.where(F.col("_in") & ~F.col("_out")), both.where(~F.col("_in") | F.col("_out"))
    rest = rest.withColumns({"quality_label": F.when(F.col("_out"), "blocked").otherwise(F.col("quality_label")), "quality_score": F.when(F.col("_out"), F.least("quality_score", F.lit(0.4))).otherwise(F.col("quality_score")), "quality_flags": F.when(F.col("_out"), F.array_union("quality_flags", F.array(F.lit("document_parse_quality")))).otherwise(F.col("quality_flags"))})
    return kept.drop("_in", "_gated", "_out"), rest.drop("_in", "_gated", "_out")
