"""The source gate: an ordered rule chain over URLs and identifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourcePolicy:
    """Hosts match exactly, with their port. The defaults are fixed values."""

    allowed: tuple[str, ...] = (
        "arxiv.org", "export.arxiv.org", "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "doi.org", "dx.doi.org", "crossref.org", "api.crossref.org", "openalex.org", "api.openalex.org",
        "semanticscholar.org", "api.semanticscholar.org", "nature.com", "www.nature.com", "springer.com", "link.springer.com", "sciencedirect.com", "www.sciencedirect.com", "ieee.org", "ieeexplore.ieee.org",
        "acm.org", "dl.acm.org", "plos.org", "journals.plos.org", "cell.com", "www.cell.com", "science.org", "www.science.org", "academic.oup.com", "cambridge.org", "www.cambridge.org", "bmj.com", "www.bmj.com",
        "jamanetwork.com", "www.jamanetwork.com", "nejm.org", "www.nejm.org", "asm.org", "journals.asm.org", "frontiersin.org", "www.frontiersin.org", "clinicalmicrobiologyandinfection.com",
        "www.clinicalmicrobiologyandinfection.com", "mdpi.com", "www.mdpi.com", "journals.sagepub.com", "ftp.ncbi.nlm.nih.gov",
    )
    blocked: tuple[str, ...] = ("github.com", "gist.github.com", "gitlab.com", "bitbucket.org", "drive.google.com", "docs.google.com", "dropbox.com", "www.dropbox.com")
    suffixes: tuple[str, ...] = (".zip", ".tar", ".tar.gz", ".tgz", ".rar", ".7z", ".dmg", ".exe", ".bin", ".sh", ".py", ".ipynb", ".js")
    prefixes: tuple[str, ...] = ("/e-print/",)


DOI = r"(?i)^(?:doi:)?(10\.\d{4,9}/\S+)$"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def gate(source: Column, policy: SourcePolicy = SourcePolicy()) -> Column:
    """struct(normalized, kind, allowed, reason, domain) of a source."""
    s = F.trim(F.coalesce(source, F.lit("")))
    doi = F.regexp_extract(s, DOI, 1)
    scheme, host = F.lower(F.regexp_extract(s, URL, 1)), F.lower(F.regexp_extract(s, URL, 2))
    path, query = F.regexp_extract(s, URL, 3), F.regexp_extract(s, URL, 4)
    bare = F.concat(F.regexp_replace(path, ";[^/]*$", ""), F.when(query == "?", "").otherwise(query))
    ends = "(" + "|".join(x.replace(".", r"\.") for x in policy.suffixes) + ")$"
    artifact = F.lower(path).rlike(ends) if policy.suffixes else F.lit(False)
    for p in policy.prefixes:
        artifact = artifact | F.lower(path).startswith(p)
    url = scheme.isin("http", "https", "ftp") & (host != "")
    reason = F.when(doi != "", "allowed_doi").when(~url, "unsupported_identifier").when(host.isin(*policy.blocked), "blocked_domain").when(artifact, "blocked_extension_or_artifact").when(~host.isin(*policy.allowed), "domain_not_allowlisted").otherwise("allowed_domain")
    kind = F.when(doi != "", "doi").when(url, "url").otherwise("unknown")
    normalized = F.when(doi != "", F.lower(doi)).when(url, F.concat(scheme, F.lit("://"), host, bare)).otherwise(s)
    return F.struct(normalized.alias("normalized"), kind.alias("kind"), reason.startswith("allowed").alias("allowed"), reason.alias("reason"), F.when((doi == "") & url, host).alias("domain"))
