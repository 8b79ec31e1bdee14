"""Discovery over several providers: quotas and pages of each request as expressions, stopping rules over recorded pages.

A request asks its providers for each of its variants, page after page, until a page fails, is empty or is short. All of
a request's candidates are bounded by its limit and the last pages, so its windows are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .candidates import candidate_key

#: The providers in order, and the largest page.
PROVIDERS = ("openalex", "arxiv", "pubmed")
LARGEST_PAGE = 200


def provider_quota(limit: Column, index: Column, providers: int = len(PROVIDERS)) -> Column:
    """A provider's share of a limit: equal parts, the remainder to the first ones."""
    limit = F.greatest(limit, F.lit(0))
    return F.floor(limit / providers).cast("int") + (index < limit % providers).cast("int")


def variant_quota(quota: Column, variants: Column) -> Column:
    """What each variant asks of a provider: at least one, if the provider has any."""
    return F.when(quota <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(quota / F.greatest(variants, F.lit(1))))).cast("int")


def page_plan(total: Column, page_size: int) -> Column:
    """struct(offset, page_limit) of each page of ``total`` results."""
    size = max(1, min(page_size, LARGEST_PAGE))
    pages = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(pages, lambda o: F.struct(o.alias("offset"), F.least(F.lit(size), total - o).alias("page_limit")))


def page_requests(requests: DataFrame, key: str, page_size: int = LARGEST_PAGE, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """key, limit, provider_place, provider, variant_place, variant, offset, page_limit. requests: key, variants (in order), limit; null counts as none."""
    named = F.array(*[F.lit(p) for p in providers])
    rows = requests.select(key, F.coalesce("limit", F.lit(0)).cast("int").alias("limit"), F.coalesce("variants", F.array().cast("array<string>")).alias("variants"))
    rows = rows.select("*", F.posexplode(named).alias("provider_place", "provider"))
    quota = variant_quota(provider_quota(F.col("limit"), F.col("provider_place"), len(providers)), F.size("variants"))
    rows = rows.withColumn("quota", quota).select(key, "limit", "provider_place", "provider", "quota", F.posexplode("variants").alias("variant_place", "variant"))
    rows = rows.select("*", F.explode(page_plan(F.col("quota"), page_size)).alias("p"))
    return rows.select(key, "limit", "provider_place", "provider", "variant_place", "variant", "p.offset", "p.page_limit")


def pages_taken(asked: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The asked pages that count, with their candidates. pages: provider, variant, offset, failed, candidates (array), one row each.

    A page counts if those before it were all full, and it is there, has not failed and is not empty. A short one is the last.
    """
    met = asked.join(pages, ["provider", "variant", "offset"], "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    good = ~F.coalesce("failed", F.lit(True)) & (n > 0)
    before = W.partitionBy(key, "provider", "variant_place").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    open_ = F.coalesce(F.min((good & (n >= F.col("page_limit"))).cast("int")).over(before), F.lit(1)) == 1
    return met.withColumn("counts", good & open_).where("counts").drop("counts", "failed")


def discovered(asked: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """key, rank, provider, variant and the candidate's columns: each request's candidates in order, the first of equal ones, up to its limit.

    pages: as in ``pages_taken``; a candidate is a struct with doi, pmid, arxiv_id and source among its fields.
    """
    place = ["provider_place", "variant_place", "offset", "place"]
    rows = pages_taken(asked, pages, key).select(key, "limit", "provider", "variant", *place[:3], F.posexplode("candidates").alias("place", "c"))
    rows = rows.withColumn("identity", candidate_key(*[F.col(f"c.{f}") for f in ("doi", "pmid", "arxiv_id", "source")]))
    first = rows.withColumn("again", F.row_number().over(W.partitionBy(key, "identity").orderBy(*place))).where("again = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*place))).where(F.col("rank") <= F.col("limit"))
    return ranked.select(key, "rank", "provider", "variant", "c.*")
