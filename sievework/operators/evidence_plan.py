"""Evidence plans of report sections: rows by rule, a planner's rows reconciled with them, and what a section takes from either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import json_text, none, role

#: Roles and actions of a row; the tables and evidence types that a section takes (an open one takes all).
PLAN_ROLES = ("claim", "method", "result", "limitation", "dataset_population", "method_detail", "formula_detail", "front_matter", "metadata_noise")
ACTIONS = ("include", "appendix", "exclude")
SECTION_TABLES = {"background": ("claims", "methods", "results", "populations"), "methods": ("methods",), "results": ("results",), "limitations": ("limitations",), "all": ()}
SECTION_TYPES = {"background": ("claim", "method", "result", "dataset_population"), "methods": ("method",), "results": ("result",), "limitations": ("limitation",), "all": ()}


def _taken(section: Column, table: dict[str, tuple[str, ...]], value: Column) -> Column:
    own = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    asked = F.coalesce(F.try_element_at(own, section), none())
    return (F.size(asked) == 0) | F.array_contains(asked, value)


def planned_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The trusted rows that a section may use, with role, action and reason.

    rows: keys, section, ordinal, row_id, table, citation, text, evidence_type, trust_label. A row is placed by its table, or
    by its type if it has none; a missing trust counts as trusted. Without an id it is named E<ordinal>.
    """
    table = F.coalesce("table", F.lit(""))
    kind = F.coalesce("evidence_type", F.lit(""))
    here = F.when(table != "", _taken(F.col("section"), SECTION_TABLES, table)).otherwise(_taken(F.col("section"), SECTION_TYPES, kind))
    trusted = F.coalesce(F.nullif("trust_label", F.lit("")), F.lit("trusted")) == "trusted"
    own = rows.where(here & trusted & (F.trim(F.coalesce("citation", F.lit(""))) != "") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    named = F.coalesce(F.nullif("row_id", F.lit("")), F.concat(F.lit("E"), F.col("ordinal").cast("string")))
    r = role(F.coalesce(F.nullif(F.col("evidence_type"), F.lit("")), F.lit("claim")), F.col("text"))
    return own.select(*keys, "section", "ordinal", named.alias("row_id"), "citation", "text", F.coalesce(F.nullif("evidence_type", F.lit("")), F.lit("claim")).alias("evidence_type"), r.alias("r")).select("*", "r.role", "r.action", "r.reason").drop("r")


def planner_rows(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, place, row_id, citation, role, action, reason of planners' answers (keys, section, success, answer)."""
    item = "array<struct<row_id:string,citation:string,role:string,action:string,reason:string>>"
    parsed = F.from_json(json_text(F.col("answer")), f"struct<rows:{item}>", {"mode": "PERMISSIVE"})["rows"]
    out = answers.where("success").select(*keys, "section", F.posexplode(F.coalesce(parsed, F.array().cast(item))).alias("place", "r")).where("r IS NOT NULL")
    text = lambda f: F.trim(F.coalesce(f"r.{f}", F.lit(""))).alias(f)
    return out.select(*keys, "section", "place", *[text(f) for f in ("row_id", "citation", "role", "action", "reason")])


def reconciled(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """A section's rows after its planner: keys, section, place, row_id, citation, text, evidence_type, role, action, reason, planner_status.

    ours: ``planned_rows``; theirs: ``planner_rows``. A planner's row counts if ours has its id and citation, the last of
    ours with them; of several that count for one, the first. Its role and action hold if they are known ones, its
    reason if there is one. A section none of whose planner's rows count keeps ours (``fallback``).
    """
    name = [*keys, "section", "row_id", "citation"]
    rest = [c for c in ours.columns if c not in name]
    base = ours.groupBy(*name).agg(F.max_by(F.struct(*rest), "ordinal").alias("b"))
    first = theirs.groupBy(*name).agg(F.min(F.struct("place", "role", "action", "reason")).alias("p"))
    met = first.join(base, name)
    choose = lambda f, known: F.when(F.col(f"p.{f}").isin(*known), F.col(f"p.{f}")).otherwise(F.col(f"b.{f}")).alias(f)
    valid = met.select(*name, F.col("p.place").alias("place"), "b.text", "b.evidence_type", choose("role", PLAN_ROLES), choose("action", ACTIONS), F.coalesce(F.nullif("p.reason", F.lit("")), "b.reason").alias("reason"), F.lit("pass").alias("planner_status"))
    done = valid.select(*keys, "section").distinct()
    kept = ours.join(done, [*keys, "section"], "left_anti").select(*name, F.col("ordinal").alias("place"), "text", "evidence_type", "role", "action", "reason", F.lit("fallback").alias("planner_status"))
    return valid.unionByName(kept)


def section_plans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, planner_status, and for each action the distinct citations and row ids in order of their first place.

    Two steps of aggregation: first places of each citation and id, then lists; a section's lists are one report's.
    """
    each = rows.select(*keys, "section", "planner_status", "action", F.explode(F.array(F.struct(F.lit("citations").alias("list"), F.struct("place", F.col("citation").alias("v")).alias("e")), F.struct(F.lit("row_ids").alias("list"), F.struct("place", F.col("row_id").alias("v")).alias("e")))).alias("x"))
    group = [*keys, "section", "planner_status"]
    first = each.groupBy(*group, "action", "x.list", F.col("x.e.v").alias("v")).agg(F.min("x.e.place").alias("place"))
    pick = lambda a, n: F.transform(F.array_sort(F.collect_list(F.when((F.col("action") == a) & (F.col("list") == n), F.struct("place", "v")))), lambda s: s["v"]).alias(f"{a}_{n}")
    return first.groupBy(*group).agg(*[pick(a, n) for a in ACTIONS for n in ("citations", "row_ids")])
