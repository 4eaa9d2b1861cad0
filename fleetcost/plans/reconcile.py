"""Reconciliation of results: presented figures, input drift against a template, substitution totals, parity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import round_half_up
from fleetcost.plans.requests import LIST_SECTIONS, SECTIONS
from fleetcost.sources import sinks

TOLERANCE = 0.01
PARITY = 0.005 + 1e-9


def compare_figures(presented: DataFrame, calculated: DataFrame, keys: list[str]) -> DataFrame:
    """Presented against calculated value per key; NULL means pending on either side."""
    d = presented.join(calculated, keys, "full")
    p, c = F.col("presented"), F.col("calculated")
    both, neither = p.isNotNull() & c.isNotNull(), p.isNull() & c.isNull()
    ok = neither | (both & (F.abs(c - p) < TOLERANCE))
    gap = F.concat(F.when(c < p, "-").otherwise(""), F.lit("$"), F.format_number(round_half_up(F.abs(c - p), 2), 2))
    status = (F.when(neither, "MATCH (pending)").when(both & ok, "MATCH").when(both, F.concat(F.lit("DIFFERS BY "), gap)).otherwise("DIFFERS"))
    return d.select(*keys, "presented", "calculated", F.coalesce(ok, F.lit(False)).alias("ok"), status.alias("status"))


def verdict(figures: DataFrame, keys: list[str]) -> DataFrame:
    return figures.groupBy(*keys).agg(F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("differences"))


_DESCRIPTIVE = ("evidence", "name", "description")


def input_map() -> Column:
    """Inputs of a request row as a map from path to text, without comments and descriptive fields. One map per request."""
    def fields(name: str, s: Column, prefix: Column) -> Column:
        return F.filter(F.array(*[F.struct(F.concat(prefix, F.lit(f".{f}")).alias("k"), (F.to_json(s[f]) if t.startswith("map") else s[f].cast("string")).alias("v"))
                                  for f, t in SECTIONS[name] if f not in _DESCRIPTIVE]), lambda e: e["v"].isNotNull())

    def entries(name: str) -> Column:
        if name in LIST_SECTIONS:
            return F.flatten(F.transform(name, lambda x: fields(name, x, F.concat(F.lit(f"{name}["), x["component_id"], F.lit("]")))))
        return F.when(F.col(name).isNotNull(), fields(name, F.col(name), F.lit(name))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    top = F.array(F.struct(F.lit("region").alias("k"), F.col("region").alias("v")), F.struct(F.lit("scenarios").alias("k"), F.array_join("scenarios", ",").alias("v")),
                  F.struct(F.lit("model_days_per_month").alias("k"), F.col("model_days_per_month").cast("string").alias("v")))
    return F.map_from_entries(F.concat(top, *[entries(n) for n in SECTIONS]))


def drift(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Rows (request_id, path, template_value, request_value) that differ, null-safe. The template's map comes by its key, so nothing is put in long form but the differences.

    The map of a template is worked out once and written; the two maps of a request are merged in one pass over their paths.
    """
    mine = requests.select("request_id", "template", input_map().alias("mine"))
    base = sinks.overwrite(templates.select("template", input_map().alias("base")), sinks.shared_folder(templates.sparkSession))
    pairs = F.map_zip_with("mine", "base", lambda _, m, b: F.struct(b.alias("template_value"), m.alias("request_value")))
    differ = F.map_filter(pairs, lambda _, p: ~p["template_value"].eqNullSafe(p["request_value"]))
    # outer: a plain explode would copy both maps into a filter on their size
    d = mine.join(base, "template").select("request_id", "template", F.explode_outer(differ).alias("path", "pair")).where("path IS NOT NULL")
    return d.select("request_id", "template", "path", "pair.template_value", "pair.request_value")


def substitute(totals: DataFrame, component_costs: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Total minus component plus alternative, per request, component, model and scenario."""
    alt = alternatives.select("request_id", "component_id", "model", F.explode(F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.col(f"{s.lower()}_usd").alias("swap")) for s in ("LOW", "EXPECTED", "HIGH")])).alias("x")).select("request_id", "component_id", "model", "x.*")
    d = alt.join(totals.select("request_id", "scenario", "recurring_monthly_usd"), ["request_id", "scenario"])
    d = d.join(component_costs, ["request_id", "scenario", "component_id"], "left")
    return d.withColumn("substituted_usd", F.col("recurring_monthly_usd") - F.coalesce("component_usd", F.lit(0.0)) + F.col("swap"))


def parity(expected: DataFrame, figures: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """True per `by` when every expected figure is met within half a cent (unrounded comparison)."""
    d = expected.join(figures, keys, "left")
    near = F.coalesce(F.abs(F.col("figure") - F.col("expected")) < PARITY, F.lit(False))
    return d.groupBy(*by).agg(F.bool_and(near).alias("parity"), F.count("*").alias("figures"))
