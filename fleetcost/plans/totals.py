"""Totals, confidence and notes of estimates: aggregations by request over the line items, merged before the shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import round_half_up
from fleetcost.plans.lines import CONFIRMED, CORE_ENGINES, INCLUDED, MONTHLY, ONE_TIME, PENDING, PLANNING, RANGE

NOTHING_PRICED = "Nothing that recurs has a price."
LOCKED = "Historical calibration was supplied but not used: this request is locked."


def _sum(condition: Column, value: str = "cost_usd") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def measures(of: Column | None = None) -> dict[str, Column]:
    """Sums over the lines (those for which `of` holds): only INCLUDED lines are added, PENDING lines are counted."""
    of = F.lit(True) if of is None else of
    inc, month, once, pend = (F.col("treatment") == INCLUDED) & of, F.col("recurrence") == MONTHLY, F.col("recurrence") == ONE_TIME, (F.col("treatment") == PENDING) & of
    dbu = inc & month & (F.col("unit") == "DBU")
    return {"recurring_monthly_usd": _sum(inc & month), "one_time_usd": _sum(inc & once), "dbu_monthly": _sum(dbu, "quantity"), "dbu_monthly_usd": _sum(dbu),
            "core_monthly_usd": _sum(inc & month & F.col("engine").isin(*CORE_ENGINES)), "pending_recurring_items": F.count_if(pend & month), "pending_one_time_items": F.count_if(pend & once)}


def derived(m) -> dict[str, Column]:
    """What follows from the measures; m(name) gives a measure."""
    monthly = m("recurring_monthly_usd")
    return {"annual_recurring_usd": monthly * 12, "first_year_usd": monthly * 12 + m("one_time_usd"), "cloud_monthly_usd": monthly - m("dbu_monthly_usd"),
            "status": F.when(m("pending_recurring_items") + m("pending_one_time_items") == 0, "COMPLETE").otherwise("PARTIAL_PENDING_INPUTS")}


def totals(lines: DataFrame, by: tuple[str, ...] = ("request_id", "scenario")) -> DataFrame:
    """Measures per scenario and what follows from them."""
    return lines.groupBy(*by).agg(*[c.alias(n) for n, c in measures().items()]).withColumns(derived(F.col))


def reference_scenario(scenarios: Column) -> Column:
    return F.when(F.array_contains(scenarios, "EXPECTED"), "EXPECTED").otherwise(F.get(scenarios, 0))


def shares(of: Column | None = None) -> dict[str, Column]:
    """Monthly sums over the reference scenario's lines (those for which `of` holds), by what they rest on. `lines` carries `scenarios`."""
    of = (F.lit(True) if of is None else of) & (F.col("scenario") == reference_scenario(F.col("scenarios"))) & (F.col("recurrence") == MONTHLY)
    inc = of & (F.col("treatment") == INCLUDED)
    return {"total": _sum(inc), "planning": _sum(inc & (F.col("evidence") == PLANNING)), "ranged": _sum(inc & (F.col("evidence") == RANGE)), "pending": F.count_if(of & (F.col("treatment") == PENDING)),
            "lines": F.count_if(of)}


def rated(s, reference: Column) -> dict[str, Column]:
    """The rating out of the shares; s(name) gives a share."""
    total = F.nullif(s("total"), F.lit(0.0))
    p, r = s("planning") / total, s("ranged") / total
    rating = (F.when(total.isNull() | (p >= 0.5), "LOW").when(p + r >= 0.5, "MEDIUM").when(s("pending") > 0, "MEDIUM").otherwise("HIGH"))

    def percent(x: Column) -> Column:
        return F.concat(round_half_up(x * 100, 0).cast("int").cast("string"), F.lit("%"))
    reason = F.when(total.isNull(), NOTHING_PRICED).otherwise(
        F.concat(percent(p), F.lit(" of "), reference, F.lit(" monthly cost rests on planning assumptions, "), percent(r), F.lit(" on supplied ranges.")))
    return {"rating": rating, "planning_assumption_share": round_half_up(p, 4), "range_derived_share": round_half_up(r, 4), "reason": reason}


def confidence(lines: DataFrame) -> DataFrame:
    """Share of the reference scenario's monthly cost that rests on planning values or ranges, and the rating. `lines` carries `scenarios`."""
    g = lines.groupBy("request_id").agg(*[c.alias(n) for n, c in shares().items()], F.any_value(reference_scenario(F.col("scenarios"))).alias("reference_scenario")).where("lines > 0")
    out = rated(F.col, F.col("reference_scenario"))
    return g.select("request_id", out["rating"].alias("rating"), "reference_scenario", *[c.alias(n) for n, c in out.items() if n != "rating"])


def note_list(calibration_supplied: bool = False) -> Column:
    """Of a line: its notes (kind, text): why it is PENDING, its WARNINGs and its ASSUMPTION. `lines` carries `scenarios` and `calibration_allowed`."""
    inc, ref = F.col("treatment") == INCLUDED, F.col("scenario") == reference_scenario(F.col("scenarios"))

    def note(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pend = F.when(F.col("treatment") == PENDING, F.transform("warnings", lambda w: note("PENDING", F.concat(F.col("component_id"), F.lit(": "), w))))
    warn = F.when(inc & ref, F.transform("warnings", lambda w: note("WARNING", w)))
    used = F.when(inc & ref & (F.col("evidence") != CONFIRMED), F.array(note("ASSUMPTION", F.concat("component_id", F.lit(" ["), "evidence", F.lit("]: "), "basis"))))
    lock = F.when(F.lit(calibration_supplied) & ~F.col("calibration_allowed"), F.array(note("WARNING", F.lit(LOCKED))))
    return F.concat(*[F.coalesce(x, F.array().cast("array<struct<kind:string,text:string>>")) for x in (pend, warn, used, lock)])


def notes(lines: DataFrame, calibration_supplied: bool = False) -> DataFrame:
    """Distinct rows (request_id, kind, text) of all notes."""
    return lines.select("request_id", F.explode(note_list(calibration_supplied)).alias("n")).select("request_id", "n.kind", "n.text").distinct()


def cost_slice(lines: DataFrame, scenario: str, engines: tuple[str, ...] | None = None, component_ids: tuple[str, ...] | None = None, recurrence: str = MONTHLY) -> DataFrame:
    """Included cost per request of a slice of one scenario; 0 where nothing matches."""
    m = (F.col("scenario") == scenario) & (F.col("treatment") == INCLUDED) & (F.col("recurrence") == recurrence)
    if engines is not None:
        m = m & F.col("engine").isin(*engines)
    if component_ids is not None:
        m = m & F.col("component_id").isin(*component_ids)
    return lines.groupBy("request_id").agg(_sum(m).alias("cost_usd"))
