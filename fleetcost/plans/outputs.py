"""Result tables of estimates. Totals and summaries are one grouping of the line items; the details read them several times, so their caller writes them once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import fmt_number, round_half_up
from fleetcost.plans import compute
from fleetcost.plans import lines as ln
from fleetcost.plans import totals as tt
from fleetcost.plans.requests import SCENARIOS, area_states, parse
from fleetcost.sources import sinks

# The version of the result tables, and how a stress figure is labelled.
VERSION = "1.0"
STRESS_LABEL = "STRESS (operating sensitivity, not a forecast)"
DISCLAIMER = "A figure for planning: it is neither a bill nor a promise of what will be spent."


def money(c: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(round_half_up(c, 2), 2))


def rate_source(rate_card: DataFrame) -> DataFrame:
    """One value: the sources of the platform DBU rates."""
    used = rate_card.where("provider = 'PLATFORM' AND unit = 'DBU' AND rate IS NOT NULL")
    return used.agg(F.array_join(F.array_sort(F.collect_set("source")), ", "))


def request_head(requests: DataFrame, named: Column) -> DataFrame:
    """Parsed requests with the texts that result tables repeat: `area_states`."""
    return requests.withColumn("area_states", F.array_join(F.transform(area_states(named), lambda a: F.concat(a["area"], F.lit(": "), a["state"])), "; "))


def gathered(lines: DataFrame, head: tuple[str, ...] = ()) -> DataFrame:
    """One row per request out of one grouping of its lines: `t` (scenario, measures and what follows from them, for each scenario with lines, in order), rating, reason,
    and its pending, warning and assumption texts, each sorted and joined. `lines` carries scenarios, calibration_allowed and the columns of `head`.

    Sums, counts and sets of texts merge before the shuffle, so a request costs one small row per task that has lines of it.
    """
    line = F.col("component_id").isNotNull()
    names = list(tt.measures())
    sums = {f"{s}_{n}": c for s in SCENARIOS for n, c in tt.measures(line & (F.col("scenario") == s)).items()}
    counts = {f"{s}_lines": F.count_if(line & (F.col("scenario") == s)) for s in SCENARIOS}
    rests = {f"r_{n}": c for n, c in tt.shares(line).items()}
    g = lines.groupBy("request_id").agg(
        *[c.alias(n) for n, c in (sums | counts | rests).items()], *[F.any_value(c).alias(c) for c in head], F.any_value(tt.reference_scenario(F.col("scenarios"))).alias("ref"),
        F.array_distinct(F.flatten(F.collect_set(F.when(line, tt.note_list())))).alias("notes"))

    def scenario(s: str) -> Column:
        m = lambda n: F.col(f"{s}_{n}")
        return F.when(F.col(f"{s}_lines") > 0, F.struct(F.lit(s).alias("scenario"), *[m(n).alias(n) for n in names], *[c.alias(n) for n, c in tt.derived(m).items()]))

    def texts(kind: str) -> Column:
        return F.array_join(F.array_sort(F.transform(F.filter("notes", lambda n: n["kind"] == kind), lambda n: n["text"])), "; ").alias(kind.lower())
    out = tt.rated(lambda n: F.col(f"r_{n}"), F.col("ref"))
    known = F.col("r_lines") > 0
    return g.select("request_id", *head, "ref", F.array_compact(F.array(*map(scenario, SCENARIOS))).alias("t"), F.when(known, out["rating"]).otherwise("LOW").alias("rating"),
                    F.when(known, out["reason"]).otherwise(tt.NOTHING_PRICED).alias("reason"), *[texts(k) for k in ("PENDING", "WARNING", "ASSUMPTION")])


HEAD = ("use_case_id", "use_case_name", "area_states", "request_status", "errors")


def totals_table(lines: DataFrame, rate_card: DataFrame) -> DataFrame:
    """Totals by scenario with pending details, area states and confidence; a request that is not priced (NEEDS_INPUT or REJECTED) has one row without
    scenario and figures, with its status and errors. `lines` carries scenarios, calibration_allowed and the columns of HEAD."""
    refused = F.col("request_status") != "OK"
    g = gathered(lines, HEAD)
    rows = F.when(refused, F.array(F.get("t", -1))).otherwise(F.col("t"))
    # explode_outer, as a plain explode copies the array expression into a filter
    d = g.select("*", F.explode_outer(rows).alias("x")).where(refused | F.col("x").isNotNull())
    priced = lambda c: F.when(~refused, c)
    x = lambda n: F.col(f"x.{n}")
    two = [round_half_up(x(c), 2).alias(n) for n, c in (
        ("recurring_monthly_usd", "recurring_monthly_usd"), ("core_monthly_usd", "core_monthly_usd"), ("annual_usd", "annual_recurring_usd"), ("one_time_usd", "one_time_usd"),
        ("first_year_usd", "first_year_usd"), ("dbu", "dbu_monthly"), ("dbu_usd", "dbu_monthly_usd"), ("cloud_usd", "cloud_monthly_usd"))]
    return d.select(
        "request_id", "use_case_id", priced(F.col("use_case_name")).alias("use_case_name"), x("scenario").alias("scenario"), F.when(x("scenario") == "STRESS", STRESS_LABEL).otherwise(x("scenario")).alias("scenario_label"), *two,
        (x("pending_recurring_items") + x("pending_one_time_items")).alias("pending_items"), priced(F.col("pending")).alias("pending_detail"), x("status").alias("status"), priced(F.col("area_states")).alias("area_states"),
        priced(F.col("rating")).alias("confidence"), priced(F.col("reason")).alias("confidence_reason"), "request_status", "errors", F.lit(VERSION).alias("calculator_version"),
        priced(rate_source(rate_card).scalar()).alias("rate_card_source"), F.lit(DISCLAIMER).alias("disclaimer"))


# ---- documents to results: one set of requests is checked, then priced or refused -------------------------------------------------------------
def settled(judged: DataFrame) -> DataFrame:
    """Judged documents (validate.judged) with what pricing needs of them, written once: request_id, named, texts, errors, request_status (OK, NEEDS_INPUT or REJECTED), the
    document as its overrides have changed it where it is to be priced, and the id that was asked for. It is the one cut between the check's plan and the calculator's."""
    ready = F.col("status") == "READY"
    d = judged.select("request_id", "named", "texts", "errors", F.when(ready, "OK").otherwise(F.col("status")).alias("request_status"),
                      F.when(ready, F.to_json("v")).alias("request_json"), F.coalesce(F.try_variant_get("v", "$.use_case_id", "string"), F.lit("ADHOC")).alias("asked_id"))
    return sinks.overwrite(d, sinks.shared_folder(d.sparkSession))


def settled_requests(documents: DataFrame) -> DataFrame:
    """Settled documents as requests. One that is refused has no sections, so no lines, but keeps its use_case_id."""
    return parse(documents).withColumn("use_case_id", F.coalesce("use_case_id", "asked_id")).drop("asked_id", "request_json")


def estimate_documents(documents: DataFrame, rate_card: DataFrame, conversions: DataFrame, as_of: str) -> DataFrame:
    """Line items of settled documents, with all that totals_table() needs; a refused document keeps rows without a component. Nothing is shuffled."""
    r = request_head(settled_requests(documents), F.coalesce("named", F.lit(False)))
    return ln.line_items(r, rate_card, conversions, as_of, carry=(*HEAD, "scenarios", "calibration_allowed"), keep=True, filled=True)


def refused_details(requests: DataFrame) -> DataFrame:
    """Sections ERROR and DISCLAIMER of requests (request_id, request_status, texts) that are not priced: a row per error."""
    none = F.lit(None).cast("string")

    def row(section: str, detail: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), none.alias("component_id"), none.alias("item"), detail.alias("detail"))
    rows = F.concat(F.transform("texts", lambda e: row("ERROR", e)), F.array(row("DISCLAIMER", F.lit(DISCLAIMER))))
    return requests.where("request_status <> 'OK'").select("request_id", F.explode(rows).alias("x")).select("request_id", "x.*")


def line_items(lines: DataFrame, scenario: str | None = None) -> DataFrame:
    """The line items, of one scenario if one is named."""
    return lines if scenario is None else lines.where(F.col("scenario") == scenario.upper())


def rates_used(lines: DataFrame) -> DataFrame:
    """Distinct status, rate, unit and source per request."""
    text = F.concat("rate_status", F.lit(" $"), fmt_number("rate", 6), F.lit("/"), "unit", F.lit(" - "), "rate_source")
    return lines.where("rate IS NOT NULL").select("request_id", text.alias("rate_used")).distinct()


SUMMARY_HEAD = ("use_case_id", "use_case_name", "scope_included", "scope_excluded")


def summary(lines: DataFrame) -> DataFrame:
    """Plain-language summary per request, out of one grouping of its lines. `lines` carries scenarios, calibration_allowed and the columns of SUMMARY_HEAD."""
    d = gathered(lines, SUMMARY_HEAD).where(F.size("t") > 0)
    monthly = F.array_join(F.transform("t", lambda x: F.concat(x["scenario"], F.lit(" "), money(x["recurring_monthly_usd"]))), "; ")
    once = F.array_join(F.transform("t", lambda x: F.concat(x["scenario"], F.lit(" "), money(x["one_time_usd"]))), "; ")
    chosen = F.get(F.filter("t", lambda x: x["scenario"] == F.col("ref")), 0)
    has_once = F.exists("t", lambda x: (x["one_time_usd"] > 0) | (x["pending_one_time_items"] > 0))

    def block(title: str, c: str | Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title}: "), c))
    parts = F.array_compact(F.array(
        F.concat(F.lit("Use case: "), "use_case_id", F.lit(" | "), "use_case_name"), F.concat(F.lit("Monthly: "), monthly), F.when(has_once, F.concat(F.lit("One-time: "), once)),
        F.concat(F.lit("First year ("), "ref", F.lit("): "), money(chosen["first_year_usd"])), F.concat(F.lit("From year 2 on ("), "ref", F.lit("): "), money(chosen["annual_recurring_usd"])), F.concat(F.lit("Confidence: "), "rating", F.lit(" - "), "reason"),
        block("Pending", "pending"), block("Assumptions", "assumption"), block("Notes", "warning"),
        block("In scope", F.array_join("scope_included", "; ")), block("Out of scope", F.array_join("scope_excluded", "; ")), F.lit(DISCLAIMER)))
    return d.select("request_id", F.array_join(parts, "\n").alias("summary"))


def details(requests: DataFrame, lines: DataFrame, named: Column) -> DataFrame:
    """Explanations in one long form (request_id, section, component_id, item, detail) of parsed requests. Sections out of the request itself are one explode. `lines` is a written
    table that carries scenarios, calibration_allowed and the columns of SUMMARY_HEAD."""
    none = F.lit(None).cast("string")

    def row(section: str, component=none, item=none, detail=none) -> Column:
        return F.struct(F.lit(section).alias("section"), component.cast("string").alias("component_id"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))

    def texts(section: str, c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: row(section, detail=x))
    own = F.concat(texts("NOTE", "notes"), texts("SCOPE_INCLUDED", "scope_included"), texts("SCOPE_EXCLUDED", "scope_excluded"),
                   F.transform(area_states(named), lambda a: row("AREA", a["area"], a["state"])), F.array(row("DISCLAIMER", detail=F.lit(DISCLAIMER))))
    cols = ["request_id", "section", "component_id", "item", "detail"]
    a = requests.select("request_id", F.explode_outer(own).alias("x")).where("x IS NOT NULL").select("request_id", "x.*")
    n = tt.notes(lines)
    cid, _, rest = F.substring_index("text", ": ", 1), None, F.expr("substr(text, instr(text, ': ') + 2)")
    pending = F.col("kind") == "PENDING"
    b = n.select("request_id", F.col("kind").alias("section"), F.when(pending, cid).alias("component_id"), none.alias("item"), F.when(pending, rest).otherwise(F.col("text")).alias("detail"))
    text = F.concat(F.lit("alternative "), F.coalesce("alternative", F.lit("-")), F.lit("; confidence "), "confidence", F.lit("; status "), "status", F.lit("; streaming "), "streaming_decision",
                    F.lit("; eligible "), F.array_join("eligible", ", "))
    c = compute.decisions(requests).select("request_id", F.lit("COMPUTE_DECISION").alias("section"), "component_id", F.col("selected").alias("item"), text.alias("detail"))
    e = tt.confidence(lines).select("request_id", F.lit("CONFIDENCE").alias("section"), none.alias("component_id"), F.col("rating").alias("item"), F.col("reason").alias("detail"))
    f = rates_used(lines).select("request_id", F.lit("RATE").alias("section"), none.alias("component_id"), none.alias("item"), F.col("rate_used").alias("detail"))
    g = summary(lines).select("request_id", F.lit("SUMMARY").alias("section"), none.alias("component_id"), none.alias("item"), F.col("summary").alias("detail"))
    out = a.select(*cols)
    for x in (b, c, e, f, g):
        out = out.unionByName(x)
    return out


RESULT_DDL = "status string, totals array<struct<scenario: string, recurring_monthly_usd: double, one_time_usd: double, status: string>>"


def result_document(lines: DataFrame) -> DataFrame:
    """Result of a request as one JSON text (at most four scenarios)."""
    t = tt.totals(lines).withColumns({c: round_half_up(c, 2) for c in ("recurring_monthly_usd", "one_time_usd")})
    rows = F.array_sort(F.collect_list(F.struct("scenario", "recurring_monthly_usd", "one_time_usd", "status")))
    return t.groupBy("request_id").agg(F.to_json(F.struct(F.lit("OK").alias("status"), rows.alias("totals"))).alias("result"))


def parse_result(results: DataFrame) -> DataFrame:
    """JSON results back to one typed row per scenario; a result without totals keeps one empty row."""
    d = results.withColumn("r", F.from_json("result", RESULT_DDL))
    return d.select("request_id", F.col("r.status").alias("request_status"), F.explode_outer("r.totals").alias("t")).select("request_id", "request_status", "t.*")
