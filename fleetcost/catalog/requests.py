"""Estimate requests (DCP)."""
from fleetcost.catalog import pricecard as _pc  # noqa: F401  (registers the quote subqueries)
from fleetcost.catalog.pricecard import RATES_AS_OF
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.oracle import requests as _oracle  # noqa: F401
from fleetcost.oracle.base import CTES, rn, rounded as r
from fleetcost.plans import compute, lines as ln, requests as rq, totals as tt

_LINE = "request_id, scenario, component_id, engine, description, unit, rate, rate_status, rate_source, recurrence, treatment, evidence, basis, formula, array_to_string(warnings, '; ') AS warnings, " + r("quantity cost_usd")


def requests(i):
    return rq.assemble(i("request_wide"))


def lines(i, carry=(), calibration=None):
    return ln.line_items(requests(i), i.ref.rate_card, i.ref.model_conversions, RATES_AS_OF, calibration, carry)


def shown(df, *more):
    """Lines with rounded numbers and joined warnings, without internal order."""
    return rounded(df.select("request_id", *ln.LINE_COLUMNS, *more).withColumn("warnings", F.array_join("warnings", "; ")), "quantity cost_usd")


def _lines_query(key: str, where: str):
    @query(key, f"SELECT {_LINE} FROM est_lines WHERE {where}")
    def run(i):
        return shown(lines(i).where(where))
    return run


_DEC = "request_id, component_id, selected, alternative, score, confidence, status, sku, eligible, streaming_decision"


def _decisions(i, streaming: bool):
    d = compute.decisions(rq.with_defaults(requests(i))).where((F.col("workload_type") == "CONTINUOUS_STREAMING") == F.lit(streaming))
    return d.withColumn("eligible", F.array_join("eligible", ",")).drop("workload_type")


@query("dcp_compute_streaming", f"SELECT {_DEC} FROM decided WHERE c_type = 'CONTINUOUS_STREAMING'")
def compute_streaming(i):
    return _decisions(i, True)


@query("dcp_compute_batch", f"SELECT {_DEC} FROM decided WHERE c_type <> 'CONTINUOUS_STREAMING'")
def compute_batch(i):
    return _decisions(i, False)


for _key, _where in {
        "dcp_processing_continuous": "engine = 'DATA_PROCESSING' AND basis NOT LIKE '%REQUIRED' AND formula LIKE '% h x %' AND formula NOT LIKE '% runs x %'",
        "dcp_processing_batch": "engine = 'DATA_PROCESSING' AND (basis = 'INPUT_REQUIRED' OR formula LIKE '% runs x %')",
        "dcp_processing_unpriced": "engine = 'DATA_PROCESSING' AND treatment = 'PENDING' AND formula LIKE '%is selected; cost inputs%'",
        "dcp_sql_reporting": "engine = 'SQL_REPORTING'", "dcp_transfer": "engine = 'DATA_TRANSFER'",
        "dcp_storage": "component_id IN ('S3-STORAGE', 'S3-WRITE-REQUESTS')", "dcp_reads": "component_id = 'S3-READ-REQUESTS'",
        "dcp_encryption": "component_id LIKE 'KMS-%'", "dcp_model_endpoints": "engine = 'MODEL_API' AND recurrence = 'RECURRING_MONTHLY'",
        "dcp_one_time_jobs": "engine = 'MODEL_API' AND recurrence = 'ONE_TIME'", "dcp_line_items": "true",
        "dcp_price_lines": "treatment IN ('INCLUDED', 'PENDING')"}.items():
    _lines_query(_key, _where)


@query("dcp_token_value", f"""SELECT request_id, scenario, component_id, {r('input_tokens output_tokens', 2)}, basis FROM est_draft WHERE engine = 'MODEL_API'""")
def token_value(i):
    d = ln.drafts(requests(i)).where("engine = 'MODEL_API'")
    return rounded(d.select("request_id", "scenario", "component_id", "input_tokens", "output_tokens", "basis"), "input_tokens output_tokens", 2)


@query("dcp_assumptions", f"SELECT request_id, a_batch AS batch_dbu_per_hour, a_band AS users_per_band, {rn('sum(a_hours)', 2)} AS active_hours, 730.0::DOUBLE AS hours_per_month FROM rs GROUP BY 1, 2, 3")
def assumptions(i):
    a = F.col("a")
    d = requests(i).withColumn("a", rq.resolved_assumptions(F.col("assumptions"))).select("request_id", "a", F.explode("scenarios").alias("scenario"))
    d = d.groupBy("request_id", a["batch_dbu_per_hour"].alias("batch_dbu_per_hour"), a["sql_users_per_capacity_band"].alias("users_per_band"),
                  a["continuous_hours_per_month"].alias("hours_per_month")).agg(F.sum(a["sql_active_hours_per_day"][F.col("scenario")]).alias("active_hours"))
    return rounded(d, "active_hours", 2)


TOTALS_SQL = ", ".join(f"{rn(a, 4)} AS {b}" for a, b in (
    ("monthly", "recurring_monthly_usd"), ("annual", "annual_recurring_usd"), ("one_time", "one_time_usd"), ("first_year", "first_year_usd"), ("dbu", "dbu_monthly"),
    ("dbu_usd", "dbu_monthly_usd"), ("cloud_usd", "cloud_monthly_usd"))) + ", pend_m AS pending_recurring_items, pend_o AS pending_one_time_items, status"
_MONEY = "recurring_monthly_usd annual_recurring_usd one_time_usd first_year_usd dbu_monthly dbu_monthly_usd cloud_monthly_usd"


def shown_totals(df):
    return rounded(df.select("request_id", "scenario", *_MONEY.split(), "pending_recurring_items", "pending_one_time_items", "status"), _MONEY, 4)


@query("dcp_totals", f"SELECT request_id, scenario, {TOTALS_SQL} FROM est_totals")
def totals(i):
    return shown_totals(tt.totals(lines(i)))


@query("dcp_core_monthly", f"SELECT request_id, scenario, {rn('core', 4)} AS core_monthly_usd FROM est_totals")
def core_monthly(i):
    return rounded(tt.totals(lines(i)).select("request_id", "scenario", "core_monthly_usd"), "core_monthly_usd", 4)


@query("dcp_confidence", "SELECT * FROM est_conf")
def confidence(i):
    return tt.confidence(lines(i, ("scenarios",)))


@query("dcp_notes", "SELECT request_id, kind, text FROM est_notes")
def notes(i):
    return tt.notes(lines(i, ("scenarios", "calibration_allowed")))


_MODELS = ["nano-chat", "pro-chat", "embed-large", "draft-chat", "half-chat"]


def _alt(sc: str, it: str, ot: str) -> str:
    return f"CASE WHEN e1_mode = 'PAY_PER_TOKEN' AND region = 'US_EAST_1' THEN (e1_calls * model_days * {it} / 1e6 * i + e1_calls * model_days * {ot} / 1e6 * o) * 0.08 END"


CTES["alternatives"] = f"""SELECT request_id, component_id, model, {_alt('LOW', 'e1_in_low', 'e1_out_low')} AS low_usd, {_alt('EXPECTED', 'coalesce(e1_in_expected, (e1_in_low + e1_in_high) / 2.0)', 'coalesce(e1_out_expected, (e1_out_low + e1_out_high) / 2.0)')} AS expected_usd,
 {_alt('HIGH', 'e1_in_high', 'e1_out_high')} AS high_usd FROM (SELECT *, e1_id AS component_id, unnest(['nano-chat', 'pro-chat', 'embed-large', 'draft-chat', 'half-chat']) AS model FROM request_wide WHERE e1)
 LEFT JOIN (SELECT m_model AS model, m_input AS i, m_output AS o FROM conversion_ref WHERE m_status IN ('GOVERNED', 'VALIDATED_OBSERVED')) USING (model)"""


def compare(i):
    return ln.compare_models(requests(i), _MODELS, i.ref.rate_card, i.ref.model_conversions, RATES_AS_OF)


@query("dcp_compare_models", f"SELECT request_id, component_id, model, {r('low_usd expected_usd high_usd', 4)}, CASE WHEN low_usd IS NOT NULL AND expected_usd IS NOT NULL AND high_usd IS NOT NULL THEN 'PRICED' ELSE 'PENDING' END AS status FROM alternatives")
def compare_models(i):
    return rounded(compare(i), "low_usd expected_usd high_usd", 4)


_HAS = {"processing": "p1 OR p2", "sql": "s1", "transfer": "t1", "storage": "st", "model_endpoints": "e1", "one_time_model_jobs": "j1"}
CTES["areas"] = " UNION ALL ".join(
    f"SELECT request_id, '{a}' AS area, CASE WHEN {has} THEN 'INCLUDED' ELSE coalesce({f'upper(area_{a})' if a in ('sql', 'transfer') else 'NULL'}, 'UNCONFIRMED') END AS state FROM request_wide" for a, has in _HAS.items())


@query("dcp_area_states", "SELECT request_id, area, state FROM areas")
def area_states(i):
    return requests(i).select("request_id", F.explode(rq.area_states(F.lit(False))).alias("x")).select("request_id", "x.*")


# ---- building, resolving and changing requests -------------------------------------------------------------------------
_ARGS = """SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'scheduled_batch' WHEN 1 THEN 'NULL' WHEN 2 THEN 'ML_TRAINING' ELSE NULL END AS workload_type,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 7 AS DOUBLE) ELSE NULL END AS runtime_hours_low, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 9 AS DOUBLE) ELSE NULL END AS runtime_hours_expected,
 CAST(o_custkey % 11 AS DOUBLE) AS runs_per_month, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey % 4 AS DOUBLE) / 2 ELSE NULL END AS dbu_per_hour,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey % 50 AS INT) ELSE NULL END AS concurrent_users, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 12 AS DOUBLE) ELSE NULL END AS daily_gb_expected,
 CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE 'us-east-1' END AS region, CASE WHEN o_orderkey % 8 = 0 THEN 'low, high' ELSE NULL END AS scenarios, CASE WHEN o_orderkey % 10 = 0 THEN 'Storage, sql' ELSE 'NONE' END AS excluded_areas
FROM {orders}"""
CTES["arguments"] = _ARGS.format(orders="orders")


def _arguments(i):
    from fleetcost.sources.inputs import read_table
    return i.spark.sql(_ARGS, orders=read_table(i.spark, i.sf_dir, "orders"))


@query("dcp_build_request", """SELECT request_id, CASE WHEN scenarios IS NULL THEN '["LOW","EXPECTED","HIGH"]' ELSE '["LOW","HIGH"]' END AS scenarios, CASE WHEN region <> 'n/a' THEN 'US_EAST_1' END AS region,
 CASE WHEN w THEN upper(workload_type) END AS workload_type, CASE WHEN w THEN CASE WHEN workload_type = 'ML_TRAINING' THEN 'Ml Training' ELSE 'Scheduled Batch' END END AS name,
 CASE WHEN w THEN coalesce(runtime_hours_low, runtime_hours_expected) END AS low, CASE WHEN w THEN coalesce(runtime_hours_expected, runtime_hours_low) END AS expected, CASE WHEN w THEN runtime_hours_expected END AS high,
 CASE WHEN w THEN dbu_per_hour END AS stress_dbu, concurrent_users, daily_gb_expected AS gb_high, CASE WHEN excluded_areas <> 'NONE' THEN 'EXCLUDED' END AS storage_area, false AS has_storage
 FROM (SELECT *, coalesce(upper(trim(workload_type)) NOT IN ('', 'NULL', 'NONE', 'N/A'), false) AS w FROM arguments)""")
def build_request(i):
    d = rq.build_request(_arguments(i))

    def at(path: str, kind: str = "string"):
        return F.get_json_object("request_json", path).cast(kind)
    return d.select(
        "request_id", at("$.scenarios").alias("scenarios"), at("$.region").alias("region"), at("$.processing[0].workload_type").alias("workload_type"), at("$.processing[0].name").alias("name"),
        at("$.processing[0].runtime_hours_low", "double").alias("low"), at("$.processing[0].runtime_hours_expected", "double").alias("expected"), at("$.processing[0].runtime_hours_high", "double").alias("high"),
        at("$.processing[0].dbu_per_hour.STRESS", "double").alias("stress_dbu"), at("$.sql.concurrent_users", "int").alias("concurrent_users"), at("$.transfer.daily_gb_high", "double").alias("gb_high"),
        at("$._areas.storage").alias("storage_area"), F.array_contains(F.json_object_keys("request_json"), "storage").alias("has_storage"))


_ASKED = """SELECT o_orderkey AS question_id, CASE o_orderkey % 6 WHEN 0 THEN 'uc-' || CAST(o_custkey AS STRING) WHEN 1 THEN ' Workload ' || CAST(o_custkey % 40 AS STRING) || ' OF ' || CAST(o_custkey AS STRING)
  WHEN 2 THEN 'UC-' WHEN 3 THEN 'workload 7 of 1' WHEN 4 THEN 'n/a' ELSE NULL END AS use_case,
 CASE WHEN o_orderkey % 6 = 5 THEN '{{"use_case_id": "X' || CAST(o_custkey AS STRING) || '"}}' WHEN o_orderkey % 6 = 4 AND o_orderkey % 5 = 0 THEN '{{"sql": null}}' ELSE NULL END AS request_json FROM {orders}"""
CTES["asked"] = _ASKED.format(orders="orders")
CTES["ask_key"] = "SELECT question_id, CASE WHEN upper(trim(use_case)) IN ('', 'NULL', 'NONE', 'N/A') THEN NULL ELSE upper(trim(use_case)) END AS q FROM asked WHERE request_json IS NULL"
CTES["use_names"] = "SELECT use_case_id, upper(trim(use_case_id)) AS n, upper(use_case_id) AS p FROM request_wide UNION ALL SELECT use_case_id, upper(trim(use_case_name)), upper(use_case_name) FROM request_wide"
CTES["ask_distinct"] = "SELECT DISTINCT q FROM ask_key WHERE q IS NOT NULL"
CTES["ask_exact"] = "SELECT q, count(DISTINCT use_case_id) AS n, min(use_case_id) AS id FROM ask_distinct JOIN use_names ON n = q GROUP BY 1"
CTES["ask_prefix"] = "SELECT q, count(DISTINCT use_case_id) AS n, min(use_case_id) AS id FROM ask_distinct JOIN use_names ON starts_with(p, q) WHERE q NOT IN (SELECT q FROM ask_exact) GROUP BY 1"


@query("dcp_resolve", """SELECT question_id, coalesce(json_extract_string(request_json, '$.use_case_id'), 'ADHOC') AS use_case_id, false AS named FROM asked WHERE request_json IS NOT NULL
 UNION ALL SELECT question_id, id, true FROM ask_key JOIN (SELECT * FROM ask_exact UNION ALL SELECT * FROM ask_prefix) USING (q) WHERE n = 1""")
def resolve(i):
    from fleetcost.sources.inputs import read_table
    asked = i.spark.sql(_ASKED, orders=read_table(i.spark, i.sf_dir, "orders"))
    return rq.resolve(asked, i("request_wide").select("use_case_id", "use_case_name"))


_OVERRIDES = [("transfer.daily_gb_high", 3, "CAST(c_custkey % 50 AS STRING)"), ("processing[C01].runs_per_month", 4, "'7.5'"), ("processing[ZZ].runs_per_month", 50, "'1'"),
              ("model_days_per_month", 6, "'15'"), ("region", 7, "'AP_SOUTH_1'"), ("assumptions.batch_dbu_per_hour", 5, "'2.5'"), ("_areas.sql", 8, "'EXCLUDED'"),
              ("storage.retained_tb", 9, "CAST(NULL AS STRING)"), ("sql.concurrent_users", 11, "'many'"), ("moon.phase", 13, "'1'"),
              ("processing[C01].dbu_per_hour", 14, """'{"HIGH": 9.5}'""")]


def _overrides(i):
    from fleetcost.sources.inputs import read_table
    given = ", ".join(f"CASE WHEN c_custkey % {m} = 0 THEN named_struct('path', '{p}', 'value', {v}) END" for p, m, v in _OVERRIDES)
    c = read_table(i.spark, i.sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), F.explode(F.expr(f"array({given})")).alias("x")).where("x IS NOT NULL").select("request_id", "x.*")


@query("dcp_overrides", """SELECT request_id, CASE WHEN request_id % 6 = 0 THEN 15 ELSE model_days END AS model_days_per_month, CASE WHEN request_id % 7 = 0 THEN 'AP_SOUTH_1' ELSE region END AS region,
 CASE WHEN request_id % 3 = 0 THEN CAST(request_id % 50 AS DOUBLE) WHEN t1 THEN t1_high END AS daily_gb_high, CASE WHEN NOT p1 THEN NULL WHEN request_id % 4 = 0 THEN 7.5 ELSE p1_runs END AS c01_runs,
 CASE WHEN NOT p1 THEN NULL WHEN request_id % 14 = 0 THEN 9.5 ELSE CASE WHEN p1_fix_expected IS NOT NULL THEN p1_fix_high END END AS c01_dbu_high, CASE WHEN request_id % 5 = 0 THEN 2.5 ELSE ov_batch END AS batch_dbu_per_hour,
 CASE WHEN request_id % 8 = 0 THEN 'EXCLUDED' ELSE area_sql END AS sql_area, CASE WHEN st AND request_id % 9 <> 0 THEN st_tb END AS retained_tb, CASE WHEN s1 THEN s1_users END AS sql_users,
 CAST(NOT p1 AND request_id % 4 = 0 AS INT) + CAST(NOT p1 AND request_id % 14 = 0 AS INT) + CAST(request_id % 50 = 0 AS INT) + CAST(request_id % 11 = 0 AS INT) + CAST(request_id % 13 = 0 AS INT) AS errors FROM request_wide""")
def overrides(i):
    base, ov = requests(i), _overrides(i)
    d = rq.apply_overrides(base, ov)
    errors = rq.override_errors(base, ov).groupBy("request_id").agg(F.count("*").alias("errors"))
    first = F.when(F.get("processing", 0)["component_id"].endswith("-C01"), F.get("processing", 0))
    return d.join(errors, "request_id", "left").select("request_id", "model_days_per_month", "region", F.col("transfer.daily_gb_high").alias("daily_gb_high"),
                                                       first["runs_per_month"].alias("c01_runs"), first["dbu_per_hour"]["HIGH"].alias("c01_dbu_high"),
                                                       F.col("assumptions.batch_dbu_per_hour").alias("batch_dbu_per_hour"), F.col("_areas")["sql"].alias("sql_area"),
                                                       F.col("storage.retained_tb").alias("retained_tb"), F.col("sql.concurrent_users").alias("sql_users"),
                                                       F.coalesce("errors", F.lit(0)).cast("int").alias("errors"))


# What a template costs, from its inputs and planning values alone: (scenario, stream DBU/h, batch DBU, report DBU, GB a day, input tokens, output tokens, tokens once).
_PLANNED = [("LOW", 0.5, 0, 0.5 * 22 * 4 * 1, 3, 500, 100, 10_000_000), ("EXPECTED", 1.0, 2, 1 * 22 * 4 * 2, 4, 1750, 500, 11_000_000),
            ("HIGH", 1.5, 4, 2 * 22 * 4 * 2, 6, 3000, 900, 12_000_000), ("STRESS", 2.0, 16, 4 * 22 * 4 * 3, 6, None, None, None)]
CTES["template_costs"] = " UNION ALL ".join(
    f"""SELECT c_custkey AS request_id, '{sc}' AS scenario, 'STREAM_TEMPLATE' AS template, {730 * d} * 0.31 + {b} * 0.31 + {q} * 0.44 + {g} * 22 * 0.015 + c_custkey % 9 * 1000 * 0.025 + 150 * 30 / 1000 * 0.006
 + 1.0 + 30 * 30 / 10000 * 0.03 AS monthly, c_custkey % 10 * 100 * 0.015 AS one_time FROM customer WHERE c_custkey % 2 = 0"""
    + ("" if ti is None else f""" UNION ALL SELECT c_custkey, '{sc}', 'MODEL_TEMPLATE', (200 * 30 * {ti} / 1e6 * 36 + 200 * 30 * {to} / 1e6 * 210) * 0.08, {once} / 1e6 * 2 * 0.08 FROM customer WHERE c_custkey % 2 = 1""")
    for sc, d, b, q, g, ti, to, once in _PLANNED)


def template_totals(i):
    """Totals of every customer's request, made from a template."""
    from fleetcost.sources.inputs import read_table
    c = read_table(i.spark, i.sf_dir, "customer").select(F.col("c_custkey").alias("request_id"))
    k = F.col("request_id")
    asked = c.withColumn("template", F.when(k % 2 == 0, "STREAM_TEMPLATE").otherwise("MODEL_TEMPLATE"))
    given = F.when(k % 2 == 0, F.array(F.struct(F.lit("retained_storage_tb").alias("path"), (k % 9).cast("string").alias("value")),
                                       F.struct(F.lit("migration_gb").alias("path"), (k % 10 * 100).cast("string").alias("value"))))
    params = c.select("request_id", F.explode(given).alias("x")).select("request_id", "x.*")
    d = rq.from_template(asked, rq.templates(i.spark), params)
    return tt.totals(ln.line_items(d, i.ref.rate_card, i.ref.model_conversions, RATES_AS_OF, carry=("template",)), ("request_id", "scenario", "template"))


@query("dcp_templates", f"SELECT request_id, scenario, template, {rn('monthly', 4)} AS recurring_monthly_usd, {rn('one_time', 4)} AS one_time_usd FROM template_costs")
def templates(i):
    return rounded(template_totals(i).select("request_id", "scenario", "template", "recurring_monthly_usd", "one_time_usd"), "recurring_monthly_usd one_time_usd", 4)
