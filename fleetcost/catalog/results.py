"""Result tables (OUT)."""
from fleetcost.catalog import calibration as _c  # noqa: F401
from fleetcost.catalog.pricecard import RATES_AS_OF
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.catalog.requests import _LINE, lines, shown
from fleetcost.oracle.base import CTES, derive, fmt, r2, rn
from fleetcost.plans import lines as ln, outputs as out, requests as rq, totals as tt, validate as vd
from fleetcost.sources import sinks


# ---- request documents with what-if overrides: loaded use cases, of which a tenth is priced without asking for the check -----------------------------
# Of a request k: the path that an override document names and its value as JSON. An explicit null is what the flat input's NULL means in storage.
_CHANGES = [("k % 6 = 0", "model_days_per_month", "15"), ("k % 7 = 0", "region", '"AP_SOUTH_1"'), ("k % 5 = 0", "assumptions.batch_dbu_per_hour", "2.5"), ("k % 9 = 4", "transfer.daily_gb_high", "-1"),
            ("k % 37 = 3", "moon.phase", "1"), ("k % 13 = 6", "processing[C01].runs_per_month", "7.5"), ("storage IS NOT NULL AND storage.s3_write_requests_per_file IS NULL", "storage.s3_write_requests_per_file", "null"),
            ("storage IS NOT NULL AND storage.kms_requests_per_encrypted_file IS NULL", "storage.kms_requests_per_encrypted_file", "null")]
_MALFORMED = "k % 31 = 5"
_ASKED = "CASE WHEN k % 10 <> 0 THEN true END"
CTES["over_request"] = f"""SELECT *, {_ASKED} AS named, CASE WHEN {_MALFORMED} THEN ['NOT_JSON overrides'] ELSE list_sort(list_filter([CASE WHEN k % 9 = 4 THEN 'INVALID_VALUE daily_gb_high (transfer), received -1' END, CASE WHEN k % 37 = 3 THEN 'UNKNOWN_FIELD moon, received "moon"' END,
  CASE WHEN k % 13 = 6 AND NOT p1 THEN 'INVALID_VALUE processing[C01].runs_per_month (C01), received 7.5' END, CASE WHEN j1 AND j1_in_high IS NULL THEN 'MISSING input_tokens_high (' || j1_id || ')' END], lambda e: e IS NOT NULL)) END AS texts
 FROM (SELECT *, request_id AS k FROM request_wide)"""
CTES["over_wide"] = """SELECT * EXCLUDE (k, texts) REPLACE (CASE WHEN k % 6 = 0 THEN 15 ELSE model_days END AS model_days, CASE WHEN k % 7 = 0 THEN 'AP_SOUTH_1' ELSE region END AS region, CASE WHEN k % 5 = 0 THEN 2.5 ELSE ov_batch END AS ov_batch,
  CASE WHEN k % 13 = 6 THEN 7.5 ELSE p1_runs END AS p1_runs) FROM over_request WHERE len(texts) = 0"""
CTES["over_refused"] = "SELECT request_id, use_case_id, CASE WHEN named THEN 'NEEDS_INPUT' ELSE 'REJECTED' END AS status, texts FROM over_request WHERE len(texts) > 0"


def documents(i):
    """The request documents as changed by their overrides, checked and written. A document takes long to check, so the rows are dealt out to all tasks first."""
    d = rq.assemble(i("request_wide", spread=True))
    fields = [c for c in d.columns if c != "request_id"]
    d = d.withColumn("k", F.col("request_id"))
    given = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(f'"{p}": {v}')) for c, p, v in _CHANGES]))
    text = F.when(F.expr(_MALFORMED), "{not; json").when(F.size(given) > 0, F.concat(F.lit("{"), F.array_join(given, ", "), F.lit("}")))
    docs = d.select("request_id", F.to_json(F.struct(*fields)).alias("request_json"), text.alias("overrides_json"), F.expr(_ASKED).alias("asked"))
    return out.settled(vd.judged(vd.checked(docs, i.ref.model_conversions), F.col("asked")))


def estimated(i):
    return out.estimate_documents(documents(i), i.ref.rate_card, i.ref.model_conversions, RATES_AS_OF)


_AREA_ORDER = "CASE area WHEN 'processing' THEN 1 WHEN 'sql' THEN 2 WHEN 'transfer' THEN 3 WHEN 'storage' THEN 4 WHEN 'model_endpoints' THEN 5 ELSE 6 END"
CTES["area_text"] = f"SELECT request_id, string_agg(area || ': ' || state, '; ' ORDER BY {_AREA_ORDER}) AS area_states FROM areas GROUP BY 1"
for _kind in ("PENDING", "WARNING", "ASSUMPTION"):
    CTES[f"{_kind.lower()}_text"] = f"SELECT request_id, string_agg(text, '; ' ORDER BY text) AS t FROM est_notes WHERE kind = '{_kind}' GROUP BY 1"


CTES["over_source"] = "SELECT string_agg(DISTINCT source, ', ' ORDER BY source) AS s FROM ref_rate_card WHERE provider = 'PLATFORM' AND unit = 'DBU' AND rate IS NOT NULL"


derive("w_", {"request_wide": "over_wide"}, "est_totals", "est_conf", "est_notes", "pending_text", "decided")
CTES["w_areas"] = CTES["areas"].replace("'UNCONFIRMED'", "CASE WHEN named THEN 'NOT_APPLICABLE' ELSE 'UNCONFIRMED' END").replace("request_wide", "over_wide")
CTES["w_area_text"] = CTES["area_text"].replace("areas GROUP", "w_areas GROUP")


def totals_sql(p: str) -> str:
    """Priced requests out of the subqueries with the prefix, and those that are refused."""
    return f"""SELECT t.request_id, w.use_case_id, w.use_case_name, t.scenario, CASE WHEN t.scenario = 'STRESS' THEN 'STRESS (operating sensitivity, not a forecast)' ELSE t.scenario END AS scenario_label,
 {r2('monthly')} AS recurring_monthly_usd, {r2('core')} AS core_monthly_usd, {r2('annual')} AS annual_usd, {r2('one_time')} AS one_time_usd, {r2('first_year')} AS first_year_usd, {r2('dbu')} AS dbu, {r2('dbu_usd')} AS dbu_usd, {r2('cloud_usd')} AS cloud_usd,
 pend_m + pend_o AS pending_items, coalesce(p.t, '') AS pending_detail, t.status, a.area_states, coalesce(c.rating, 'LOW') AS confidence, coalesce(c.reason, 'Nothing that recurs has a price.') AS confidence_reason, 'OK' AS request_status, '' AS errors,
 '1.0' AS calculator_version, (SELECT s FROM over_source) AS rate_card_source, '{out.DISCLAIMER}' AS disclaimer
 FROM {p}est_totals t JOIN over_wide w USING (request_id) JOIN {p}area_text a USING (request_id) LEFT JOIN {p}est_conf c USING (request_id) LEFT JOIN {p}pending_text p USING (request_id)
 UNION ALL SELECT request_id, use_case_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, status, array_to_string(texts, '; '), '1.0', NULL, '{out.DISCLAIMER}' FROM over_refused"""


@query("out_totals", totals_sql("w_"))
def out_totals(i):
    """One set of documents: changed, checked, then priced or refused."""
    return out.totals_table(estimated(i), i.ref.rate_card)


@query("chk_gate", f"""SELECT request_id, 'OK' AS status, scenario, {r2('monthly')} AS recurring_monthly_usd, '' AS errors FROM w_est_totals UNION ALL SELECT request_id, status, NULL, NULL, array_to_string(texts, '; ') FROM over_refused""")
def gate(i):
    """No figure for a request that the check stops."""
    return out.totals_table(estimated(i), i.ref.rate_card).select("request_id", F.col("request_status").alias("status"), "scenario", "recurring_monthly_usd", "errors")


@query("out_line_items", f"SELECT {_LINE} FROM est_lines")
def out_line_items(i):
    return shown(out.line_items(lines(i)))


CTES["rates_used"] = f"SELECT DISTINCT request_id, rate_status || ' $' || {fmt('rate', 6)} || '/' || unit || ' - ' || rate_source AS rate_used FROM est_lines WHERE rate IS NOT NULL"


@query("out_rates_used", "SELECT request_id, rate_used FROM rates_used")
def rates_used(i):
    return out.rates_used(lines(i))


def _usd(c: str) -> str:
    return f"'$' || format('{{:,.2f}}', {r2(c)})"


_ORD = "CASE scenario WHEN 'LOW' THEN 1 WHEN 'EXPECTED' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"
CTES["summaries"] = f"""SELECT w.request_id, 'Use case: ' || w.use_case_id || ' | ' || w.use_case_name || chr(10) || 'Monthly: ' || t.monthly_text || chr(10) || CASE WHEN t.has_once THEN 'One-time: ' || t.once_text || chr(10) ELSE '' END
 || 'First year (' || w.ref || '): ' || {_usd('t.fy[w.ref]')} || chr(10) || 'From year 2 on (' || w.ref || '): ' || {_usd('t.an[w.ref]')} || chr(10) || 'Confidence: ' || coalesce(c.rating, 'LOW') || ' - ' || coalesce(c.reason, 'Nothing that recurs has a price.') || chr(10)
 || CASE WHEN p.t IS NOT NULL THEN 'Pending: ' || p.t || chr(10) ELSE '' END || CASE WHEN a.t IS NOT NULL THEN 'Assumptions: ' || a.t || chr(10) ELSE '' END || CASE WHEN n.t IS NOT NULL THEN 'Notes: ' || n.t || chr(10) ELSE '' END
 || 'In scope: Compute' || chr(10) || 'Out of scope: Staging' || chr(10) || 'A figure for planning: it is neither a bill nor a promise of what will be spent.' AS summary
 FROM (SELECT *, CASE WHEN scenario_list LIKE '%EXPECTED%' THEN 'EXPECTED' ELSE string_split(scenario_list, ',')[1] END AS ref FROM request_wide) w
 JOIN (SELECT request_id, string_agg(scenario || ' ' || {_usd('monthly')}, '; ' ORDER BY {_ORD}) AS monthly_text, string_agg(scenario || ' ' || {_usd('one_time')}, '; ' ORDER BY {_ORD}) AS once_text, bool_or(one_time > 0 OR pend_o > 0) AS has_once,
   map(list(scenario), list(first_year)) AS fy, map(list(scenario), list(annual)) AS an FROM est_totals GROUP BY 1) t USING (request_id)
 LEFT JOIN est_conf c USING (request_id) LEFT JOIN pending_text p USING (request_id) LEFT JOIN assumption_text a USING (request_id) LEFT JOIN warning_text n USING (request_id)"""


@query("out_summary", "SELECT request_id, summary FROM summaries")
def summary(i):
    return out.summary(lines(i, ("scenarios", "calibration_allowed", *out.SUMMARY_HEAD)))


derive("w_", {"request_wide": "over_wide"}, "rates_used", "summaries")


@query("out_details", f"""SELECT request_id, 'NOTE' AS section, NULL AS component_id, NULL AS item, 'Planning input' AS detail FROM over_wide UNION ALL SELECT request_id, 'SCOPE_INCLUDED', NULL, NULL, 'Compute' FROM over_wide
 UNION ALL SELECT request_id, 'SCOPE_EXCLUDED', NULL, NULL, 'Staging' FROM over_wide UNION ALL SELECT request_id, 'DISCLAIMER', NULL, NULL, '{out.DISCLAIMER}' FROM over_wide
 UNION ALL SELECT request_id, 'AREA', area, state, NULL FROM w_areas UNION ALL SELECT request_id, kind, CASE WHEN kind = 'PENDING' THEN substr(text, 1, instr(text, ': ') - 1) END, NULL, CASE WHEN kind = 'PENDING' THEN substr(text, instr(text, ': ') + 2) ELSE text END FROM w_est_notes
 UNION ALL SELECT request_id, 'COMPUTE_DECISION', component_id, selected, 'alternative ' || coalesce(alternative, '-') || '; confidence ' || confidence || '; status ' || status || '; streaming ' || streaming_decision || '; eligible ' || replace(eligible, ',', ', ') FROM w_decided
 UNION ALL SELECT request_id, 'CONFIDENCE', NULL, rating, reason FROM w_est_conf UNION ALL SELECT request_id, 'RATE', NULL, NULL, rate_used FROM w_rates_used UNION ALL SELECT request_id, 'SUMMARY', NULL, NULL, summary FROM w_summaries
 UNION ALL SELECT request_id, 'ERROR', NULL, NULL, unnest(texts) FROM over_refused UNION ALL SELECT request_id, 'DISCLAIMER', NULL, NULL, '{out.DISCLAIMER}' FROM over_refused""")
def details(i):
    """Of the same set of documents. Line items are written once, as each section reads them."""
    saved = lambda d: sinks.overwrite(d, sinks.shared_folder(i.spark))
    r = out.settled_requests(documents(i))
    priced = r.where("request_status = 'OK'")
    ready = saved(ln.line_items(priced, i.ref.rate_card, i.ref.model_conversions, RATES_AS_OF, carry=("scenarios", "calibration_allowed", *out.SUMMARY_HEAD), filled=True))
    return out.details(priced, ready, F.coalesce("named", F.lit(False))).unionByName(out.refused_details(r))


@query("out_parse_result", f"SELECT request_id, 'OK' AS request_status, scenario, {r2('monthly')} AS recurring_monthly_usd, {r2('one_time')} AS one_time_usd, status FROM est_totals")
def parse_result(i):
    return out.parse_result(out.result_document(lines(i)))


@query("out_cost_slice", f"""SELECT request_id, {rn("coalesce(sum(CASE WHEN scenario = 'HIGH' AND treatment = 'INCLUDED' AND recurrence = 'RECURRING_MONTHLY' AND engine IN ('AWS_STORAGE', 'MODEL_API') THEN cost_usd END), 0)", 4)} AS cost_usd FROM est_lines GROUP BY 1""")
def cost_slice(i):
    return rounded(tt.cost_slice(lines(i), "HIGH", ("AWS_STORAGE", "MODEL_API")), "cost_usd", 4)
