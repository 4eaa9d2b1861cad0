"""Reconciliation (REC)."""
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.catalog.requests import compare, lines, template_totals
from fleetcost.oracle.base import CTES, r2, rn
from fleetcost.plans import reconcile as rec, requests as rq, totals as tt

CTES["figures"] = f"""SELECT request_id, scenario, presented, {rn('calculated', 4)} AS calculated, (presented IS NULL AND calculated IS NULL) OR coalesce(abs(calculated - presented) < 0.01, false) AS ok,
 CASE WHEN presented IS NULL AND calculated IS NULL THEN 'MATCH (pending)' WHEN presented IS NULL OR calculated IS NULL THEN 'DIFFERS' WHEN abs(calculated - presented) < 0.01 THEN 'MATCH'
  ELSE 'DIFFERS BY ' || CASE WHEN calculated < presented THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', {r2('abs(calculated - presented)')}) END AS status
 FROM presented_figures FULL JOIN (SELECT request_id, scenario, monthly AS calculated FROM template_costs) USING (request_id, scenario)"""


def _calculated(i):
    return template_totals(i).select("request_id", "scenario", F.col("recurring_monthly_usd").alias("calculated"))


def _figures(i):
    return rec.compare_figures(i("presented_figures"), _calculated(i), ["request_id", "scenario"])


@query("rec_figures", "SELECT request_id, scenario, presented, calculated, ok, status FROM figures")
def figures(i):
    return rounded(_figures(i), "calculated", 4)


@query("rec_verdict", "SELECT request_id, bool_and(ok) AS ok, count(*) FILTER (WHERE NOT ok) AS differences FROM figures GROUP BY 1")
def verdict(i):
    return rec.verdict(_figures(i), ["request_id"])


@query("rec_drift", """SELECT c_custkey AS request_id, 'STREAM_TEMPLATE' AS template, 'storage.retained_tb' AS path, '5.0' AS template_value, CAST(CAST(c_custkey % 9 AS DOUBLE) AS VARCHAR) AS request_value FROM customer WHERE c_custkey % 9 <> 5
 UNION ALL SELECT c_custkey, 'STREAM_TEMPLATE', 'sql.total_users', NULL, CAST(c_custkey % 50 AS VARCHAR) FROM customer""")
def drift(i):
    from fleetcost.sources.inputs import read_table
    c = read_table(i.spark, i.sf_dir, "customer").select(F.col("c_custkey").alias("request_id"))
    asked = c.withColumn("template", F.lit("STREAM_TEMPLATE"))
    k = F.col("request_id")
    params = c.select("request_id", F.lit("retained_storage_tb").alias("path"), (k % 9).cast("string").alias("value")).unionByName(
        c.select("request_id", F.lit("sql.total_users").alias("path"), (k % 50).cast("string").alias("value")))
    templates = rq.templates(i.spark)
    return rec.drift(rq.from_template(asked, templates, params), rq.parse(templates))


@query("rec_substitute", f"""SELECT a.request_id, a.component_id, a.model, a.scenario, {rn('t.monthly - coalesce(c.cost, 0) + a.swap', 4)} AS substituted_usd
 FROM (SELECT request_id, component_id, model, 'LOW' AS scenario, low_usd AS swap FROM alternatives UNION ALL SELECT request_id, component_id, model, 'EXPECTED', expected_usd FROM alternatives UNION ALL SELECT request_id, component_id, model, 'HIGH', high_usd FROM alternatives) a
 JOIN est_totals t ON t.request_id = a.request_id AND t.scenario = a.scenario
 LEFT JOIN (SELECT request_id, scenario, component_id, sum(cost_usd) AS cost FROM est_lines WHERE treatment = 'INCLUDED' AND recurrence = 'RECURRING_MONTHLY' GROUP BY 1, 2, 3) c ON c.request_id = a.request_id AND c.scenario = a.scenario AND c.component_id = a.component_id""")
def substitute(i):
    li = lines(i)
    cost = li.where("treatment = 'INCLUDED' AND recurrence = 'RECURRING_MONTHLY'").groupBy("request_id", "scenario", "component_id").agg(F.sum("cost_usd").alias("component_usd"))
    d = rec.substitute(tt.totals(li), cost, compare(i))
    return rounded(d.select("request_id", "component_id", "model", "scenario", "substituted_usd"), "substituted_usd", 4)


@query("rec_parity", """SELECT request_id, bool_and(coalesce(abs(monthly - presented) < 0.005 + 1e-9, false)) AS parity, count(*) AS figures
 FROM presented_figures LEFT JOIN template_costs USING (request_id, scenario) WHERE presented IS NOT NULL GROUP BY 1""")
def parity(i):
    expected = i("presented_figures").where("presented IS NOT NULL").withColumnRenamed("presented", "expected")
    return rec.parity(expected, _calculated(i).withColumnRenamed("calculated", "figure"), ["request_id", "scenario"], ["request_id"])
