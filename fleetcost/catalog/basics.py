"""Projections, filters, joins, aggregations, windows and function families (PRJ, FLT, JN, AG, WN, TK, FN)."""
from datetime import datetime

from fleetcost.catalog.registry import F, query, rounded
from fleetcost.functions import by_scenario, classify, clean_token, normalise_key
from fleetcost.operators import aggregates as agg
from fleetcost.operators import joins as jn
from fleetcost.oracle.base import CTES, rn
from fleetcost.refdata import frame_of, values_sql
from fleetcost.sources import inputs

# Default rules from a job name to a sizing profile, first match wins.
PROFILE_RULES = [
    (r"stream|kafka|kinesis|real.?time|continuous", "STREAMING"),
    (r"ingest|auto.?loader|autoloader|copy.?into|landing|bronze|raw", "INGESTION"),
    (r"train", "ML_TRAINING"),
    (r"scor|inference|predict|batch.?infer", "ML_INFERENCE"),
    (r"etl|silver|gold|transform|merge|aggregat|curat|enrich", "ETL")]
RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower({{c}}), '{rx}') THEN '{p}'" for rx, p in PROFILE_RULES) + " END"


def null_sql(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) IN ('', 'NULL', 'NONE', 'N/A') THEN NULL ELSE {c} END"


def table(i, name):
    return inputs.read_table(i.spark, i.sf_dir, name)


# ---- projections and filters ------------------------------------------------------------------------------------
@query("prj_null_tokens", f"SELECT request_id, {null_sql('cloud')} AS cloud, {null_sql('node_type')} AS node_type, {null_sql('region')} AS region FROM sizing_requests")
def null_tokens(i):
    return i("sizing_requests").select("request_id", *[clean_token(c).alias(c) for c in ("cloud", "node_type", "region")])


@query("prj_normalise_key", "SELECT request_id, upper(regexp_replace(trim(workload), '[ -]+', '_', 'g')) AS workload FROM sizing_requests")
def norm_key(i):
    return i("sizing_requests").select("request_id", normalise_key("workload").alias("workload"))


@query("prj_drop_columns", "SELECT * EXCLUDE (o_totalprice, o_orderdate, o_orderpriority) FROM orders")
def drop_columns(i):
    return table(i, "orders").drop("o_totalprice", "o_orderdate", "o_orderpriority")


_SC = "unnest(['LOW', 'EXPECTED', 'HIGH', 'STRESS'])"


@query("prj_by_scenario", f"""SELECT o_orderkey, scenario, {rn("CASE scenario WHEN 'LOW' THEN o_totalprice / 2 WHEN 'EXPECTED' THEN o_totalprice ELSE o_totalprice * 2 END", 2)} AS amount
 FROM (SELECT o_orderkey, o_totalprice, {_SC} AS scenario FROM orders)""")
def scenario_pivot(i):
    d = table(i, "orders").select("o_orderkey", "o_totalprice", F.explode(F.array(*map(F.lit, ("LOW", "EXPECTED", "HIGH", "STRESS")))).alias("scenario"))
    p = F.col("o_totalprice")
    return rounded(d.select("o_orderkey", "scenario", by_scenario(F.col("scenario"), p / 2, p, p * 2).alias("amount")), "amount", 2)


@query("flt_classify_rules", f"SELECT job_id, version, coalesce(upper(sizing_profile), {RULES_SQL.format(c='name')}) AS profile FROM job_versions")
def classify_rules(i):
    return i("job_versions").select("job_id", "version", F.coalesce(F.upper("sizing_profile"), classify(F.col("name"), PROFILE_RULES)).alias("profile"))


@query("flt_name_regex", "SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '0[0-4]$')")
def name_regex(i):
    return table(i, "supplier").where(F.col("s_name").rlike("0[0-4]$")).select("s_suppkey", "s_name")


@query("flt_ilike", f"SELECT sku_name, usage_unit, count(*) AS n, {rn('sum(usage_quantity)', 4)} AS quantity FROM usage_log WHERE sku_name ILIKE '%serverless%' GROUP BY 1, 2")
def ilike(i):
    d = i("usage_log").where(F.col("sku_name").ilike("%SERVERLESS%"))
    return rounded(d.groupBy("sku_name", "usage_unit").agg(F.count("*").alias("n"), F.sum("usage_quantity").alias("quantity")), "quantity", 4)


# ---- joins --------------------------------------------------------------------------------------------------------
_WL = "upper(regexp_replace(trim(workload), '[ -]+', '_', 'g'))"


@query("jn_alias", f"SELECT r.request_id, p.profile, p.node_category FROM (SELECT request_id, {_WL} AS w FROM sizing_requests) r JOIN ref_profiles p ON r.w = p.profile OR list_contains(string_split(p.aliases, ','), r.w)")
def alias(i):
    names = jn.alias_map(i.ref.profiles)
    d = i("sizing_requests").withColumn("name", normalise_key("workload"))
    return d.join(names, "name").select("request_id", "profile", "node_category")


@query("jn_cross_scenarios", "SELECT c.c_custkey, s.scenario, s.weight FROM customer c CROSS JOIN (VALUES ('LOW', 1), ('EXPECTED', 2), ('HIGH', 3)) s(scenario, weight)")
def cross_scenarios(i):
    three = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(w).alias("weight")) for w, n in enumerate(("LOW", "EXPECTED", "HIGH"), 1)])
    return table(i, "customer").select("c_custkey", F.explode(three).alias("s")).select("c_custkey", "s.scenario", "s.weight")


@query("jn_cross_single", f"SELECT o.o_orderkey, t.n AS all_orders, {rn('o.o_totalprice / t.total', 8)} AS share FROM orders o CROSS JOIN (SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders) t")
def cross_single(i):
    o = table(i, "orders")
    one = o.agg(F.struct(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))).scalar()   # scalar subquery, no join
    d = o.select("o_orderkey", "o_totalprice", one.alias("t"))
    return rounded(d.select("o_orderkey", F.col("t.n").alias("all_orders"), (F.col("o_totalprice") / F.col("t.total")).alias("share")), "share", 8)


_FAMILY = "f.cloud = upper(x.cloud) AND regexp_matches(x.worker_node, f.instance_pattern)"


@query("jn_semi_regex", f"SELECT workload_id, worker_node FROM fleet x WHERE EXISTS (SELECT 1 FROM ref_node_families f WHERE {_FAMILY})")
def semi_regex(i):
    f = i.ref.node_families.select(F.col("cloud").alias("f_cloud"), "instance_pattern")
    d = i("fleet").select("workload_id", "cloud", "worker_node")
    return d.join(f, (F.upper("cloud") == F.col("f_cloud")) & F.expr("worker_node RLIKE instance_pattern"), "left_semi").select("workload_id", "worker_node")


@query("jn_semi_exists", """SELECT workload_id, region, worker_node FROM fleet x WHERE EXISTS (SELECT 1 FROM ref_vm_costs v WHERE upper(v.cloud) = upper(x.cloud) AND lower(v.region) = lower(x.region)
 AND lower(v.instance_type) = lower(x.worker_node) AND lower(v.pricing_tier) = 'on_demand')""")
def semi_exists(i):
    v = i.ref.vm_costs.where(F.lower("pricing_tier") == "on_demand").select(F.upper("cloud").alias("vc"), F.lower("region").alias("vr"), F.lower("instance_type").alias("vi"))
    d = i("fleet").select("workload_id", "cloud", "region", "worker_node")
    on = (F.upper("cloud") == F.col("vc")) & (F.lower("region") == F.col("vr")) & (F.lower("worker_node") == F.col("vi"))
    return d.join(v, on, "left_semi").select("workload_id", "region", "worker_node")


@query("jn_semi_in", "SELECT event_id, run_id FROM run_log WHERE run_id IN (SELECT entity_run_id FROM lineage_log WHERE entity_type = 'NOTEBOOK')")
def semi_in(i):
    keys = i("lineage_log").where("entity_type = 'NOTEBOOK'").select(F.col("entity_run_id").alias("run_id"))
    return i("run_log").select("event_id", "run_id").join(keys, "run_id", "left_semi")


@query("jn_anti_unknown", f"""SELECT request_id, p.profile, 'RESOLVED' AS state FROM (SELECT request_id, {_WL} AS w FROM sizing_requests) r JOIN ref_profiles p ON r.w = p.profile OR list_contains(string_split(p.aliases, ','), r.w)
 UNION ALL SELECT request_id, NULL, 'UNKNOWN' FROM (SELECT request_id, {_WL} AS w FROM sizing_requests) r WHERE NOT EXISTS (SELECT 1 FROM ref_profiles p WHERE r.w = p.profile OR list_contains(string_split(p.aliases, ','), r.w))""")
def anti_unknown(i):
    d = i("sizing_requests").select("request_id", normalise_key("workload").alias("name"))
    names = jn.alias_map(i.ref.profiles).select("name", "profile")
    return d.join(names, "name", "left").select("request_id", "profile", F.when(F.col("profile").isNull(), "UNKNOWN").otherwise("RESOLVED").alias("state"))


# yearly price windows of the usage SKUs, with a gap and a duplicate on purpose
_YEARS = ([("sku_name", "string"), ("cloud", "string"), ("usage_unit", "string"), ("currency_code", "string"), ("price_start_time", "timestamp_ntz"),
           ("price_end_time", "timestamp_ntz"), ("price", "double")],
          [(s, "AWS", "DBU", "USD", datetime(y, 1, 1), None if y == 2001 else datetime(y + 1, 1, 1), round(b + 0.01 * (y - 1995), 2))
           for s, b in (("PREMIUM_JOBS_COMPUTE", 0.15), ("premium_jobs_serverless_compute", 0.35), ("PREMIUM_SQL_PRO_COMPUTE", 0.5))
           for y in range(1995, 2002) if not (s == "PREMIUM_SQL_PRO_COMPUTE" and y == 1998)]
          + [("PREMIUM_JOBS_COMPUTE", "AWS", "DBU", "USD", datetime(1999, 1, 1), datetime(2000, 1, 1), 0.99), ("PREMIUM_JOBS_COMPUTE", "AWS", "DBU", "EUR", datetime(1995, 1, 1), None, 0.2)])
CTES["yearly_prices"] = values_sql(*_YEARS)
_EFF = """usage_log u LEFT JOIN yearly_prices p ON p.currency_code = 'USD' AND p.sku_name = u.sku_name AND p.cloud = u.cloud AND p.usage_unit = u.usage_unit
 AND u.usage_start_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_start_time < p.price_end_time)"""


@query("jn_effective_price", f"SELECT l_orderkey, l_linenumber, usage_quantity, u.sku_name, {rn('p.price', 4)} AS unit_price, {rn('usage_quantity * p.price', 4)} AS cost FROM {_EFF}")
def effective_price(i):
    d = jn.effective_price(i("usage_log"), frame_of(i.spark, *_YEARS))
    return rounded(d.select("l_orderkey", "l_linenumber", "usage_quantity", "sku_name", "unit_price", (F.col("usage_quantity") * F.col("unit_price")).alias("cost")), "unit_price cost", 4)


CTES["run_span"] = "SELECT run_id, cluster_id, min(period_start_time) AS start_t, max(period_end_time) AS end_t FROM run_log GROUP BY 1, 2"


@query("jn_interval_overlap", f"""SELECT r.run_id, n.event_id, {rn("date_diff('second', greatest(n.start_time, r.start_t), least(n.end_time, r.end_t)) / 3600.0")} AS overlap_hours
 FROM run_span r JOIN node_log n ON n.cluster_id = r.cluster_id AND n.start_time < r.end_t AND n.end_time > r.start_t WHERE n.start_time < TIMESTAMP '{inputs.AS_OF} 00:00:00' AND r.start_t < TIMESTAMP '{inputs.AS_OF} 00:00:00'""")
def interval_overlap(i):
    until = f"{inputs.AS_OF} 00:00:00"      # all intervals start before it, so one that never ends is listed up to it
    runs = i("run_log").groupBy("run_id", "cluster_id").agg(F.min("period_start_time").alias("start_t"), F.max("period_end_time").alias("end_t")).where(F.col("start_t") < F.lit(until).cast("timestamp_ntz"))
    nodes = i("node_log").select("event_id", "cluster_id", "start_time", "end_time").where(F.col("start_time") < F.lit(until).cast("timestamp_ntz"))
    d = jn.interval_overlap(runs, nodes, "cluster_id", ("start_t", "end_t"), ("start_time", "end_time"), until)
    return rounded(d.select("run_id", "event_id", "overlap_hours"), "overlap_hours")


@query("jn_either_key", """SELECT w.event_id, coalesce(r.run_id, m.run_id) AS run_id FROM write_log w LEFT JOIN (SELECT DISTINCT run_id FROM run_log WHERE result_state = 'SUCCEEDED') r ON r.run_id = w.job_run_ref
 LEFT JOIN (SELECT DISTINCT task_run_id, run_id FROM run_log) m ON m.task_run_id = w.job_task_id""")
def either_key(i):
    runs = i("run_log").where("result_state = 'SUCCEEDED'").select("run_id")
    return jn.either_key(i("write_log"), runs, i("run_log").select("task_run_id", "run_id"), "job_run_ref", "job_task_id", "run_id").select("event_id", "run_id")


@query("jn_explode_ids", """SELECT DISTINCT t.run_id, t.cid AS cluster_id, c.cluster_source FROM (SELECT run_id, unnest([cluster_id, cluster_id2]) AS cid FROM run_log) t
 JOIN (SELECT cluster_id, max_by(cluster_source, change_time) AS cluster_source FROM cluster_versions GROUP BY 1) c ON c.cluster_id = t.cid""")
def explode_ids(i):
    t = i("run_log").select("run_id", F.explode(F.array("cluster_id", "cluster_id2")).alias("cluster_id")).distinct()
    c = agg.latest(i("cluster_versions"), ["cluster_id"], ["change_time"], ["cluster_source"])
    return t.join(c, "cluster_id").select("run_id", "cluster_id", "cluster_source")


# ---- aggregations -----------------------------------------------------------------------------------------------
_EPOCH = "CAST(floor(epoch({c})) AS BIGINT)"


@query("ag_run_rollup", f"""SELECT workspace_id, job_id, run_id, {_EPOCH.format(c='min(period_start_time)')} AS start_s, {_EPOCH.format(c='max(period_end_time)')} AS end_s,
 max_by(result_state, (period_end_time, period_start_time)) AS result_state, max(run_name) AS run_name, max(setup_duration_seconds) AS setup_s, max(execution_duration_seconds) AS exec_s,
 bool_or(compute_type = 'SERVERLESS_COMPUTE') AS serverless FROM run_log GROUP BY 1, 2, 3""")
def run_rollup(i):
    from fleetcost.plans.calibrate import roll_up_runs, run_timeline
    d = roll_up_runs(run_timeline(i("run_log")))
    return d.select("workspace_id", "job_id", "run_id", F.unix_timestamp("start_t").alias("start_s"), F.unix_timestamp("end_t").alias("end_s"),
                    "result_state", "run_name", "setup_s", "exec_s", "serverless")


@query("ag_two_level", """SELECT run_id, max(s) AS setup_s, CAST(sum(e) AS BIGINT) AS exec_s, count(*) AS tasks FROM (SELECT run_id, task_run_id, max(setup_duration_seconds) AS s, max(execution_duration_seconds) AS e FROM run_log GROUP BY 1, 2) GROUP BY 1""")
def two_level(i):
    t = i("run_log").groupBy("run_id", "task_run_id").agg(F.max("setup_duration_seconds").alias("s"), F.max("execution_duration_seconds").alias("e"))
    return t.groupBy("run_id").agg(F.max("s").alias("setup_s"), F.sum("e").alias("exec_s"), F.count("*").alias("tasks"))


@query("ag_workers_or_driver", f"""SELECT cluster_id, count(DISTINCT CASE WHEN NOT driver THEN instance_id END) AS workers_seen, count(*) FILTER (WHERE NOT driver) = 0 AS single_node,
 {rn('CASE WHEN count(*) FILTER (WHERE NOT driver) > 0 THEN sum(CASE WHEN NOT driver THEN network_received_bytes END) ELSE sum(network_received_bytes) END / 1e9')} AS gb,
 {rn('CASE WHEN count(*) FILTER (WHERE NOT driver) > 0 THEN avg(CASE WHEN NOT driver THEN cpu_user_percent END) ELSE avg(cpu_user_percent) END', 4)} AS cpu FROM node_log GROUP BY 1""")
def workers_or_driver(i):
    work = ~F.col("driver")
    n = F.count_if(work)

    def pick(fn, c):
        return F.when(n > 0, fn(F.when(work, F.col(c)))).otherwise(fn(F.col(c)))
    d = i("node_log").groupBy("cluster_id").agg(
        F.count_distinct(F.when(work, F.col("instance_id"))).alias("workers_seen"), (n == 0).alias("single_node"),
        (pick(F.sum, "network_received_bytes") / 1e9).alias("gb"), pick(F.avg, "cpu_user_percent").alias("cpu"))
    return rounded(rounded(d, "gb"), "cpu", 4)


@query("ag_count_distinct", "SELECT job_id, count(DISTINCT run_id) AS runs, count(DISTINCT CAST(period_start_time AS DATE)) AS days FROM run_log GROUP BY 1")
def count_distinct(i):
    return i("run_log").groupBy("job_id").agg(F.count_distinct("run_id").alias("runs"), F.count_distinct(F.to_date("period_start_time")).alias("days"))


@query("ag_quartiles_approx", f"SELECT event_type, {rn('quantile_disc(value, 0.25)')} AS q1, {rn('quantile_disc(value, 0.5)')} AS q2, {rn('quantile_disc(value, 0.75)')} AS q3 FROM events GROUP BY 1")
def quartiles_approx(i):
    d = table(i, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.25, 0.5, 0.75]).alias("q"))
    return rounded(d.select("event_type", *[F.col("q")[n].alias(f"q{n + 1}") for n in range(3)]), "q1 q2 q3")


@query("ag_quartiles_exact", f"SELECT l_returnflag, {rn('quantile_cont(v, 0.25)', 4)} AS q1, {rn('quantile_cont(v, 0.5)', 4)} AS q2, {rn('quantile_cont(v, 0.75)', 4)} AS q3 FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END AS v FROM lineitem) GROUP BY 1")
def quartiles_exact(i):
    v = F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice"))
    d = table(i, "lineitem").select("l_returnflag", v.alias("v"))
    return rounded(agg.exact_quantiles(d, "l_returnflag", "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "q1 q2 q3", 4)


@query("ag_ratio_of_sums", f"SELECT l_suppkey, {rn('sum(l_extendedprice) / nullif(sum(l_quantity * l_discount), 0)', 4)} AS usd_per_gb FROM lineitem GROUP BY 1")
def ratio_of_sums(i):
    d = table(i, "lineitem").groupBy("l_suppkey").agg((F.sum("l_extendedprice") / F.nullif(F.sum(F.col("l_quantity") * F.col("l_discount")), F.lit(0.0))).alias("usd_per_gb"))
    return rounded(d, "usd_per_gb", 4)


@query("ag_name_list", "SELECT job_run_id, string_agg(DISTINCT sku_name, ', ' ORDER BY sku_name) AS skus FROM run_usage_log GROUP BY 1")
def name_list(i):
    # a set per run, merged before the shuffle: bounded by the number of SKUs
    return i("run_usage_log").groupBy("job_run_id").agg(F.array_join(F.array_sort(F.collect_set("sku_name")), ", ").alias("skus"))


@query("ag_distinct", "SELECT DISTINCT sku_name, cloud, usage_unit FROM usage_log")
def distinct(i):
    return i("usage_log").select("sku_name", "cloud", "usage_unit").distinct()


@query("ag_status_counts", "SELECT result_state, compute_type, count(*) AS runs FROM run_log GROUP BY 1, 2")
def status_counts(i):
    return i("run_log").groupBy("result_state", "compute_type").agg(F.count("*").alias("runs"))


@query("ag_rows_to_json", """SELECT cloud, '{"cloud":"' || cloud || '","rows":[' || string_agg('{"sku":"' || sku_name || '","lines":' || CAST(n AS VARCHAR) || ',"units":' || CAST(units AS VARCHAR) || '}', ',' ORDER BY sku_name) || ']}' AS bundle
 FROM (SELECT cloud, sku_name, count(*) AS n, CAST(sum(CAST(usage_quantity AS BIGINT)) AS BIGINT) AS units FROM usage_log GROUP BY 1, 2) GROUP BY 1""")
def rows_to_json(i):
    # rows are reduced to one per SKU first, so an array holds at most the SKU list of a cloud
    s = i("usage_log").groupBy("cloud", "sku_name").agg(F.count("*").alias("lines"), F.sum(F.col("usage_quantity").cast("long")).alias("units"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("sku_name").alias("sku"), "lines", "units")))
    return s.groupBy("cloud").agg(rows.alias("rows")).select("cloud", F.to_json(F.struct("cloud", "rows")).alias("bundle"))


@query("ag_max_per_key", "SELECT l_partkey, max(l_quantity) AS top_quantity, max(l_shipdate) IS NOT NULL AS shipped FROM lineitem GROUP BY 1")
def max_per_key(i):
    return table(i, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("top_quantity"), F.max("l_shipdate").isNotNull().alias("shipped"))


# ---- windows and top-k ---------------------------------------------------------------------------------------------
@query("wn_latest_version", "SELECT job_id, name, version FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY change_time DESC) AS rn FROM job_versions) WHERE rn = 1")
def latest_version(i):
    return agg.latest(i("job_versions"), ["job_id"], ["change_time"], ["name", "version"])


CTES["name_asked"] = "SELECT o_orderkey AS question_id, CASE o_orderkey % 5 WHEN 0 THEN 'CUSTOMER#0000000' WHEN 1 THEN 'supplier#00000000' WHEN 2 THEN ' Supplier#000000003 ' WHEN 3 THEN 'nobody' ELSE 'SUPPLIER#' END || CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey % 10 AS VARCHAR) ELSE '' END AS asked FROM orders"


@query("wn_unique_best_match", """SELECT question_id, s_suppkey FROM (SELECT *, min(rnk) OVER (PARTITION BY question_id) AS best, count(*) OVER (PARTITION BY question_id, rnk) AS n_at FROM (
  SELECT question_id, s_suppkey, CASE WHEN upper(trim(s_name)) = upper(trim(asked)) THEN 1 WHEN starts_with(upper(s_name), upper(trim(asked))) THEN 2 END AS rnk FROM name_asked, supplier) WHERE rnk IS NOT NULL)
 WHERE rnk = best AND n_at = 1""")
def unique_best_match(i):
    from fleetcost.plans.requests import unique_match
    k = F.col("o_orderkey") % 5
    asked = F.concat(F.when(k == 0, "CUSTOMER#0000000").when(k == 1, "supplier#00000000").when(k == 2, " Supplier#000000003 ").when(k == 3, "nobody").otherwise("SUPPLIER#"),
                     F.when(k < 2, (F.col("o_custkey") % 10).cast("string")).otherwise(F.lit("")))
    q = table(i, "orders").select(F.col("o_orderkey").alias("question_id"), asked.alias("asked"))
    names = table(i, "supplier").select("s_suppkey", F.array("s_name").alias("names"))
    return unique_match(q, "asked", names, "s_suppkey").where("s_suppkey IS NOT NULL").select("question_id", "s_suppkey")


@query("wn_time_split", """SELECT event_id, CASE WHEN pr < 0.67 THEN 'OLDER' ELSE 'NEWER' END AS split FROM (SELECT event_id, percent_rank() OVER (PARTITION BY event_type ORDER BY ts) AS pr FROM events)""")
def time_split(i):
    d = table(i, "events").select("event_id", "event_type", "ts")
    return agg.time_split(d, "event_type", "ts", 0.67).select("event_id", "split")


@query("wn_peak_concurrency", """SELECT max(a) AS peak_concurrent_statements FROM (SELECT CAST(sum(d) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS a FROM (SELECT t, sum(d) AS d FROM (
 SELECT start_time AS t, 1 AS d FROM statement_log WHERE end_time IS NOT NULL UNION ALL SELECT end_time, -1 FROM statement_log WHERE end_time IS NOT NULL) GROUP BY 1))""")
def peak_concurrency(i):
    return agg.peak_concurrency(i("statement_log"), "start_time", "end_time")


@query("tk_top_tables", """SELECT target_table_full_name AS table_name, count(*) AS n FROM lineage_log WHERE workspace_id = 'ws1' AND entity_type = 'JOB' AND target_table_full_name IS NOT NULL
 AND entity_run_id IN (SELECT run_id FROM run_log WHERE result_state = 'SUCCEEDED') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def top_tables(i):
    runs = i("run_log").where("result_state = 'SUCCEEDED'").select(F.col("run_id").alias("entity_run_id"))
    d = i("lineage_log").where("workspace_id = 'ws1' AND entity_type = 'JOB' AND target_table_full_name IS NOT NULL").join(runs, "entity_run_id", "left_semi")
    return d.groupBy(F.col("target_table_full_name").alias("table_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table_name").limit(10)


@query("tk_latest_rows", "SELECT event_id, run_id, result_state FROM run_log WHERE result_state = 'SUCCEEDED' ORDER BY period_start_time DESC, event_id LIMIT 50")
def latest_rows(i):
    return i("run_log").where("result_state = 'SUCCEEDED'").orderBy(F.desc("period_start_time"), "event_id").limit(50).select("event_id", "run_id", "result_state")


# ---- function families ------------------------------------------------------------------------------------------------
@query("fn_string", """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) || '/' || trim(' ' || c_name || ' ') AS joined, regexp_replace(c_name, '[#0]+', '_', 'g') AS cleaned, string_split(c_name, '#')[1] AS head,
 starts_with(c_name, 'Cust') AS starts, replace(lower(c_mktsegment), 'h', '-') AS replaced, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS capital, c_name LIKE '%7' AS ends7, regexp_matches(lower(c_name), 'r#0+1') AS rx FROM customer""")
def fn_string(i):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(i, "customer").select(
        "c_custkey", F.upper(n).alias("up"), F.concat(F.lower(m), F.lit("/"), F.trim(F.concat(F.lit(" "), n, F.lit(" ")))).alias("joined"),
        F.regexp_replace(n, "[#0]+", "_").alias("cleaned"), F.split(n, "#")[0].alias("head"), F.startswith(n, F.lit("Cust")).alias("starts"),
        F.replace(F.lower(m), F.lit("h"), F.lit("-")).alias("replaced"), F.initcap(m).alias("capital"), n.like("%7").alias("ends7"), F.lower(n).rlike("r#0+1").alias("rx"))


@query("fn_math", f"""SELECT o_orderkey, CAST(ceil(o_totalprice / 1000) AS INTEGER) AS up, {rn('o_totalprice / 7', 3)} AS rounded, abs(o_totalprice - 100000) AS distance, greatest(o_custkey, o_orderkey) AS hi, least(o_custkey, o_orderkey) AS lo FROM orders""")
def fn_math(i):
    p = F.col("o_totalprice")
    d = table(i, "orders").select("o_orderkey", F.ceil(p / 1000).cast("int").alias("up"), (p / 7).alias("rounded"), F.abs(p - 100000).alias("distance"),
                                  F.greatest("o_custkey", "o_orderkey").alias("hi"), F.least("o_custkey", "o_orderkey").alias("lo"))
    return rounded(d, "rounded", 3)


@query("fn_null", f"SELECT workload_id, coalesce(num_workers, -1) AS workers, nullif(runs_per_day, 0) AS runs, {rn('hours_per_month * num_workers', 4)} AS pending, hours_per_month IS NULL AS unknown FROM fleet")
def fn_null(i):
    d = i("fleet").select("workload_id", F.coalesce("num_workers", F.lit(-1)).alias("workers"), F.nullif("runs_per_day", F.lit(0)).alias("runs"),
                          (F.col("hours_per_month") * F.col("num_workers")).alias("pending"), F.col("hours_per_month").isNull().alias("unknown"))
    return rounded(d, "pending", 4)


@query("fn_datetime", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, date_diff('second', period_start_time, period_end_time) AS seconds, strftime(CAST(ts AS DATE) - 90, '%Y-%m-%d') AS back,
 ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAYS AS recent FROM run_log JOIN (SELECT event_id, ts FROM events) USING (event_id)""")
def fn_datetime(i):
    t = F.col("period_start_time")
    recent = t >= F.lit("2024-01-25").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return i("run_log").select("event_id", F.date_format(t, "yyyy-MM-dd").alias("day"), (F.unix_timestamp("period_end_time") - F.unix_timestamp(t)).alias("seconds"),
                               F.date_format(F.date_sub(F.to_date(t), 90), "yyyy-MM-dd").alias("back"), recent.alias("recent"))


@query("fn_array", """SELECT vec_id, CAST(len(a) AS INTEGER) AS n, list_contains(a, 1) AS has_one, CAST(len(list_distinct(a)) AS INTEGER) AS n_distinct, array_to_string(list_sort(list_distinct(a)), ',') AS joined, CAST(a[1] AS BIGINT) AS first,
 CAST(len(list_filter(a, lambda x: x > 0)) AS INTEGER) AS positive, array_to_string(list_transform(a[1:3], lambda x: x * 2), ',') AS doubled, list_contains(list_transform(a, lambda x: x > 2), true) AS any_big
 FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 10) AS BIGINT)) AS a FROM embeddings)""")
def fn_array(i):
    a = F.col("a")
    d = table(i, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 10).cast("long")).alias("a"))
    return d.select("vec_id", F.size(a).alias("n"), F.array_contains(a, 1).alias("has_one"), F.size(F.array_distinct(a)).alias("n_distinct"),
                    F.array_join(F.array_sort(F.array_distinct(a)).cast("array<string>"), ",").alias("joined"), a[0].alias("first"),
                    F.size(F.filter(a, lambda x: x > 0)).alias("positive"), F.array_join(F.transform(F.slice(a, 1, 3), lambda x: x * 2).cast("array<string>"), ",").alias("doubled"),
                    F.exists(a, lambda x: x > 2).alias("any_big"))


@query("fn_map", """SELECT event_id, CASE WHEN metric_key = 'numOutputBytes' THEN CAST(metric_bytes AS VARCHAR) END AS out_bytes, CASE WHEN metric_key <> 'numOther' THEN CAST(metric_bytes AS DOUBLE) END AS bytes, 2 AS n, operation AS op FROM write_log""")
def fn_map(i):
    m = F.map_from_entries(F.array(F.struct(F.col("metric_key").alias("k"), F.col("metric_bytes").cast("string").alias("v")),
                                    F.struct(F.lit("operation").alias("k"), F.col("operation").alias("v"))))
    d = i("write_log").select("event_id", m.alias("m"))
    g = F.col("m")
    return d.select("event_id", g["numOutputBytes"].alias("out_bytes"), F.coalesce(g["numOutputBytes"], g["numTargetBytesAdded"], F.try_element_at(g, F.lit("numAddedBytes"))).cast("double").alias("bytes"),
                    F.size(F.map_keys(g)).alias("n"), F.create_map(F.lit("op"), g["operation"])["op"].alias("op"))


@query("fn_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text, json_extract_string(props, '$.zz') AS missing,
 '{"event_id":' || CAST(event_id AS VARCHAR) || ',"p":{"k":' || json_extract_string(props, '$.k') || '}}' AS bundle FROM events""")
def fn_json(i):
    p = F.from_json("props", "k int")
    return table(i, "events").select("event_id", p["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"), F.get_json_object("props", "$.zz").alias("missing"),
                                     F.to_json(F.struct("event_id", p.alias("p"))).alias("bundle"))


@query("fn_cast", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(l_linenumber AS DOUBLE) AS n, CAST(l_orderkey AS VARCHAR) AS k, CAST(ceil(l_tax * 100) AS INTEGER) AS tax, TRY_CAST(l_returnflag AS INTEGER) AS dirty FROM lineitem""")
def fn_cast(i):
    return table(i, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_linenumber").cast("double").alias("n"),
                                       F.col("l_orderkey").cast("string").alias("k"), F.ceil(F.col("l_tax") * 100).cast("int").alias("tax"), F.col("l_returnflag").try_cast("int").alias("dirty"))


@query("fn_count_if", "SELECT l_suppkey, count(*) FILTER (WHERE l_quantity > 25) AS big, count(*) FILTER (WHERE l_returnflag = 'R' AND l_tax > 0.04) AS taxed FROM lineitem GROUP BY 1")
def fn_count_if(i):
    return table(i, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.04)).alias("taxed"))

