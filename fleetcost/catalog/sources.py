"""Sources, sinks and merges (SRC, SNK)."""
from fleetcost.catalog.pricing import WAREHOUSE_COST
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.operators import merges as mg
from fleetcost.oracle.base import CTES, rn, rounded as r
from fleetcost.plans import pricing as pr
from fleetcost.plans.pricecard import price_card, with_pricing_struct
from fleetcost.refdata import RefData, frame_of, values_sql
from fleetcost.sources import inputs, rates, readers, sinks

_UNIVERSE = "cloud string, region string, tier string, sku_name string, product_type string, price_per_dbu double"


@query("src_rate_csv", f"SELECT cloud, region, tier, sku_name, product_type, {r('price_per_dbu')} FROM price_universe")
def rate_csv(i):
    path = sinks.shared_folder(i.spark)
    i("price_universe").repartition(4).write.option("header", True).csv(path)
    return rounded(readers.read_rate_csv(i.spark, f"{path}/part-*.csv", _UNIVERSE), "price_per_dbu")


@query("src_rate_folder", WAREHOUSE_COST)
def rate_folder(i):
    """The fleet's warehouses priced from rate files: every table is written as the CSV it is delivered as (one of them in two parts), and
    all are loaded, the swapped columns of the warehouse table included."""
    folder, fixtures = sinks.shared_folder(i.spark), RefData.fixtures(i.spark)
    for name, file in rates.RATE_FILES.items():
        for part in range(2 if "*" in file else 1):
            rows = getattr(fixtures, name)
            rows = rows.where(F.pmod(F.hash("instance_type"), F.lit(2)) == part) if "*" in file else rows
            rows.withColumn("delivered", F.lit("extra")).write.option("header", True).csv(f"{folder}/{file.replace('*', str(part + 1))}")
    ref = RefData.of(i.spark, rates.read_rate_tables(i.spark, folder))
    ref.prices = with_pricing_struct(ref.prices)
    ref.price_card = price_card(ref.dbu_rates, ref.sku_region_map, ref.prices, inputs.AS_OF)
    d = pr.warehouse(i("fleet"), ref)
    return rounded(d.select("workload_id", *pr.COST_COLUMNS), "dbu_per_hour hours_per_month dbu_per_month dbu_price")


@query("src_rate_rejects", f"""SELECT CASE WHEN p_size % 11 = 0 THEN 'rejected' ELSE 'loaded' END AS kind, count(*) AS records, {rn('sum(CASE WHEN p_size % 11 <> 0 THEN p_retailprice END)', 2)} AS price, count(*) FILTER (p_size % 11 <> 0 AND p_type IS NULL) AS gaps FROM part GROUP BY 1""")
def rate_rejects(i):
    """Rate files of which some records have a word where a number belongs: loaded and rejected records add up to those delivered."""
    path = sinks.shared_folder(i.spark)
    p = inputs.read_table(i.spark, i.sf_dir, "part")
    price = F.when(F.col("p_size") % 11 == 0, "on request").otherwise(F.col("p_retailprice").cast("string"))
    p.select("p_partkey", "p_type", price.alias("price")).repartition(4).write.option("header", True).csv(path)
    rows, rejected = readers.read_rate_csv_checked(i.spark, f"{path}/part-*.csv", "p_partkey long, p_type string, price double")
    good = rows.agg(F.lit("loaded").alias("kind"), F.count("*").alias("records"), F.sum("price").alias("price"), F.count_if(F.col("p_type").isNull()).alias("gaps"))
    bad = rejected.where("file IS NOT NULL AND record LIKE '%,on request'").agg(F.lit("rejected").alias("kind"), F.count("*").alias("records"), F.lit(None).cast("double").alias("price"), F.lit(0).cast("long").alias("gaps"))
    return rounded(good.unionByName(bad), "price", 2)


@query("src_request_json", """SELECT policy_id, cloud, policy_name, CAST(json_extract(definition, '$.num_workers.maxValue') AS INTEGER) AS max_workers FROM policy_documents""")
def request_json(i):
    path = sinks.shared_folder(i.spark)
    doc = F.to_json(F.struct("policy_id", "cloud", "policy_name", F.from_json("definition", "num_workers struct<type: string, maxValue: int>").alias("definition")))
    i("policy_documents").select(doc.alias("value")).write.text(path)
    d = readers.read_documents(i.spark, path, "policy_id long, cloud string, policy_name string, definition struct<num_workers: struct<maxValue: int>>", one_per_file=False)
    return d.select("policy_id", "cloud", "policy_name", F.col("definition.num_workers.maxValue").alias("max_workers"))


_T, _DAYS = "2024-01-25 00:00:00", 10
_WINDOW = "workspace_id = 'ws1' AND period_start_time >= TIMESTAMP '2024-01-15 00:00:00' AND period_start_time < TIMESTAMP '2024-01-25 00:00:00'"


@query("src_lookback_scan", f"SELECT event_id, job_id, run_id, result_state FROM run_log WHERE {_WINDOW}")
def lookback_scan(i):
    return readers.lookback(i("run_log"), "ws1", "period_start_time", _T, _DAYS).select("event_id", "job_id", "run_id", "result_state")


_KINDS = ([("event_type", "string"), ("label", "string"), ("weight", "double")],
          [("click", "light", 0.5), ("view", "light", 0.25), ("purchase", "heavy", 2.0), ("signup", "heavy", 1.5)])
CTES["event_kinds"] = values_sql(*_KINDS)


@query("src_inline_values", f"SELECT coalesce(label, 'none') AS label, count(*) AS n, {rn('sum(value * weight)', 4)} AS weighted FROM events LEFT JOIN event_kinds USING (event_type) GROUP BY 1")
def inline_values(i):
    events = inputs.read_table(i.spark, i.sf_dir, "events").select("event_type", "value")
    d = events.join(frame_of(i.spark, *_KINDS), "event_type", "left")
    return rounded(d.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("weight")).alias("weighted")), "weighted", 4)


def write_history_frame(i, *carry):
    """The write log in its nested form. Logs of tables that the reader may not open are marked in it."""
    metrics = F.create_map(F.col("metric_key"), F.col("metric_bytes").cast("string"))
    job = F.when(F.col("job_task_id").isNotNull(), F.struct(F.col("job_run_ref").alias("jobRunId"), F.col("job_task_id").alias("runId")))
    return i("write_log").select("table_name", "operation", F.col("write_time").alias("timestamp"), job.alias("job"), metrics.alias("operationMetrics"), *carry)


CTES["history"] = """SELECT coalesce(job_run_ref, job_task_id) AS run_ref, job_task_id AS task_run_id, CASE WHEN metric_key <> 'numOther' THEN CAST(metric_bytes AS DOUBLE) END AS bytes, table_name, readable
 FROM write_log WHERE job_task_id IS NOT NULL AND write_time >= TIMESTAMP '2024-01-05 00:00:00' AND operation IN ('WRITE', 'STREAMING UPDATE', 'MERGE', 'COPY INTO', 'UPDATE')"""


@query("src_write_history", f"""SELECT table_name, 'READ' AS state, count(*) AS writes, {rn('sum(bytes)', 0)} AS bytes FROM history WHERE readable GROUP BY table_name
 UNION ALL SELECT DISTINCT target_table_full_name, 'SKIPPED', 0, NULL FROM lineage_log WHERE entity_type = 'JOB' AND target_table_full_name IS NOT NULL
  AND target_table_full_name NOT IN (SELECT table_name FROM history WHERE readable)""")
def write_history(i):
    h = readers.write_history(write_history_frame(i, "readable").where("readable"), "2024-01-05")
    expected = i("lineage_log").where("entity_type = 'JOB' AND target_table_full_name IS NOT NULL").select(F.col("target_table_full_name").alias("table_name"))
    read = h.groupBy("table_name").agg(F.count("*").alias("writes"), F.sum("bytes").alias("bytes")).withColumn("state", F.lit("READ"))
    skipped = readers.unread_tables(expected, h).withColumn("state", F.lit("SKIPPED"))
    d = readers.union_many(i.spark, [read, skipped], "")
    return rounded(d.withColumn("writes", F.coalesce("writes", F.lit(0))), "bytes", 0)


@query("src_history_files", f"""SELECT table_name, if(readable, 'READ', 'SKIPPED') AS state, CASE WHEN readable THEN count(*) ELSE 0 END AS writes, CASE WHEN readable THEN {rn('sum(metric_bytes)', 0)} END AS bytes
 FROM write_log WHERE table_name <> 'tbl_gone' GROUP BY table_name, readable UNION ALL SELECT 'tbl_gone', 'SKIPPED', 0, NULL""")
def history_files(i):
    """The write logs of all tables as one read over their folders, of which some hold a broken file and one is missing."""
    folder, log = sinks.shared_folder(i.spark), i("write_log")
    log.where("readable").select("table_name", "metric_bytes").write.partitionBy("table_name").parquet(folder)
    names = {r["table_name"]: r["readable"] for r in log.select("table_name", "readable").distinct().collect()}
    for name in (n for n, readable in names.items() if not readable):
        sinks.put_text(i.spark, f"{folder}/table_name={name}/part-0.parquet", "no Parquet at all")
    rows, files = readers.read_tables(i.spark, {n: f"{folder}/table_name={n}" for n in [*names, "tbl_gone"]}, "metric_bytes long")
    sums = rows.groupBy("table_name").agg(F.sum("metric_bytes").cast("double").alias("bytes"))
    d = files.groupBy("table_name").agg(F.min("state").alias("state"), F.sum("rows").alias("writes")).join(sums, "table_name", "left")
    return rounded(d, "bytes", 0)


@query("src_load_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in inputs._TABLES))
def load_counts(i):
    return readers.row_counts({t: inputs.read_table(i.spark, i.sf_dir, t) for t in inputs._TABLES})


@query("snk_overwrite", f"SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS customers, {rn('sum(c_acctbal)', 2)} AS balance FROM customer GROUP BY 1")
def overwrite(i):
    path = sinks.shared_folder(i.spark)
    c = inputs.read_table(i.spark, i.sf_dir, "customer")
    sinks.overwrite(c.groupBy("c_nationkey").agg(F.count("*").alias("old_layout")), path)
    d = c.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return sinks.overwrite(rounded(d, "balance", 2), path)


@query("snk_append_evolve", f"""SELECT 1 AS run_number, c_mktsegment AS segment, count(*) AS customers, CAST(NULL AS DOUBLE) AS balance FROM customer GROUP BY 2
 UNION ALL SELECT 2, c_mktsegment, count(*), {rn('sum(c_acctbal)', 2)} FROM customer WHERE c_acctbal > 0 GROUP BY 2""")
def append_evolve(i):
    path = sinks.shared_folder(i.spark)
    c = inputs.read_table(i.spark, i.sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment")
    sinks.append_evolving(c.groupBy("segment").agg(F.count("*").alias("customers")).withColumn("run_number", F.lit(1)), path)
    second = c.where("c_acctbal > 0").groupBy("segment").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return sinks.append_evolving(rounded(second, "balance", 2).withColumn("run_number", F.lit(2)), path)


# ---- merges: a keyed target and a keyed source out of `customer` -------------------------------------------------
_TARGET = """SELECT c_custkey AS id, c_acctbal AS rate, CASE c_custkey % 3 WHEN 0 THEN 'CALIBRATED' WHEN 1 THEN 'ASSUMED' ELSE NULL END AS status,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS note, CAST(c_nationkey AS INT) AS runs FROM {customer} WHERE c_custkey % 4 <> 0"""
_SOURCE = """SELECT c_custkey AS id, c_acctbal * 2 AS rate, CASE WHEN c_custkey % 6 < 4 THEN 'calibrate' WHEN c_custkey % 6 = 4 THEN 'calibrate (low CPU)' ELSE 'keep: few runs' END AS action,
 CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE CAST(c_nationkey + 1 AS INT) END AS runs, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'pattern' END AS note FROM {customer} WHERE c_custkey % 7 <> 1"""
CTES["merge_target"], CTES["merge_source"] = _TARGET.format(customer="customer"), _SOURCE.format(customer="customer")


def _pair(i):
    c = inputs.read_table(i.spark, i.sf_dir, "customer")
    return i.spark.sql(_TARGET, customer=c), i.spark.sql(_SOURCE, customer=c)


def _merged(i, target, source, merge):
    """A table of several files by ranges of the id, merged file by file."""
    path = sinks.shared_folder(i.spark)
    target.repartitionByRange(4, "id").write.parquet(path)
    return mg.by_file(path, source, "id", merge)


@query("mrg_conditional_upsert", f"""SELECT coalesce(t.id, s.id) AS id, {rn("CASE WHEN t.id IS NULL OR s.id IS NOT NULL AND coalesce(t.status, 'ASSUMED') = 'ASSUMED' THEN s.rate ELSE t.rate END", 4)} AS rate,
 CASE WHEN t.id IS NULL OR s.id IS NOT NULL AND coalesce(t.status, 'ASSUMED') = 'ASSUMED' THEN 'ASSUMED' ELSE t.status END AS status, t.note, CASE WHEN t.id IS NULL THEN 0 ELSE t.runs END AS runs
 FROM merge_target t FULL JOIN merge_source s ON t.id = s.id""")
def conditional_upsert(i):
    t, s = _pair(i)
    d = _merged(i, t, s, lambda t, s: mg.conditional_upsert(t, s, "id", F.coalesce("status", F.lit("ASSUMED")) == "ASSUMED", {"rate": F.col("s_rate"), "status": F.lit("ASSUMED")},
                                                            {"rate": F.col("s_rate"), "status": F.lit("ASSUMED"), "runs": F.lit(0)}))
    return rounded(d, "rate", 4)


@query("mrg_insert_missing", """SELECT id, status, runs FROM merge_target UNION ALL SELECT id, 'DEFAULT', 100 FROM merge_source WHERE id NOT IN (SELECT id FROM merge_target)""")
def insert_missing(i):
    t, s = _pair(i)
    return mg.insert_missing(t.select("id", "status", "runs"), s.select("id", F.lit("DEFAULT").alias("status"), F.lit(100).alias("runs")), "id")


@query("mrg_apply_calibration", f"""SELECT t.id, {rn('CASE WHEN s.id IS NOT NULL THEN greatest(s.rate, 1000) ELSE t.rate END', 4)} AS rate, CASE WHEN s.id IS NOT NULL THEN 'CALIBRATED' ELSE t.status END AS status,
 CASE WHEN s.id IS NOT NULL THEN 'from ' || CAST(s.runs AS VARCHAR) || ' runs' ELSE t.note END AS note, CASE WHEN s.id IS NOT NULL THEN s.runs ELSE t.runs END AS runs
 FROM merge_target t LEFT JOIN (SELECT * FROM merge_source WHERE action LIKE 'calibrate%' AND rate > 0) s ON s.id = t.id""")
def apply_calibration(i):
    t, s = _pair(i)
    d = _merged(i, t, s.where("action LIKE 'calibrate%' AND rate > 0"), lambda t, s: mg.update_matched(t, s, "id", {
        "rate": F.greatest("s_rate", F.lit(1000.0)), "status": F.lit("CALIBRATED"), "runs": F.col("s_runs"),
        "note": F.concat(F.lit("from "), F.col("s_runs").cast("string"), F.lit(" runs"))}))
    return rounded(d, "rate", 4)


@query("mrg_policy_limits", """SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN coalesce(nullif(s.runs, -1), 100) WHEN s.id IS NOT NULL THEN coalesce(nullif(s.runs, -1), t.runs) ELSE t.runs END AS runs,
 CASE WHEN s.id IS NOT NULL THEN nullif(s.note, '') ELSE t.note END AS note FROM (SELECT id, runs, note FROM merge_target) t FULL JOIN merge_source s ON s.id = t.id""")
def policy_limits(i):
    t, s = _pair(i)
    limit, note = F.nullif("s_runs", F.lit(-1)), F.nullif("s_note", F.lit(""))
    return _merged(i, t.select("id", "runs", "note"), s, lambda t, s: mg.conditional_upsert(t, s, "id", F.lit(True), {"runs": F.coalesce(limit, "runs"), "note": note},
                                                                                            {"runs": F.coalesce(limit, F.lit(100)), "note": note}))


@query("mrg_replace_keys", f"SELECT id, {rn('rate', 4)} AS rate, runs FROM merge_target WHERE id NOT IN (SELECT id FROM merge_source) UNION ALL SELECT id, {rn('rate', 4)}, runs FROM merge_source")
def replace_keys(i):
    t, s = _pair(i)
    return rounded(_merged(i, t.select("id", "rate", "runs"), s.select("id", "rate", "runs"), lambda t, s: mg.replace_keys(t, s, "id")), "rate", 4)


@query("so_union_many", """SELECT id, runs, status, CAST(NULL AS VARCHAR) AS action FROM merge_target UNION ALL SELECT id, runs, NULL, action FROM merge_source UNION ALL SELECT id, NULL, status, NULL FROM merge_target WHERE runs > 20""")
def union_many(i):
    t, s = _pair(i)
    return readers.union_many(i.spark, [t.select("id", "runs", "status"), s.select("id", "runs", "action"), t.where("runs > 20").select("id", "status")], "id long")


