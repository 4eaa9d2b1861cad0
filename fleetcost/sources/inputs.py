"""Workload, request and history inputs derived from the driver tables.

Each input is one SELECT in the SQL subset that Spark and the checking engine share, so both sides start from the
same rows. Nothing here is an operator: it only gives each table row the columns an operator needs, including planted
gaps (unknown keys, NULLs, zeroes, mixed case, duplicate prices). Cloud, region and similar values come from the row's
keys, so every input grows with its table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01"          # planning date of price and run windows over `events`
PRICE_AS_OF = "2000-01-01"    # planning date of the price log over `lineitem`
USAGE_AS_OF = "2001-12-31"    # end of the usage window over `lineitem`

_CLOUD = "CASE {k} % 4 WHEN 0 THEN 'AWS' WHEN 1 THEN 'azure' WHEN 2 THEN 'GCP' ELSE 'aws' END"
_REGION = """CASE WHEN {k} % 4 = 1 THEN CASE WHEN {m} % 3 = 0 THEN 'WestEurope' ELSE 'eastus' END
     WHEN {k} % 4 = 2 THEN CASE WHEN {m} % 5 = 0 THEN 'nowhere-1' ELSE 'us-central1' END
     ELSE CASE WHEN {m} % 3 = 0 THEN 'EU-west-1' ELSE 'us-east-1' END END"""
_TIER = "CASE WHEN {m} % 2 = 0 THEN 'PREMIUM' ELSE 'enterprise' END"
_NODE = """CASE WHEN {k} % 4 = 1 THEN CASE {m} % 3 WHEN 0 THEN 'Standard_DS3_v2' WHEN 1 THEN 'standard_e8s_v3' ELSE 'Standard_F8s_v2' END
     WHEN {k} % 4 = 2 THEN CASE {m} % 3 WHEN 0 THEN 'n2-highmem-4' WHEN 1 THEN 'c2-standard-8' ELSE 'missing-9' END
     ELSE CASE {m} % 4 WHEN 0 THEN 'm5d.xlarge' WHEN 1 THEN 'R5D.2xlarge' WHEN 2 THEN 'c5d.4xlarge' ELSE 'x9.none' END END"""


def _geo(k: str, m: str) -> str:
    f = {"k": k, "m": m}
    return (f"{_CLOUD.format(**f)} AS cloud, {_REGION.format(**f)} AS region, {_TIER.format(**f)} AS tier")


def _node(k: str, m: str) -> str:
    return _NODE.format(k=k, m=m)


SQL: dict[str, str] = {
    # one workload per order
    "fleet": f"""
SELECT o_orderkey AS workload_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'JOBS' WHEN 1 THEN 'all_purpose' WHEN 2 THEN 'DLT' WHEN 3 THEN 'DBSQL' WHEN 4 THEN 'VECTOR_SEARCH'
    WHEN 5 THEN 'MODEL_SERVING' WHEN 6 THEN 'LAKEBASE' ELSE 'Other' END AS kind,
  {_geo('o_orderkey', 'o_custkey')},
  {_node('o_orderkey', '(o_custkey + 1)')} AS driver_node,
  {_node('o_orderkey', 'o_custkey')} AS worker_node,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS INT) END AS num_workers,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS photon,
  o_orderkey % 5 = 0 AS serverless,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'core' WHEN 2 THEN 'PRO' ELSE 'Advanced' END AS edition,
  CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'standard' ELSE 'Performance' END AS serverless_mode,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS runs_per_day,
  CAST(5 + o_orderkey % 115 AS INT) AS runtime_minutes,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 22 ELSE 30 END AS days_per_month,
  CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey % 400 AS DOUBLE) ELSE NULL END AS hours_per_month,
  CASE o_custkey % 5 WHEN 0 THEN 'classic' WHEN 1 THEN 'PRO' WHEN 2 THEN 'Serverless' WHEN 3 THEN 'pro' ELSE 'starter' END AS warehouse_type,
  CASE o_orderkey % 5 WHEN 0 THEN 'X-Small' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'medium' WHEN 3 THEN 'Large' ELSE 'Mega' END AS warehouse_size,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS INT) END AS num_clusters,
  CASE o_custkey % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'STORAGE_OPTIMIZED' ELSE 'none' END AS vector_mode,
  CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE CAST(o_custkey % 500 AS DOUBLE) / 4 END AS capacity_millions,
  CASE o_custkey % 4 WHEN 0 THEN 'cpu' WHEN 1 THEN 'GPU_small' WHEN 2 THEN 'gpu_large' ELSE NULL END AS serving_size,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST(o_custkey % 6 AS INT) END AS concurrency,
  CAST(o_custkey % 16 AS INT) AS capacity_units,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS INT) END AS ha_nodes,
  CASE o_custkey % 3 WHEN 0 THEN 'LARGE' WHEN 1 THEN 'medium' ELSE NULL END AS app_size,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 5 AS INT) END AS num_apps,
  CASE WHEN o_custkey % 2 = 0 THEN 'google' ELSE 'ACME' END AS provider,
  CASE WHEN o_custkey % 2 = 0 THEN 'GEM-a' ELSE 'acme-1' END AS proprietary_model,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Global' WHEN 2 THEN 'in_geo' ELSE 'global' END AS endpoint_type,
  CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ALL' WHEN 2 THEN 'long' ELSE 'all' END AS context_length,
  CASE o_orderkey % 4 WHEN 0 THEN 'input_token' WHEN 1 THEN 'Output_token' WHEN 2 THEN 'provisioned' ELSE 'batch_inference' END AS rate_type,
  CASE o_custkey % 3 WHEN 0 THEN 'Small-Chat' WHEN 1 THEN 'embedder' ELSE 'unknown-model' END AS hosted_model,
  CAST((o_orderkey % 1000) * 100000 AS BIGINT) AS quantity
FROM {{orders}}""",
    # text corpora grouped into volumes
    "document_volume": f"""
SELECT lang, source, {_geo('(length(lang) + length(source))', 'count(*)')}, count(*) AS num_docs,
  CAST(sum(n_chars) AS BIGINT) AS chars, CAST(floor(CAST(sum(n_chars) AS DOUBLE) / 4) AS BIGINT) AS tokens
FROM {{documents}} GROUP BY lang, source""",
    "turn_volume": f"""
SELECT role, turn % 10 AS turn_group, {_geo('(turn % 10)', 'length(role)')}, count(*) AS num_docs,
  CAST(sum(floor(CAST(length(text) AS DOUBLE) / 4)) AS BIGINT) AS tokens
FROM {{conversations}} GROUP BY role, turn % 10""",
    "page_volume": f"""
SELECT page_id % 24 AS site, {_geo('(page_id % 24)', '(page_id % 24)')}, count(*) AS num_pages,
  CAST(sum(length(html)) AS BIGINT) AS chars
FROM {{pages}} GROUP BY page_id % 24""",
    "vector_volume": f"""
SELECT label, {_geo('label', 'label')}, count(*) AS num_vectors FROM {{embeddings}} GROUP BY label""",
    # price universe and effective-dated price log
    "price_universe": """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Azure' ELSE 'gcp' END AS cloud,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-1' END
    WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'eastus' ELSE 'WestEurope' END
    ELSE CASE WHEN p_size % 2 = 0 THEN 'us-central1' WHEN p_size % 9 = 0 THEN NULL ELSE 'europe-west4' END END AS region,
  CASE WHEN p_size % 3 = 0 THEN 'Premium' ELSE 'ENTERPRISE' END AS tier,
  'product_' || CAST(p_partkey % 40 AS STRING) AS sku_name, p_type AS product_type, p_retailprice / 1000 AS price_per_dbu
FROM {part}""",
    "price_log": """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'PREMIUM' ELSE 'Enterprise' END || '_PRODUCT_' || CAST(l_partkey % 40 AS STRING)
    || CASE WHEN l_partkey % 40 >= 25 OR l_orderkey % 3 = 0 AND l_partkey % 40 >= 20 THEN ''
       ELSE CASE l_suppkey % 3 WHEN 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN '_US_EAST_A' ELSE '_EU_WEST_A' END
                               WHEN 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN '_us_east_b' ELSE '_EU_WEST_B' END
                               ELSE '_US_CENTRAL_C' END END AS sku_name,
  CASE l_suppkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'AZURE' ELSE 'GCP' END AS cloud,
  CASE WHEN l_partkey % 53 = 0 THEN 'EUR' ELSE 'USD' END AS currency_code,
  CASE WHEN l_partkey % 40 = 39 THEN 'GB_MONTH' ELSE 'DBU' END AS usage_unit,
  l_shipdate AS price_start_time,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 40 = 17 THEN l_shipdate
       ELSE l_shipdate + INTERVAL '1' DAY * CAST(60 * l_linenumber AS INT) END AS price_end_time,
  CAST(10 + l_partkey % 40 + CASE WHEN l_partkey % 5 = 0 THEN l_orderkey % 3 ELSE 0 END AS DOUBLE) / 100 AS list_default,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(9 + l_partkey % 40 AS DOUBLE) / 100 END AS effective_default
FROM {lineitem}""",
    # account price log whose SKU names are those of the rate card, or their regional billing names
    "account_price_log": """
SELECT CASE WHEN l_orderkey % 2 = 0
    THEN CASE l_suppkey % 6 WHEN 0 THEN 'ENTERPRISE_JOBS_SERVERLESS' WHEN 1 THEN 'sql_pro' WHEN 2 THEN 'ENTERPRISE_ALL_PURPOSE_COMPUTE'
      WHEN 3 THEN 'ENTERPRISE_OLD_SKU' WHEN 4 THEN 'ENTERPRISE_RETIRED' ELSE 'ENTERPRISE_OTHER' END
    ELSE CASE l_suppkey % 6 WHEN 0 THEN 'ENTERPRISE_JOBS_SERVERLESS_COMPUTE' WHEN 1 THEN 'enterprise_sql_pro_compute'
      WHEN 2 THEN 'ENTERPRISE_ALL_PURPOSE_COMPUTE' WHEN 3 THEN 'ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE'
      WHEN 4 THEN 'ENTERPRISE_RETIRED' ELSE 'ENTERPRISE_OTHER' END || '_US_EAST_A' END AS sku_name,
  CASE WHEN l_linenumber = 6 THEN 'GCP' ELSE 'aws' END AS cloud, 'USD' AS currency_code, 'DBU' AS usage_unit,
  l_shipdate AS price_start_time,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate + INTERVAL '1' DAY * CAST(30 * l_linenumber AS INT) END AS price_end_time,
  CASE l_suppkey % 6 WHEN 0 THEN CAST(33 AS DOUBLE) / 100 WHEN 1 THEN CAST(44 AS DOUBLE) / 100 WHEN 2 THEN CAST(50 + l_linenumber % 3 AS DOUBLE) / 100
    ELSE CAST(8 AS DOUBLE) / 100 END AS list_default,
  CASE WHEN l_suppkey % 6 = 3 THEN CAST(7 AS DOUBLE) / 100 ELSE NULL END AS effective_default
FROM {lineitem}""",
    # rate questions: one exact key per line; model questions: one per order
    "rate_questions": """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'PLATFORM' ELSE 'cloud' END AS provider,
  CASE l_suppkey % 10 WHEN 0 THEN 'ENTERPRISE_JOBS_SERVERLESS' WHEN 1 THEN 'datasync-bytes' WHEN 2 THEN 'sql_pro' WHEN 3 THEN 'TimedStorage-ByteHrs'
    WHEN 4 THEN 'ENTERPRISE_ALL_PURPOSE_COMPUTE' WHEN 5 THEN 'KMS-Keys' WHEN 6 THEN 'ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE' WHEN 7 THEN 'Requests-Tier1'
    WHEN 8 THEN 'ENTERPRISE_OLD_SKU' ELSE 'No-Such' END AS sku,
  CASE l_suppkey % 10 WHEN 1 THEN 'GB' WHEN 3 THEN 'gb_month' WHEN 5 THEN 'KEY_MONTH' WHEN 7 THEN 'REQUEST_1000' ELSE 'DBU' END AS unit,
  CASE WHEN l_linenumber % 3 = 0 THEN 'AP_SOUTH_1' ELSE 'us_east_1' END AS region, l_quantity AS quantity
FROM {lineitem}""",
    "model_questions": """
SELECT o_orderkey, CASE o_custkey % 7 WHEN 0 THEN 'nano-chat' WHEN 1 THEN 'embed-large' WHEN 2 THEN 'pro-chat' WHEN 3 THEN 'draft-chat' WHEN 4 THEN 'half-chat'
  WHEN 5 THEN 'Nano-Chat' ELSE 'none' END AS model, CASE WHEN o_orderkey % 9 = 0 THEN 'PROVISIONED' ELSE 'PAY_PER_TOKEN' END AS serving_mode
FROM {orders}""",
    # usage log with the SKU and unit of each line
    "usage_log": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, CAST(l_shipdate AS DATE) AS usage_date, l_shipdate AS usage_start_time,
  l_shipdate + INTERVAL '1' MINUTE * CAST(floor(CASE WHEN l_suppkey % 3 = 0 THEN l_quantity * 60 ELSE l_quantity * 6 END) AS INT) AS usage_end_time,
  CASE WHEN l_suppkey % 3 = 2 THEN 'PREMIUM_SQL_PRO_COMPUTE' WHEN l_returnflag = 'R' THEN 'PREMIUM_JOBS_COMPUTE' ELSE 'premium_jobs_serverless_compute' END AS sku_name,
  CASE WHEN l_linenumber = 5 THEN 'GCP' ELSE 'AWS' END AS cloud, CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'GB' ELSE 'DBU' END AS usage_unit,
  l_quantity AS usage_quantity,
  CASE l_suppkey % 3 WHEN 0 THEN 'job-' || CAST(l_suppkey AS STRING) ELSE NULL END AS job_id,
  CASE l_suppkey % 3 WHEN 1 THEN 'cluster-' || CAST(l_partkey AS STRING) ELSE NULL END AS cluster_id,
  CASE l_suppkey % 3 WHEN 2 THEN 'wh-' || CAST(l_suppkey AS STRING) ELSE NULL END AS warehouse_id
FROM {lineitem}""",
    # sizing requests
    "sizing_requests": f"""
SELECT c_custkey AS request_id,
  CASE c_custkey % 11 WHEN 0 THEN 'INGESTION' WHEN 1 THEN ' auto loader' WHEN 2 THEN 'ETL' WHEN 3 THEN 'batch-etl' WHEN 4 THEN 'streaming'
    WHEN 5 THEN 'Kafka' WHEN 6 THEN 'ML_TRAINING' WHEN 7 THEN 'scoring' WHEN 8 THEN 'NULL' WHEN 9 THEN 'mystery' ELSE 'gold' END AS workload,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_acctbal / CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 20 END END AS data_gb,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS INT) END AS runs_per_day,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(3 + c_custkey % 120 AS INT) END AS window_minutes,
  CASE c_custkey % 6 WHEN 0 THEN 'AWS' WHEN 1 THEN ' azure' WHEN 2 THEN 'n/a' WHEN 3 THEN 'gcp' WHEN 4 THEN NULL ELSE 'aws' END AS cloud,
  CASE WHEN c_custkey % 13 = 0 THEN 'M5D.4xlarge' WHEN c_custkey % 17 = 0 THEN 'no.such' WHEN c_custkey % 19 = 0 THEN 'none' ELSE NULL END AS node_type,
  CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 40 AS INT) ELSE NULL END AS max_workers,
  CASE WHEN c_custkey % 6 = 1 THEN CASE WHEN c_custkey % 4 = 0 THEN 'eastus' ELSE 'NULL' END
       WHEN c_custkey % 6 = 3 THEN CASE WHEN c_custkey % 4 = 0 THEN 'us-central1' ELSE NULL END
       ELSE CASE c_custkey % 4 WHEN 0 THEN 'US-east-1' WHEN 1 THEN 'eu-west-1' WHEN 2 THEN NULL ELSE 'moon-1' END END AS region,
  CASE WHEN c_nationkey % 2 = 0 THEN 'PREMIUM' ELSE NULL END AS tier,
  CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS photon,
  CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 4 + c_nationkey END AS days_per_month
FROM {{customer}}""",
    # estimate requests, flat: one per customer; plans.requests.assemble nests the sections
    "request_wide": """
SELECT k AS request_id, 'UC-' || CAST(k AS STRING) AS use_case_id, 'Workload ' || CAST(k % 40 AS STRING) || ' of ' || CAST(k AS STRING) AS use_case_name,
  CASE k % 4 WHEN 0 THEN 'LOW,EXPECTED,HIGH' WHEN 1 THEN 'LOW,EXPECTED,HIGH,STRESS' WHEN 2 THEN 'EXPECTED' ELSE 'HIGH,STRESS' END AS scenario_list,
  CASE WHEN k % 23 = 0 THEN 'EU_WEST_1' ELSE 'US_EAST_1' END AS region, CASE WHEN k % 2 = 0 THEN 30 ELSE 22 END AS model_days, k % 3 <> 0 AS calibration_allowed,
  CASE WHEN k % 9 = 0 THEN CAST(2 AS DOUBLE) ELSE NULL END AS ov_batch, CASE WHEN k % 10 = 0 THEN 5 ELSE NULL END AS ov_band, CASE WHEN k % 8 = 0 THEN CAST(3 AS DOUBLE) ELSE NULL END AS ov_sql_high,
  k % 5 <> 4 AS p1, 'UC-' || CAST(k AS STRING) || '-C01' AS p1_id, 'Main load' AS p1_name,
  CASE k % 5 WHEN 0 THEN 'CONTINUOUS_STREAMING' WHEN 1 THEN 'SCHEDULED_BATCH' WHEN 2 THEN 'EVENT_DRIVEN_BATCH' ELSE CASE WHEN k % 2 = 0 THEN 'ML_TRAINING' ELSE 'BATCH_SCORING' END END AS p1_type,
  CAST(1 + k % 2 AS INT) AS p1_quantity, CASE k % 4 WHEN 0 THEN 'CONTINUOUS' WHEN 1 THEN 'SCHEDULED' WHEN 2 THEN 'TBD' ELSE 'AS_NEEDED' END AS p1_pattern,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1 + k % 5 AS DOUBLE) / 4 END AS p1_low, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(2 + k % 5 AS DOUBLE) / 4 END AS p1_expected,
  CAST(4 + k % 7 AS DOUBLE) / 4 AS p1_high, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(k % 31 AS DOUBLE) END AS p1_runs,
  CASE WHEN k % 6 = 0 THEN CAST(3 AS DOUBLE) / 4 ELSE NULL END AS p1_fix_expected, CASE WHEN k % 6 = 0 THEN CAST(5 AS DOUBLE) / 4 ELSE NULL END AS p1_fix_high,
  CASE WHEN k % 12 = 6 THEN 'MEASURED' ELSE '' END AS p1_fix_basis, CASE WHEN k % 12 = 0 THEN 'CONFIRMED' ELSE 'PLANNING_ASSUMPTION' END AS p1_fix_evidence,
  k % 14 = 3 AS p1_gpu, k % 12 = 5 AS p1_custom_runtime, k % 18 = 7 AS p1_custom_network, k % 10 = 1 AS p1_declarative,
  CASE WHEN k % 15 = 0 THEN 'TRUE_CONTINUOUS_LOW_LATENCY' WHEN k % 15 = 5 THEN 'INCREMENTAL_AVAILABLE_NOW' ELSE 'UNCONFIRMED' END AS p1_mode,
  CASE WHEN k % 40 = 10 THEN 'SECONDS' WHEN k % 40 = 20 THEN 'MINUTES_OR_MORE' ELSE 'UNCONFIRMED' END AS p1_latency,
  k % 3 = 0 AS p2, 'UC-' || CAST(k AS STRING) || '-C02' AS p2_id, 'Nightly job' AS p2_name, 'SCHEDULED_BATCH' AS p2_type, CAST(30 AS DOUBLE) AS p2_runs,
  k % 2 = 0 AS s1, 'UC-' || CAST(k AS STRING) || '-SQL' AS s1_id, CAST(1 + k % 37 AS INT) AS s1_users, CASE WHEN k % 4 = 0 THEN 22 ELSE 20 END AS s1_days,
  k % 3 <> 1 AS t1, CASE WHEN k % 9 = 2 THEN NULL ELSE CAST(k % 10 AS DOUBLE) END AS t1_low, CASE WHEN k % 12 = 3 THEN NULL ELSE CAST(1 + k % 10 AS DOUBLE) END AS t1_expected,
  CAST(5 + k % 10 AS DOUBLE) AS t1_high, CASE WHEN k % 6 = 0 THEN 30 ELSE 22 END AS t1_days, CASE WHEN k % 4 = 2 THEN NULL ELSE CAST(k * 10 AS DOUBLE) END AS t1_initial,
  k % 4 <> 1 AS st, CASE WHEN k % 11 = 5 THEN NULL ELSE CAST(k % 20 AS DOUBLE) / 2 END AS st_tb, CASE WHEN k % 17 = 3 THEN NULL ELSE CAST(10 * (k % 30) AS DOUBLE) END AS st_files,
  CAST(10 * (k % 3) AS DOUBLE) AS st_encrypted, CAST(k % 2 AS DOUBLE) AS st_keys, CASE WHEN k % 26 = 4 THEN NULL ELSE CAST(1 AS DOUBLE) END AS st_writes,
  CASE WHEN k % 8 < 4 THEN NULL ELSE CAST(k % 8 - 3 AS DOUBLE) END AS st_reads, CASE WHEN k % 22 = 8 THEN NULL ELSE CAST(1 AS DOUBLE) END AS st_kms, k % 5 = 0 AS st_confirmed,
  k % 3 = 2 AS e1, 'UC-' || CAST(k AS STRING) || '-M01' AS e1_id, CASE k % 6 WHEN 0 THEN 'nano-chat' WHEN 1 THEN 'draft-chat' WHEN 2 THEN 'pro-chat' WHEN 3 THEN 'half-chat' WHEN 4 THEN 'none' ELSE 'embed-large' END AS e1_model,
  CAST(10 + k % 100 AS DOUBLE) AS e1_calls, CASE WHEN k % 14 = 2 THEN NULL ELSE CAST(100 * (k % 9) AS DOUBLE) END AS e1_in_low, CASE WHEN k % 4 = 0 THEN CAST(777 AS DOUBLE) ELSE NULL END AS e1_in_expected,
  CAST(1000 + k AS DOUBLE) AS e1_in_high, CAST(10 * (k % 9) AS DOUBLE) AS e1_out_low, CASE WHEN k % 8 = 0 THEN CAST(55 AS DOUBLE) ELSE NULL END AS e1_out_expected,
  CASE WHEN k % 16 = 5 THEN NULL ELSE CAST(100 + k % 50 AS DOUBLE) END AS e1_out_high, CASE WHEN k % 21 = 2 THEN 'PROVISIONED' ELSE 'PAY_PER_TOKEN' END AS e1_mode,
  k % 7 = 3 AS j1, 'UC-' || CAST(k AS STRING) || '-J01' AS j1_id, CASE WHEN k % 2 = 0 THEN 'embed-large' ELSE 'pro-chat' END AS j1_model, CAST(100000 * (k % 50) AS DOUBLE) AS j1_in_low,
  CASE WHEN k % 14 = 10 THEN NULL ELSE CAST(200000 * (1 + k % 50) AS DOUBLE) END AS j1_in_high, CAST(0 AS DOUBLE) AS j1_out_low, CAST(1000 * (k % 50) AS DOUBLE) AS j1_out_high,
  CASE k % 5 WHEN 0 THEN 'EXCLUDED' WHEN 1 THEN 'unknown' WHEN 2 THEN 'NOT_APPLICABLE' ELSE NULL END AS area_transfer, CASE k % 3 WHEN 0 THEN 'excluded' ELSE NULL END AS area_sql
FROM (SELECT *, c_custkey AS k FROM {customer})""",
    # request documents as text, with the planted faults of the input check; one per customer
    "raw_requests": """
SELECT k AS request_id, CASE k % 16 WHEN 0 THEN '{{"use_case_id": "UC-' WHEN 1 THEN '[1, 2]' WHEN 8 THEN head || ', "processing": [], "sql": null}}'
  ELSE head || ', "_areas": ' || CASE k % 16 WHEN 10 THEN '{{"processing": "EXCLUDED", "sql": "MAYBE", "moon": "INCLUDED", "transfer": "included"}}'
      WHEN 14 THEN '"none"' ELSE '{{"sql": "NOT_APPLICABLE", "storage": "excluded", "model_endpoints": "UNKNOWN", "one_time_model_jobs": "NOT_APPLICABLE", "transfer": "NOT_APPLICABLE"}}' END
    || CASE k % 16
      WHEN 2 THEN ', "processing": [{{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3, "runs_per_month": 30}}]'
      WHEN 3 THEN ', "processing": [{{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3}}]'
      WHEN 4 THEN ', "processing": [{{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3, "runs_per_month": "30"}}]'
      WHEN 5 THEN ', "processing": [{{' || job || ', "runtime_hours_expected": -2, "runs_per_month": ' || CAST(k % 9 - 4 AS STRING) || '}}]'
      WHEN 6 THEN ', "processing": [{{' || job || ', "runtime_hours_expected": 2, "runs_per_mnth": 30, "_comment": 1}}], "regoin": "X"'
      WHEN 7 THEN ', "model_endpoints": [{{"component_id": "M1", "model": "gone-chat", "role": "Answer", "calls_per_day": 5, "input_tokens_expected": 10}}, {{"component_id": "M2", "model": "pro-chat", "role": "Answer", "calls_per_day": 5, "serving_mode": "PROVISIONED", "input_tokens_low": 1, "input_tokens_high": 2, "output_tokens_expected": 3}}]'
      WHEN 9 THEN ', "processing": [{{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3, "runs_per_month": 30}}, {{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3, "runs_per_month": 30}}]'
      WHEN 10 THEN ', "processing": [{{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3, "runs_per_month": 30}}]'
      WHEN 11 THEN ', "processing": [{{"component_id": 7, "name": 5, "workload_type": "CONTINUOUS_STREAMING", "quantity": 1.5, "requires_gpu": "yes", "dbu_per_hour": {{"LOW": "x"}}}}, 3], "calibration_allowed": 1, "sql": [1]'
      WHEN 12 THEN ', "processing": [{{"component_id": "C01", "name": "Load", "workload_type": "HOURLY", "streaming_mode": "FAST", "quantity": 0}}], "scenarios": ["LOW", "MID"]'
      WHEN 13 THEN ', "processing": [{{' || job || ', "runtime_hours_expected": 2, "runs_per_month": 10}}]'
      WHEN 14 THEN ', "assumptions": {{"batch_dbu_per_hour": -1, "sql_users_per_capacity_band": 0, "sql_active_hours_per_day": {{"HIGH": 3, "NOON": 1}}, "sql_concurrency_factor": 2, "continuous_hours_per_month": {{"LOW": 1}}, "extra": 1}}, "processing": [{{' || job || ', "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 3, "runs_per_month": 30}}]'
      ELSE ', "storage": {{"retained_tb": 2, "encrypted_files_per_day": 3, "kms_requests_per_encrypted_file": null, "s3_write_requests_per_file": null}}, "sql": {{"component_id": "S1", "name": "Reports", "concurrent_users": 0}}, "transfer": {{"daily_gb_low": 1}}, "one_time_model_jobs": [{{"component_id": "J1", "model": "embed-large", "description": "Index", "input_tokens_low": 5}}]' END || '}}' END AS request_json
FROM (SELECT c_custkey AS k, '{{"use_case_id": "UC-' || CAST(c_custkey AS STRING) || '", "use_case_name": "Check ' || CAST(c_custkey AS STRING) || '"' AS head,
  '"component_id": "C01", "name": "Load", "workload_type": "SCHEDULED_BATCH", "pattern": "SCHEDULED"' AS job FROM {customer})""",
    # figures that were presented for the template requests: worked out by hand, some missing, some off, some of scenarios never calculated
    "presented_figures": """
SELECT request_id, scenario, CASE WHEN request_id % 5 = 0 THEN NULL WHEN request_id % 5 = 1 THEN figure + 5 ELSE figure END AS presented
FROM (SELECT c_custkey AS request_id, 'EXPECTED' AS scenario, CASE WHEN c_custkey % 2 = 0 THEN CAST(30643 AS DOUBLE) / 100 + c_custkey % 9 * 25 - CAST(2 AS DOUBLE) / 100 ELSE CAST(8064 AS DOUBLE) / 100 END AS figure FROM {customer}
  UNION ALL SELECT c_custkey, 'HIGH', CASE WHEN c_custkey % 2 = 0 THEN CAST(49858 AS DOUBLE) / 100 + c_custkey % 9 * 25 ELSE CAST(14256 AS DOUBLE) / 100 END FROM {customer}
  UNION ALL SELECT c_custkey, 'STRESS', CASE WHEN c_custkey % 2 = 0 THEN CAST(92521 AS DOUBLE) / 100 + c_custkey % 9 * 25 ELSE NULL END FROM {customer}) f""",
    # cluster policy documents, one per supplier
    "policy_documents": """
SELECT s_suppkey AS policy_id, CASE s_suppkey % 4 WHEN 0 THEN 'AWS' WHEN 1 THEN 'AZURE' WHEN 2 THEN 'GCP' ELSE 'OTHER' END AS cloud, s_name AS policy_name,
  '{{' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '"num_workers": {{"type": "range", "maxValue": ' || CAST(5 + s_suppkey % 60 AS STRING) || '}}, ' END
  || CASE WHEN s_suppkey % 3 = 0 THEN '"autoscale.max_workers": {{"type": "fixed", "value": ' || CAST(s_suppkey % 50 AS STRING) || '}}, ' ELSE '' END
  || CASE s_suppkey % 4 WHEN 0 THEN '"node_type_id": {{"type": "allowlist", "values": ["m5d.xlarge", "c5d.xlarge"]}}'
      WHEN 1 THEN '"node_type_id": {{"type": "fixed", "value": "Standard_DS3_v2"}}' WHEN 2 THEN '"node_type_id": {{"type": "regex", "pattern": "n2.*"}}'
      ELSE '"spark_version": {{"type": "unlimited"}}' END || '}}' AS definition
FROM {supplier}""",
    # run, task, node, lineage, write and statement history
    "run_log": """
SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, 'j' || CAST(user_id AS STRING) AS job_id,
  'r' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id, 't' || CAST(event_id AS STRING) AS task_run_id,
  'c' || CAST(user_id AS STRING) AS cluster_id, 'c' || CAST(user_id + 1 AS STRING) AS cluster_id2,
  ts AS period_start_time, ts + INTERVAL '1' SECOND * CAST(120 + floor(value * 20) AS INT) AS period_end_time,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS result_state,
  'run_' || CASE user_id % 6 WHEN 0 THEN 'Raw_ingest' WHEN 1 THEN 'silver_etl' WHEN 2 THEN 'model_training' WHEN 3 THEN 'batch_scoring'
    WHEN 4 THEN 'Kafka_stream' ELSE 'misc' END AS run_name,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE 60 * (event_id % 7) END AS setup_duration_seconds,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(value * 20) AS BIGINT) END AS execution_duration_seconds,
  CASE WHEN user_id % 7 = 0 THEN 'SERVERLESS_COMPUTE' ELSE 'CLASSIC_COMPUTE' END AS compute_type
FROM {events}""",
    "job_versions": " UNION ALL ".join(f"""
SELECT 'j' || CAST(s_suppkey AS STRING) AS job_id, CASE WHEN s_suppkey % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, {v} AS version,
  CASE (s_suppkey + {v}) % 7 WHEN 0 THEN 'Bronze load' WHEN 1 THEN 'gold merge' WHEN 2 THEN 'Train model' WHEN 3 THEN 'predict daily'
    WHEN 4 THEN 'realtime feed' WHEN 5 THEN NULL ELSE 'adhoc' END AS name,
  CASE WHEN s_suppkey % 11 = 0 THEN 'etl' ELSE NULL END AS sizing_profile, TIMESTAMP '2023-12-0{v} 00:00:00' AS change_time
FROM {{supplier}}""" for v in (1, 2, 3)),
    "cluster_versions": " UNION ALL ".join(f"""
SELECT 'c' || CAST(s_suppkey AS STRING) AS cluster_id, CASE WHEN s_suppkey % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, {v} AS version,
  CASE WHEN (s_suppkey + {v}) % 9 = 0 THEN 'UI' ELSE 'JOB' END AS cluster_source, TIMESTAMP '2023-12-0{v} 00:00:00' AS change_time
FROM {{supplier}}""" for v in (1, 2)),
    "node_log": """
SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, 'c' || CAST(user_id AS STRING) AS cluster_id,
  'i' || CAST(event_id % 11 AS STRING) AS instance_id,
  CASE event_id % 4 WHEN 0 THEN 'n.small' WHEN 1 THEN 'n.medium' WHEN 2 THEN 'n.large' ELSE 'n.unknown' END AS node_type,
  event_id % 3 = 0 AS driver, ts - INTERVAL '1' SECOND * CAST(1800 AS INT) AS start_time, ts + INTERVAL '1' SECOND * CAST(5400 AS INT) AS end_time,
  value / 10 AS cpu_user_percent, value / 20 AS cpu_system_percent, value / 8 AS mem_used_percent,
  CAST(floor(value * 1000) AS BIGINT) * 100000 AS network_received_bytes
FROM {events}""",
    "lineage_log": """
SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id,
  'r' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS entity_run_id,
  CASE WHEN event_id % 8 = 0 THEN 'NOTEBOOK' ELSE 'JOB' END AS entity_type,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'tbl_' || event_type || '_' || CAST(user_id % 8 AS STRING) END AS target_table_full_name,
  CAST(ts AS DATE) AS event_date
FROM {events}""",
    "write_log": """
SELECT event_id, 'tbl_' || event_type || '_' || CAST(user_id % 8 AS STRING) AS table_name, user_id % 8 <> 5 AS readable,
  CASE event_id % 6 WHEN 0 THEN 'WRITE' WHEN 1 THEN 'MERGE' WHEN 2 THEN 'STREAMING UPDATE' WHEN 3 THEN 'OPTIMIZE' WHEN 4 THEN 'COPY INTO' ELSE 'UPDATE' END AS operation,
  ts + INTERVAL '1' SECOND * CAST(30 AS INT) AS write_time,
  CASE WHEN event_id % 10 = 7 THEN NULL ELSE 't' || CAST(event_id AS STRING) END AS job_task_id,
  CASE WHEN event_id % 3 = 0 OR event_id % 10 = 7 THEN NULL ELSE 'r' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) END AS job_run_ref,
  CASE event_id % 4 WHEN 0 THEN 'numOutputBytes' WHEN 1 THEN 'numTargetBytesAdded' WHEN 2 THEN 'numAddedBytes' ELSE 'numOther' END AS metric_key,
  CAST(floor(value * 100) AS BIGINT) * 1000000 AS metric_bytes
FROM {events}""",
    "run_usage_log": """
SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, CAST(ts AS DATE) AS usage_date, ts AS usage_start_time,
  CASE event_type WHEN 'click' THEN 'PREMIUM_JOBS_COMPUTE' WHEN 'view' THEN 'PREMIUM_JOBS_SERVERLESS_COMPUTE_US_EAST_A'
    WHEN 'error' THEN 'PREMIUM_UNPRICED' ELSE 'PREMIUM_SQL_COMPUTE' END AS sku_name,
  'AWS' AS cloud, CASE WHEN event_id % 13 = 0 THEN 'GB' ELSE 'DBU' END AS usage_unit, value / 10 AS usage_quantity,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'r' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) END AS job_run_id
FROM {events}""",
    "statement_log": """
SELECT event_id, CASE WHEN user_id % 10 = 9 THEN 'ws2' ELSE 'ws1' END AS workspace_id, 'u' || CAST(user_id AS STRING) AS executed_by,
  date_trunc('minute', ts) AS start_minute, ts AS start_time,
  CASE WHEN event_id % 21 = 0 THEN NULL ELSE ts + INTERVAL '1' SECOND * CAST(1 + floor(value * 30) AS INT) END AS end_time
FROM {events}""",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
           "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Derived input `name` over the tables under `sf_dir`. With `spread` the rows of the tables are dealt out evenly to as many tasks as a shuffle has partitions, for
    work that is long for each row: a table of a few MB is one split of a file. Only the columns that the input needs are moved, each row once."""
    text = SQL[name]
    dealt = (lambda t: t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))) if spread else (lambda t: t)
    used = {t: dealt(read_table(spark, sf_dir, t)) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def check_sql(name: str) -> str:
    """The same input as text over plainly named tables."""
    return SQL[name].format(**{t: t for t in _TABLES})
