"""Monthly cost of fleets and corpora (EST)."""
from fleetcost.catalog.lookups import HOSTED, PROPRIETARY, SERVERLESS, SERVING, VECTOR, WAREHOUSE, classic_sql
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.oracle import prices as px
from fleetcost.oracle.base import CTES, r2, rn
from fleetcost.plans import pricing as pr

_DOUBLES = "dbu_per_hour hours_per_month dbu_per_month dbu_price"


def cost_sql(src: str, keys: str, label: str, price: str, dbu: str = "0.0", hrs: str = "0.0", vm: str = "0.0", month: str | None = None) -> str:
    """The eight cost columns over rows that carry the given expressions."""
    m = month or "(b.dbu_ph * b.hrs)"
    return f"""SELECT {keys}, {label} AS workload, {rn('b.dbu_ph')} AS dbu_per_hour, {rn('b.hrs')} AS hours_per_month, {rn(m)} AS dbu_per_month,
 {rn('b.price')} AS dbu_price, {r2(m + ' * b.price')} AS dbu_cost_per_month, {r2('b.vm_ph * b.hrs')} AS vm_cost_per_month,
 {r2(m + ' * b.price + b.vm_ph * b.hrs')} AS total_cost_per_month
FROM (SELECT *, {dbu} AS dbu_ph, {hrs} AS hrs, {price} AS price, {vm} AS vm_ph FROM {src}) b"""


def _price(product: str) -> str:
    return px.price("fleet.cloud", "fleet.region", "fleet.tier", product)


def _classic(kind: str, edition: str, label: str) -> str:
    vm = f"({px.vm('fleet.cloud', 'fleet.region', 'driver_node')} + {px.vm('fleet.cloud', 'fleet.region', 'worker_node')} * coalesce(num_workers, 0))"
    return cost_sql("fleet", "workload_id", label, _price(px.product(f"'{kind}'", "false", "photon", edition, "NULL")),
                    classic_sql(f"'{kind}'", edition), px.hours(f"'{kind}'"), vm)


def _out(df, *keys):
    return rounded(df.select(*(keys or ("workload_id",)), *pr.COST_COLUMNS), _DOUBLES)


@query("est_jobs_classic", _classic("JOBS", "NULL", "'JOBS_CLASSIC'"))
def jobs_classic(i):
    return _out(pr.jobs_classic(i("fleet"), i.ref))


@query("est_interactive_classic", _classic("ALL_PURPOSE", "NULL", "'ALL_PURPOSE_CLASSIC'"))
def interactive_classic(i):
    return _out(pr.interactive_classic(i("fleet"), i.ref))


@query("est_pipeline_classic", _classic("DLT", "edition", "'DLT_' || upper(coalesce(edition, 'CORE'))"))
def pipeline_classic(i):
    return _out(pr.pipeline_classic(i("fleet"), i.ref))


_NONE = "CAST(NULL AS VARCHAR)"


@query("est_serverless", cost_sql("fleet", "workload_id", "upper(kind) || '_SERVERLESS'", _price(px.product("kind", "true", "true", _NONE, _NONE)),
                                  SERVERLESS, px.hours("kind")))
def serverless(i):
    return _out(pr.serverless(i("fleet"), i.ref))


_CONFIG = ("(SELECT min({c}) FROM ref_warehouse_config w WHERE upper(w.cloud) = upper(fleet.cloud) AND lower(w.warehouse_size) = lower(fleet.warehouse_type) "
           "AND upper(w.warehouse_type) = upper(fleet.warehouse_size))")
CTES["fleet_wh"] = f"SELECT *, {_CONFIG.format(c='driver_instance_type')} AS di, {_CONFIG.format(c='worker_instance_type')} AS wi, {_CONFIG.format(c='worker_count')} AS wc FROM fleet"
_WH_VM = (f"CASE WHEN lower(warehouse_type) = 'serverless' THEN 0.0 ELSE {px.vm('fleet_wh.cloud', 'fleet_wh.region', 'di')} * coalesce(num_clusters, 1) "
          f"+ {px.vm('fleet_wh.cloud', 'fleet_wh.region', 'wi')} * coalesce(wc, 0) * coalesce(num_clusters, 1) END")


WAREHOUSE_COST = cost_sql("fleet_wh", "workload_id", "'DBSQL_' || upper(warehouse_type)",
                          px.price("fleet_wh.cloud", "fleet_wh.region", "fleet_wh.tier", px.product("'DBSQL'", "false", "false", _NONE, "warehouse_type")),
                          WAREHOUSE.replace("fleet.", "fleet_wh."), px.hours("'DBSQL'", given="hours_per_month"), _WH_VM)


@query("est_warehouse", WAREHOUSE_COST)
def warehouse(i):
    return _out(pr.warehouse(i("fleet"), i.ref))


_MONTH = "24.0 * coalesce(days_per_month, 30)"
_INF = "'SERVERLESS_REAL_TIME_INFERENCE'"


CTES["fleet_vec"] = """SELECT CAST(label AS BIGINT) AS label, cloud, region, tier, 'standard' AS vector_mode, CAST(num_vectors AS DOUBLE) / 10 AS capacity_millions, 30 AS days_per_month
 FROM vector_volume"""


@query("est_vector_search", f"""SELECT * FROM ({cost_sql('fleet', 'workload_id AS id', "'VECTOR_SEARCH'", _price(_INF), VECTOR, _MONTH)})
 UNION ALL SELECT * FROM ({cost_sql('fleet_vec', 'label AS id', "'VECTOR_SEARCH'", px.price('fleet_vec.cloud', 'fleet_vec.region', 'fleet_vec.tier', _INF),
                                     VECTOR.replace('fleet.', 'fleet_vec.'), _MONTH)})""")
def vector_search(i):
    volume = i("vector_volume").select(
        F.col("label").cast("long").alias("id"), "cloud", "region", "tier", F.lit("standard").alias("vector_mode"),
        (F.col("num_vectors").cast("double") / 10).alias("capacity_millions"), F.lit(30).alias("days_per_month"))
    fleet = i("fleet").select(F.col("workload_id").alias("id"), "cloud", "region", "tier", "vector_mode", "capacity_millions", "days_per_month")
    return _out(pr.vector_search(fleet.unionByName(volume), i.ref), "id")


@query("est_model_serving", cost_sql("fleet", "workload_id", "'MODEL_SERVING'", _price(_INF), SERVING, _MONTH))
def model_serving(i):
    return _out(pr.model_serving(i("fleet"), i.ref))


@query("est_database", cost_sql("fleet", "workload_id", "'LAKEBASE'", _price("'DATABASE_SERVERLESS_COMPUTE'"),
                                "CAST(coalesce(capacity_units, 0) AS DOUBLE) * coalesce(ha_nodes, 1)", _MONTH))
def database(i):
    return _out(pr.database(i("fleet"), i.ref))


@query("est_apps", cost_sql("fleet", "workload_id", "'APPS'", _price("'ALL_PURPOSE_SERVERLESS_COMPUTE'"),
                            "(CASE WHEN lower(app_size) = 'large' THEN 1.0 ELSE 0.5 END) * coalesce(num_apps, 1)", "coalesce(hours_per_month, 730.0)"))
def apps(i):
    return _out(pr.apps(i("fleet"), i.ref))


CTES["fleet_tok"] = """SELECT workload_id, cloud, region, tier, hosted_model, rate_type, quantity FROM fleet
 UNION ALL SELECT turn_group * 100 + length(role), cloud, region, tier, 'small-chat', CASE WHEN role = 'user' THEN 'input_token' ELSE 'output_token' END, tokens FROM turn_volume
 UNION ALL SELECT length(lang) * 100000 + num_docs, cloud, region, tier, 'embedder', 'input_token', tokens FROM document_volume"""


@query("est_hosted_model", cost_sql("fleet_tok", "workload_id", "'FMAPI_HOSTED'", px.price("fleet_tok.cloud", "fleet_tok.region", "fleet_tok.tier", _INF),
                                    month=HOSTED.replace("fleet.", "b."), dbu="0.0"))
def hosted_model(i):
    cols = ["workload_id", "cloud", "region", "tier", "hosted_model", "rate_type", "quantity"]
    turns = i("turn_volume").select(
        (F.col("turn_group") * 100 + F.length("role")).alias("workload_id"), "cloud", "region", "tier", F.lit("small-chat").alias("hosted_model"),
        F.when(F.col("role") == "user", "input_token").otherwise("output_token").alias("rate_type"), F.col("tokens").alias("quantity"))
    docs = i("document_volume").select(
        (F.length("lang") * 100000 + F.col("num_docs")).alias("workload_id"), "cloud", "region", "tier", F.lit("embedder").alias("hosted_model"),
        F.lit("input_token").alias("rate_type"), F.col("tokens").alias("quantity"))
    return _out(pr.hosted_model(i("fleet").select(*cols).unionByName(turns).unionByName(docs), i.ref))


@query("est_proprietary_model", cost_sql("fleet", "workload_id", "'FMAPI_PROPRIETARY'",
                                         _price("CASE WHEN upper(provider) = 'GOOGLE' THEN 'GEMINI' ELSE upper(provider) END || '_MODEL_SERVING'"),
                                         month=PROPRIETARY.replace("fleet.", "b.")))
def proprietary_model(i):
    return _out(pr.proprietary_model(i("fleet"), i.ref))


_COMPLEXITY = "CASE {k} % 5 WHEN 0 THEN 'low_text' WHEN 1 THEN 'Low_Images' WHEN 2 THEN NULL WHEN 3 THEN 'high' ELSE 'medium' END"
CTES["parse_volume"] = f"""SELECT site, cloud, region, tier, CAST(ceil(CAST(chars AS DOUBLE) / 3000) AS DOUBLE) / 1000 AS pages_thousands,
 {_COMPLEXITY.format(k='site')} AS complexity, CASE WHEN site % 7 = 0 THEN 'DBU' WHEN site % 7 = 1 THEN NULL ELSE 'pages' END AS parse_mode,
 CASE WHEN site % 14 = 0 THEN NULL ELSE CAST(num_pages AS DOUBLE) END AS hours_per_month FROM page_volume"""


@query("est_doc_parse", cost_sql("parse_volume", "site", "'AI_PARSE'", px.price("parse_volume.cloud", "parse_volume.region", "parse_volume.tier", _INF),
                                 month="""CASE WHEN lower(coalesce(b.parse_mode, 'pages')) = 'dbu' THEN coalesce(b.hours_per_month, 0)
 ELSE coalesce(b.pages_thousands, 0) * CASE lower(coalesce(b.complexity, 'medium')) WHEN 'low_text' THEN 12.5 WHEN 'low_images' THEN 22.5 WHEN 'high' THEN 87.5 ELSE 62.5 END END"""))
def doc_parse(i):
    k = F.col("site")
    volume = i("page_volume").select(
        "site", "cloud", "region", "tier", (F.ceil(F.col("chars").cast("double") / 3000).cast("double") / 1000).alias("pages_thousands"),
        F.expr(_COMPLEXITY.format(k="site")).alias("complexity"),
        F.when(k % 7 == 0, "DBU").when(k % 7 != 1, "pages").alias("parse_mode"),
        F.when(k % 14 != 0, F.col("num_pages").cast("double")).alias("hours_per_month"))
    return _out(pr.doc_parse(volume, i.ref), "site")


_DOC_TYPE = "CASE num_docs % 5 WHEN 0 THEN 'short_text' WHEN 1 THEN '{a}' WHEN 2 THEN NULL WHEN 3 THEN '{b}' ELSE 'Custom' END"
_CUSTOM = "CASE WHEN num_docs % 2 = 0 THEN NULL ELSE 7.5 END"


def _docs_sql(label: str, a: str, b: str, rates: str) -> str:
    src = f"(SELECT *, {_DOC_TYPE.format(a=a, b=b)} AS doc_type, {_CUSTOM} AS custom_rate FROM document_volume) v"
    return cost_sql(src, "lang, source", label, px.price("v.cloud", "v.region", "v.tier", _INF),
                    month=f"(CAST(coalesce(b.num_docs, 0) AS DOUBLE) / 1000 * CASE lower(coalesce(b.doc_type, 'custom')) {rates} ELSE coalesce(b.custom_rate, 0) END)")


def _docs(i, a: str, b: str):
    return i("document_volume").withColumns({"doc_type": F.expr(_DOC_TYPE.format(a=a, b=b)), "custom_rate": F.expr(_CUSTOM).cast("double")})


@query("est_doc_classify", _docs_sql("'AI_CLASSIFY'", "rental_contract", "Rental_Contract", "WHEN 'short_text' THEN 4.5 WHEN 'rental_contract' THEN 50.0"))
def doc_classify(i):
    return _out(pr.doc_classify(_docs(i, "rental_contract", "Rental_Contract"), i.ref), "lang", "source")


@query("est_doc_extract", _docs_sql("'AI_EXTRACT'", "complex_reasoning", "deep_nesting",
                                    "WHEN 'short_text' THEN 45.0 WHEN 'invoice' THEN 45.0 WHEN 'complex_reasoning' THEN 562.5 WHEN 'deep_nesting' THEN 537.5"))
def doc_extract(i):
    return _out(pr.doc_extract(_docs(i, "complex_reasoning", "deep_nesting"), i.ref), "lang", "source")


CTES["fleet_jobs"] = "SELECT * REPLACE ('JOBS' AS kind) FROM fleet"


@query("est_compare_options", f"""SELECT *, CAST(rank() OVER (PARTITION BY workload_id ORDER BY total_cost_per_month NULLS LAST) AS INT) AS cost_rank FROM (
 SELECT * FROM ({_classic('JOBS', 'NULL', "'JOBS_CLASSIC'")}) UNION ALL SELECT * FROM ({
     cost_sql('fleet_jobs', 'workload_id', "upper(kind) || '_SERVERLESS'",
              px.price('fleet_jobs.cloud', 'fleet_jobs.region', 'fleet_jobs.tier', px.product('kind', 'true', 'true', _NONE, _NONE)),
              SERVERLESS.replace('fleet.', 'fleet_jobs.'), px.hours('kind'))}))""")
def compare_options(i):
    from pyspark.sql import Window
    w = Window.partitionBy("workload_id").orderBy(F.col("total_cost_per_month").asc_nulls_last())
    return _out(pr.compare_options(i("fleet"), i.ref)).withColumn("cost_rank", F.rank().over(w))
