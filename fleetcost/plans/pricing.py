"""Monthly cost of a fleet: one input row per workload, one priced row out. Joins only small lookups, no shuffle of the fleet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import col, round_half_up
from fleetcost.operators import lookups as lk
from fleetcost.refdata import RefData

COST_COLUMNS = ("workload", "dbu_per_hour", "hours_per_month", "dbu_per_month", "dbu_price", "dbu_cost_per_month",
                "vm_cost_per_month", "total_cost_per_month")

# DBU per 1,000 pages, documents or inputs.
PARSE_RATES = {"low_text": 12.5, "low_images": 22.5, "medium": 62.5, "high": 87.5}
CLASSIFY_RATES = {"short_text": 4.5, "rental_contract": 50.0}
EXTRACT_RATES = {"short_text": 45.0, "invoice": 45.0, "complex_reasoning": 562.5, "deep_nesting": 537.5}


def _costs(df: DataFrame, workload: Column, dbu_month: Column, dbu_hour: Column | None = None,
           hours: Column | None = None, vm_hour: Column | None = None) -> DataFrame:
    """Add the cost columns. The total rounds the unrounded sum; a NULL price leaves only the VM cost."""
    zero = F.lit(0.0)
    dbu_hour, hours = zero if dbu_hour is None else dbu_hour, zero if hours is None else hours
    dbu_cost = dbu_month * F.col("_price")
    vm = zero if vm_hour is None else vm_hour * hours
    out = dict(zip(COST_COLUMNS, (workload, dbu_hour, hours, dbu_month, F.col("_price"), round_half_up(dbu_cost, 2),
                                  round_half_up(vm, 2), round_half_up(dbu_cost + vm, 2))))
    return df.withColumns(out).drop("_price", "_dbu", "_hours", "_drv_vm", "_wrk_vm", "_vm", "_wh")


def _hours(kind: str, hours=None) -> Column:
    return lk.hours_per_month(F.lit(kind), "runs_per_day", "runtime_minutes", "days_per_month",
                              F.lit(None).cast("double") if hours is None else hours)


def _classic(fleet: DataFrame, ref: RefData, kind: str, edition, label: Column) -> DataFrame:
    d = lk.classic_dbu(fleet, ref, "cloud", "driver_node", "worker_node", "num_workers", "photon", F.lit(kind), edition, "_dbu")
    d = d.withColumn("_hours", _hours(kind))
    d = lk.governed_price(d, ref.price_card, "cloud", "region", "tier",
                          lk.product_type(F.lit(kind), F.lit(False), "photon", edition, F.lit(None).cast("string")), "_price")
    for node, out in (("driver_node", "_drv_vm"), ("worker_node", "_wrk_vm")):
        d = lk.vm_cost(d, ref, "cloud", "region", node, F.lit("on_demand"), F.lit("NA"), out)
    vm = F.col("_drv_vm") + F.col("_wrk_vm") * F.coalesce("num_workers", F.lit(0))
    return _costs(d, label, F.col("_dbu") * F.col("_hours"), F.col("_dbu"), F.col("_hours"), vm)


def jobs_classic(fleet: DataFrame, ref: RefData) -> DataFrame:
    return _classic(fleet, ref, "JOBS", F.lit(None).cast("string"), F.lit("JOBS_CLASSIC"))


def interactive_classic(fleet: DataFrame, ref: RefData) -> DataFrame:
    return _classic(fleet, ref, "ALL_PURPOSE", F.lit(None).cast("string"), F.lit("ALL_PURPOSE_CLASSIC"))


def pipeline_classic(fleet: DataFrame, ref: RefData) -> DataFrame:
    label = F.concat(F.lit("DLT_"), F.upper(F.coalesce("edition", F.lit("CORE"))))
    return _classic(fleet, ref, "DLT", F.col("edition"), label)


def serverless(fleet: DataFrame, ref: RefData) -> DataFrame:
    """Serverless jobs or interactive compute; the price includes the machines, so VM cost is 0."""
    none = F.lit(None).cast("string")
    d = lk.serverless_dbu(fleet, ref, "cloud", "driver_node", "worker_node", "num_workers", "kind", "serverless_mode", "_dbu")
    d = d.withColumn("_hours", lk.hours_per_month("kind", "runs_per_day", "runtime_minutes", "days_per_month", none.cast("double")))
    d = lk.governed_price(d, ref.price_card, "cloud", "region", "tier",
                          lk.product_type("kind", F.lit(True), F.lit(True), none, none), "_price")
    return _costs(d, F.concat(F.upper("kind"), F.lit("_SERVERLESS")), F.col("_dbu") * F.col("_hours"), F.col("_dbu"), F.col("_hours"))


def warehouse_shape(config: DataFrame) -> DataFrame:
    """The configuration with its two swapped columns put right, and the case of the keys removed."""
    return config.select(F.upper("cloud").alias("cloud"), F.lower("warehouse_size").alias("warehouse_type"),
                         F.upper("warehouse_type").alias("warehouse_size"), "worker_count", "driver_instance_type", "worker_instance_type")


def warehouse(fleet: DataFrame, ref: RefData) -> DataFrame:
    """SQL warehouse: VM cost from its configuration times clusters, 0 when serverless or without a configuration row."""
    d = lk.warehouse_rate(fleet, ref, "cloud", "warehouse_type", "warehouse_size", "num_clusters", "_dbu")
    d = d.withColumn("_hours", _hours("DBSQL", F.col("hours_per_month")))
    d = lk.governed_price(d, ref.price_card, "cloud", "region", "tier",
                          lk.product_type(F.lit("DBSQL"), F.lit(False), F.lit(False), F.lit(None).cast("string"), "warehouse_type"), "_price")
    keys = [(F.upper("cloud"), F.col("cloud")), (F.lower("warehouse_type"), F.col("warehouse_type")),
            (F.upper("warehouse_size"), F.col("warehouse_size"))]
    d = lk.attach(d, warehouse_shape(ref.warehouse_config), keys,
                  {"_di": F.col("driver_instance_type"), "_wi": F.col("worker_instance_type"), "_wc": F.col("worker_count")})
    for node, out in (("_di", "_drv_vm"), ("_wi", "_wrk_vm")):
        d = lk.vm_cost(d, ref, "cloud", "region", node, F.lit("on_demand"), F.lit("NA"), out)
    n = F.coalesce("num_clusters", F.lit(1))
    vm = F.when(F.lower("warehouse_type") == "serverless", 0.0).otherwise(
        F.col("_drv_vm") * n + F.col("_wrk_vm") * F.coalesce("_wc", F.lit(0)) * n)
    label = F.concat(F.lit("DBSQL_"), F.upper("warehouse_type"))
    return _costs(d, label, F.col("_dbu") * F.col("_hours"), F.col("_dbu"), F.col("_hours"), vm).drop("_di", "_wi", "_wc")


def _always_on(d: DataFrame, ref: RefData, label: str, product: str, hours: Column) -> DataFrame:
    d = lk.governed_price(d.withColumn("_hours", hours), ref.price_card, "cloud", "region", "tier", F.lit(product), "_price")
    return _costs(d, F.lit(label), F.col("_dbu") * F.col("_hours"), F.col("_dbu"), F.col("_hours"))


def _month_hours() -> Column:
    return F.lit(24.0) * F.coalesce("days_per_month", F.lit(30))


def vector_search(fleet: DataFrame, ref: RefData) -> DataFrame:
    d = lk.vector_dbu(fleet, ref, "cloud", "vector_mode", "capacity_millions", "_dbu")
    return _always_on(d, ref, "VECTOR_SEARCH", lk.INFERENCE_PRODUCT, _month_hours())


def model_serving(fleet: DataFrame, ref: RefData) -> DataFrame:
    d = lk.serving_dbu(fleet, ref, "cloud", "serving_size", "concurrency", "_dbu")
    return _always_on(d, ref, "MODEL_SERVING", lk.INFERENCE_PRODUCT, _month_hours())


def database(fleet: DataFrame, ref: RefData) -> DataFrame:
    d = fleet.withColumn("_dbu", lk.database_dbu("capacity_units", "ha_nodes"))
    return _always_on(d, ref, "LAKEBASE", lk.DATABASE_PRODUCT, _month_hours())


def apps(fleet: DataFrame, ref: RefData) -> DataFrame:
    """Hosted apps: 1.0 DBU per hour when large, else 0.5; 730 hours unless given."""
    dbu = F.when(F.lower("app_size") == "large", 1.0).otherwise(0.5) * F.coalesce("num_apps", F.lit(1))
    return _always_on(fleet.withColumn("_dbu", dbu), ref, "APPS", lk.APPS_PRODUCT, F.coalesce("hours_per_month", F.lit(730.0)))


def _metered(d: DataFrame, ref: RefData, label: str, product: Column) -> DataFrame:
    d = lk.governed_price(d, ref.price_card, "cloud", "region", "tier", product, "_price")
    return _costs(d, F.lit(label), F.col("_dbu"))


def hosted_model(fleet: DataFrame, ref: RefData) -> DataFrame:
    d = lk.hosted_model_dbu(fleet, ref, "cloud", "hosted_model", "rate_type", "quantity", "_dbu")
    return _metered(d, ref, "FMAPI_HOSTED", F.lit(lk.INFERENCE_PRODUCT))


def proprietary_model(fleet: DataFrame, ref: RefData) -> DataFrame:
    d = lk.proprietary_model_dbu(fleet, ref, "cloud", "provider", "proprietary_model", "endpoint_type", "context_length",
                                 "rate_type", "quantity", "_dbu")
    vendor = F.when(F.upper("provider") == "GOOGLE", F.lit("GEMINI")).otherwise(F.upper("provider"))
    return _metered(d, ref, "FMAPI_PROPRIETARY", F.concat(vendor, F.lit("_MODEL_SERVING")))


def _rate(name, default: str, rates: dict[str, float], otherwise) -> Column:
    key, out = F.lower(F.coalesce(col(name), F.lit(default))), None
    for text, rate in rates.items():
        out = F.when(key == text, rate) if out is None else out.when(key == text, rate)
    return out.otherwise(otherwise)


def doc_parse(volume: DataFrame, ref: RefData) -> DataFrame:
    """Document parsing: thousand pages x rate by complexity, or the given DBU hours in mode 'dbu'."""
    pages = F.coalesce("pages_thousands", F.lit(0.0)) * _rate("complexity", "medium", PARSE_RATES, F.lit(PARSE_RATES["medium"]))
    dbu = F.when(F.lower(F.coalesce("parse_mode", F.lit("pages"))) == "dbu", F.coalesce("hours_per_month", F.lit(0.0))).otherwise(pages)
    return _metered(volume.withColumn("_dbu", dbu), ref, "AI_PARSE", F.lit(lk.INFERENCE_PRODUCT))


def _per_thousand(volume, ref, label, rates) -> DataFrame:
    rate = _rate("doc_type", "custom", rates, F.coalesce("custom_rate", F.lit(0.0)))
    dbu = F.coalesce("num_docs", F.lit(0)).cast("double") / 1000 * rate
    return _metered(volume.withColumn("_dbu", dbu), ref, label, F.lit(lk.INFERENCE_PRODUCT))


def doc_classify(volume: DataFrame, ref: RefData) -> DataFrame:
    return _per_thousand(volume, ref, "AI_CLASSIFY", CLASSIFY_RATES)


def doc_extract(volume: DataFrame, ref: RefData) -> DataFrame:
    return _per_thousand(volume, ref, "AI_EXTRACT", EXTRACT_RATES)


def compare_options(fleet: DataFrame, ref: RefData) -> DataFrame:
    """Classic and serverless jobs side by side: each workload becomes a row per option, and all rows are priced in one pass over the fleet."""
    keep, none = [c for c in fleet.columns if c not in COST_COLUMNS], F.lit(None).cast("string")
    d = fleet.select(*keep, F.explode(F.array(F.lit(False), F.lit(True))).alias("_srv"))
    srv = F.col("_srv")
    d = d.withColumns({"kind": F.when(srv, "JOBS").otherwise(F.col("kind")), "_photon": F.when(srv, True).otherwise(F.col("photon"))})
    d = lk.classic_dbu(d, ref, "cloud", "driver_node", "worker_node", "num_workers", "_photon", F.lit("JOBS"), none, "_dbu")
    twice = srv & (F.lower(F.coalesce("serverless_mode", F.lit("standard"))) == "performance")
    d = d.withColumns({"_dbu": F.col("_dbu") * F.when(twice, 2.0).otherwise(1.0), "_hours": _hours("JOBS")})
    d = lk.governed_price(d, ref.price_card, "cloud", "region", "tier", lk.product_type(F.lit("JOBS"), srv, "_photon", none, none), "_price")
    for node, out in (("driver_node", "_drv_vm"), ("worker_node", "_wrk_vm")):
        d = lk.vm_cost(d, ref, "cloud", "region", node, F.lit("on_demand"), F.lit("NA"), out)
    vm = F.when(srv, 0.0).otherwise(F.col("_drv_vm") + F.col("_wrk_vm") * F.coalesce("num_workers", F.lit(0)))
    label = F.when(srv, "JOBS_SERVERLESS").otherwise("JOBS_CLASSIC")
    return _costs(d, label, F.col("_dbu") * F.col("_hours"), F.col("_dbu"), F.col("_hours"), vm).select(*keep, *COST_COLUMNS)
