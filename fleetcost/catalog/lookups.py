"""Rate lookups over the fleet (LKP), and lookup-style joins."""
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.operators import lookups as lk
from fleetcost.oracle import prices as px
from fleetcost.oracle.base import rn


def _sql(expr: str, out: str, digits: int = 6) -> str:
    return f"SELECT workload_id, {rn(expr, digits)} AS {out} FROM fleet"


def _pick(df, *cols):
    return rounded(df.select("workload_id", *cols), " ".join(cols))


@query("lkp_instance_rate", _sql(px.inst("fleet.cloud", "fleet.worker_node"), "dbu_rate"))
def instance_rate(i):
    return _pick(lk.instance_rate(i("fleet"), i.ref, "cloud", "worker_node", "dbu_rate"), "dbu_rate")


@query("lkp_vm_cost", f"SELECT workload_id, {rn(px.vm('fleet.cloud', 'fleet.region', 'worker_node'))} AS on_demand, "
       f"{rn(px.vm('fleet.cloud', 'fleet.region', 'worker_node', chr(39) + 'reserved' + chr(39), chr(39) + 'ALL_UPFRONT' + chr(39)))} AS reserved, "
       f"{rn(px.vm('fleet.cloud', 'fleet.region', 'driver_node', chr(39) + 'on_demand' + chr(39), 'CAST(NULL AS VARCHAR)'))} AS default_option FROM fleet")
def vm_cost(i):
    none = F.lit(None).cast("string")
    d = lk.vm_cost(i("fleet"), i.ref, "cloud", "region", "worker_node", F.lit("on_demand"), F.lit("NA"), "on_demand")
    d = lk.vm_cost(d, i.ref, "cloud", "region", "worker_node", F.lit("reserved"), F.lit("ALL_UPFRONT"), "reserved")
    d = lk.vm_cost(d, i.ref, "cloud", "region", "driver_node", F.lit("on_demand"), none, "default_option")
    return _pick(d, "on_demand", "reserved", "default_option")


_PRODUCT = px.product("kind", "serverless", "photon", "edition", "warehouse_type")
_PRODUCT_COL = (lambda: lk.product_type("kind", "serverless", "photon", "edition", "warehouse_type"))


@query("prj_product_type", f"SELECT workload_id, {_PRODUCT} AS product_type FROM fleet")
def product_type(i):
    return i("fleet").select("workload_id", _PRODUCT_COL().alias("product_type"))


@query("lkp_list_price", f"""SELECT workload_id, {rn('''coalesce((SELECT min(r.price_per_dbu) FROM ref_dbu_rates r WHERE upper(r.cloud) = upper(f.cloud)
 AND upper(r.region) = upper(f.region) AND upper(r.tier) = upper(f.tier) AND (upper(r.sku_name) = f.p OR upper(coalesce(r.product_type, '')) = f.p)), 0)''')} AS list_price
 FROM (SELECT *, {_PRODUCT} AS p FROM fleet) f""")
def list_price(i):
    d = i("fleet").withColumn("p", _PRODUCT_COL())
    return _pick(lk.list_price(d, i.ref, "cloud", "region", "tier", "p", "list_price"), "list_price")


@query("lkp_governed_price", f"SELECT workload_id, {rn(px.price('f.cloud', 'f.region', 'f.tier', 'f.p'))} AS dbu_price FROM (SELECT *, {_PRODUCT} AS p FROM fleet) f")
def governed_price(i):
    d = i("fleet").withColumn("p", _PRODUCT_COL())
    return _pick(lk.governed_price(d, i.ref.price_card, "cloud", "region", "tier", "p", "dbu_price"), "dbu_price")


@query("lkp_price_status", f"SELECT workload_id, {px.status_text('f.cloud', 'f.region', 'f.tier', 'f.p')} AS price_basis FROM (SELECT *, {_PRODUCT} AS p FROM fleet) f")
def price_status(i):
    d = i("fleet").withColumn("p", _PRODUCT_COL())
    return lk.price_status_text(d, i.ref.price_card, "cloud", "region", "tier", "p", "price_basis").select("workload_id", "price_basis")


_MULT = px.mult("fleet.cloud", "kind", "edition", "photon", "serverless")


@query("lkp_multiplier", _sql(_MULT, "multiplier"))
def multiplier(i):
    return _pick(lk.multiplier(i("fleet"), i.ref, "cloud", "kind", "edition", "photon", "serverless", "multiplier"), "multiplier")


WAREHOUSE = """coalesce((SELECT min(x.dbu_per_hour) FROM ref_warehouse_rates x WHERE upper(x.cloud) = upper(fleet.cloud) AND x.warehouse_type = lower(fleet.warehouse_type)
 AND upper(x.warehouse_size) = upper(fleet.warehouse_size)), 0) * coalesce(num_clusters, 1)"""


@query("lkp_warehouse_rate", _sql(WAREHOUSE, "dbu_per_hour"))
def warehouse_rate(i):
    return _pick(lk.warehouse_rate(i("fleet"), i.ref, "cloud", "warehouse_type", "warehouse_size", "num_clusters", "dbu_per_hour"), "dbu_per_hour")


def serverless_sql(product: str, size: str, cloud: str = "cloud") -> str:
    return (f"coalesce((SELECT min(x.dbu_rate) FROM ref_serverless_rates x WHERE upper(x.cloud) = upper({cloud}) AND lower(x.product) = {product} "
            f"AND upper(x.size_or_model) = upper({size})), 0)")


@query("lkp_serverless_rate", f"SELECT workload_id, {rn(serverless_sql(chr(39) + 'vector_search' + chr(39), 'fleet.vector_mode', 'fleet.cloud'))} AS vector_rate, "
       f"{rn(serverless_sql(chr(39) + 'model_serving' + chr(39), 'fleet.serving_size', 'fleet.cloud'))} AS serving_rate FROM fleet")
def serverless_rate(i):
    d = lk.serverless_rate(i("fleet"), i.ref, "cloud", F.lit("Vector_Search"), "vector_mode", "vector_rate")
    return _pick(lk.serverless_rate(d, i.ref, "cloud", F.lit("model_serving"), "serving_size", "serving_rate"), "vector_rate", "serving_rate")


HOSTED = """coalesce((SELECT min(CASE WHEN coalesce(x.is_hourly, false) THEN fleet.quantity * x.dbu_rate ELSE (fleet.quantity / CAST(coalesce(x.input_divisor, 1) AS DOUBLE)) * x.dbu_rate END)
 FROM ref_hosted_model_rates x WHERE upper(x.cloud) = upper(fleet.cloud) AND upper(x.model) = upper(fleet.hosted_model) AND lower(x.rate_type) = lower(fleet.rate_type)), 0)"""
PROPRIETARY = """coalesce((SELECT min(CASE WHEN coalesce(x.is_hourly, false) THEN fleet.quantity * x.dbu_rate ELSE (fleet.quantity / CAST(coalesce(x.input_divisor, 1) AS DOUBLE)) * x.dbu_rate END)
 FROM ref_proprietary_model_rates x WHERE upper(x.cloud) = upper(fleet.cloud) AND upper(x.provider) = upper(fleet.provider) AND upper(x.model) = upper(fleet.proprietary_model)
 AND lower(x.endpoint_type) = lower(coalesce(fleet.endpoint_type, 'global')) AND lower(x.context_length) = lower(coalesce(fleet.context_length, 'all'))
 AND lower(x.rate_type) = lower(fleet.rate_type)), 0)"""


@query("lkp_hosted_model_dbu", _sql(HOSTED, "dbu"))
def hosted_model_dbu(i):
    return _pick(lk.hosted_model_dbu(i("fleet"), i.ref, "cloud", "hosted_model", "rate_type", "quantity", "dbu"), "dbu")


@query("lkp_proprietary_model_dbu", _sql(PROPRIETARY, "dbu"))
def proprietary_model_dbu(i):
    return _pick(lk.proprietary_model_dbu(i("fleet"), i.ref, "cloud", "provider", "proprietary_model", "endpoint_type", "context_length",
                                          "rate_type", "quantity", "dbu"), "dbu")


@query("lkp_hours_per_month", _sql(px.hours("kind", given="hours_per_month"), "hours"))
def hours(i):
    return _pick(i("fleet").withColumn("hours", lk.hours_per_month("kind", "runs_per_day", "runtime_minutes", "days_per_month", "hours_per_month")), "hours")


def classic_sql(kind: str, edition: str, photon: str = "photon") -> str:
    return f"({px.inst('fleet.cloud', 'fleet.driver_node')} + {px.inst('fleet.cloud', 'fleet.worker_node')} * coalesce(num_workers, 0)) * {px.mult('fleet.cloud', kind, edition, photon, 'false')}"


SERVERLESS = (classic_sql("kind", "NULL", "true")
              + " * CASE WHEN upper(kind) = 'ALL_PURPOSE' OR lower(coalesce(serverless_mode, 'standard')) = 'performance' THEN 2.0 ELSE 1.0 END")


@query("lkp_classic_dbu", _sql(classic_sql("kind", "edition"), "dbu_per_hour"))
def classic_dbu(i):
    return _pick(lk.classic_dbu(i("fleet"), i.ref, "cloud", "driver_node", "worker_node", "num_workers", "photon", "kind", "edition", "dbu_per_hour"), "dbu_per_hour")


@query("lkp_serverless_dbu", _sql(SERVERLESS, "dbu_per_hour"))
def serverless_dbu(i):
    return _pick(lk.serverless_dbu(i("fleet"), i.ref, "cloud", "driver_node", "worker_node", "num_workers", "kind", "serverless_mode", "dbu_per_hour"), "dbu_per_hour")


VECTOR = (serverless_sql("'vector_search'", "fleet.vector_mode", "fleet.cloud")
          + " * ceil(coalesce(capacity_millions, 0) / CASE WHEN lower(vector_mode) = 'storage_optimized' THEN 64.0 ELSE 2.0 END)")
SERVING = (serverless_sql("'model_serving'", "fleet.serving_size", "fleet.cloud")
           + " * CASE WHEN lower(coalesce(serving_size, 'cpu')) LIKE 'cpu%' THEN coalesce(concurrency, 4) ELSE CAST(coalesce(concurrency, 4) AS DOUBLE) / 4 END")


@query("lkp_vector_dbu", _sql(VECTOR, "dbu_per_hour"))
def vector_dbu(i):
    return _pick(lk.vector_dbu(i("fleet"), i.ref, "cloud", "vector_mode", "capacity_millions", "dbu_per_hour"), "dbu_per_hour")


@query("lkp_serving_dbu", _sql(SERVING, "dbu_per_hour"))
def serving_dbu(i):
    return _pick(lk.serving_dbu(i("fleet"), i.ref, "cloud", "serving_size", "concurrency", "dbu_per_hour"), "dbu_per_hour")


@query("lkp_database_dbu", _sql("CAST(coalesce(capacity_units, 0) AS DOUBLE) * coalesce(ha_nodes, 1)", "dbu_per_hour"))
def database_dbu(i):
    return _pick(i("fleet").withColumn("dbu_per_hour", lk.database_dbu("capacity_units", "ha_nodes")), "dbu_per_hour")


@query("jn_lookup_default", """SELECT f.workload_id, f.worker_node, coalesce(r.dbu_rate, 0) AS dbu_rate, coalesce(m.multiplier, 1.0) AS multiplier
 FROM fleet f LEFT JOIN inst_ref r ON r.cloud = upper(f.cloud) AND r.instance_type = upper(f.worker_node)
 LEFT JOIN mult_ref m ON m.cloud = upper(f.cloud) AND m.sku_type = 'DLT_' || upper(f.edition) || '_COMPUTE'""")
def lookup_default(i):
    ref = i.ref
    d = lk.instance_rate(i("fleet"), ref, "cloud", "worker_node", "dbu_rate")
    keys = [(F.upper("cloud"), F.upper("cloud")), (F.concat(F.lit("DLT_"), F.upper("edition"), F.lit("_COMPUTE")), F.upper("sku_type"))]
    d = lk.attach(d, ref.multipliers.where("feature = 'photon'"), keys, {"multiplier": F.col("multiplier")})
    return d.select("workload_id", "worker_node", "dbu_rate", F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"))
