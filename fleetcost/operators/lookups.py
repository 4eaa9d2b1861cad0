"""Rate lookups as left joins: the keys of a lookup are first reduced to one row, then joined to the fleet.

No join hint is given. A lookup table below spark.sql.autoBroadcastJoinThreshold is broadcast (Spark checks its size), a
larger one is joined by shuffle with AQE splitting hot keys; the result is the same.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import col
from fleetcost.refdata import RefData

# Workload kinds that run all day, and the product each kind is billed as.
ALWAYS_ON = ("VECTOR_SEARCH", "MODEL_SERVING", "LAKEBASE")
INFERENCE_PRODUCT = "SERVERLESS_REAL_TIME_INFERENCE"
DATABASE_PRODUCT = "DATABASE_SERVERLESS_COMPUTE"
APPS_PRODUCT = "ALL_PURPOSE_SERVERLESS_COMPUTE"


def one_per_key(table: DataFrame, keys: list[Column], values: list[Column]) -> DataFrame:
    """Columns k0.., v0..: one row per key. Of several rows, the one with the smallest values."""
    return (table.groupBy(*[k.alias(f"k{n}") for n, k in enumerate(keys)])
            .agg(F.min(F.struct(*[v.alias(f"v{n}") for n, v in enumerate(values)])).alias("v"))
            .select(*[f"k{n}" for n in range(len(keys))], "v.*"))


def attach(df: DataFrame, table: DataFrame, keys: list[tuple[Column, Column]], values: dict[str, Column],
           ref: RefData | None = None, name: str = "") -> DataFrame:
    """Left join `values` of `table` by equal keys, one row per key.

    With `ref` and `name` the reduced reference table is kept with `ref`, so it is computed once per session.
    """
    def build() -> DataFrame:
        return one_per_key(table, [right for _, right in keys], list(values.values()))
    one = ref.keep(name, build) if ref is not None else build()
    tag = next(iter(values))
    names = [f"_{tag}_k{n}" for n in range(len(keys))]
    one = one.select(*[F.col(f"k{n}").alias(x) for n, x in enumerate(names)], *[F.col(f"v{n}").alias(x) for n, x in enumerate(values)])
    on = reduce(and_, [left == F.col(n) for n, (left, _) in zip(names, keys)])
    return df.join(one, on, "left").drop(*names)


def _or(df: DataFrame, out: str, default: float) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def instance_rate(df: DataFrame, ref: RefData, cloud, instance, out: str) -> DataFrame:
    """DBU per hour of an instance type, 0 when unknown."""
    keys = [(F.upper(col(cloud)), F.upper("cloud")), (F.upper(col(instance)), F.upper("instance_type"))]
    return _or(attach(df, ref.instance_rates, keys, {out: F.col("dbu_rate")}, ref, "instance"), out, 0.0)


def vm_cost(df: DataFrame, ref: RefData, cloud, region, instance, tier, option, out: str) -> DataFrame:
    """VM cost per hour, 0 when unknown; a missing payment option means 'NA'."""
    left = [col(cloud), col(region), col(instance), col(tier), F.coalesce(col(option), F.lit("NA"))]
    right = ("cloud", "region", "instance_type", "pricing_tier", "payment_option")
    keys = [(F.upper(a), F.upper(b)) for a, b in zip(left, right)]
    return _or(attach(df, ref.vm_costs, keys, {out: F.col("cost_per_hour")}, ref, "vm"), out, 0.0)


def list_price(df: DataFrame, ref: RefData, cloud, region, tier, product, out: str) -> DataFrame:
    """List price by SKU name or product type, 0 when unknown. Both names become one key column, so the OR is an equi-join."""
    r = ref.dbu_rates
    both = r.select("cloud", "region", "tier", "price_per_dbu",
                    F.explode(F.array_distinct(F.array(F.upper("sku_name"), F.upper(F.coalesce("product_type", F.lit("")))))).alias("name"))
    keys = [(F.upper(col(a)), F.upper(b)) for a, b in zip((cloud, region, tier), ("cloud", "region", "tier"))]
    keys.append((F.upper(col(product)), F.col("name")))
    return _or(attach(df, both, keys, {out: F.col("price_per_dbu")}, ref, "list_price"), out, 0.0)


def governed_price(df: DataFrame, price_card: DataFrame, cloud, region, tier, product, out: str,
                   details: tuple[str, ...] = ()) -> DataFrame:
    """Price of the price card; NULL (pending) when the card has no row or no single price. Never a fallback."""
    keys = [(F.upper(col(cloud)), F.col("cloud")), (F.lower(col(region)), F.col("region")),
            (F.upper(col(tier)), F.col("tier")), (F.upper(col(product)), F.col("product_type"))]
    values = {out: F.col("price_per_dbu"), **{f"{out}_{d}": F.col(d) for d in details}}
    return attach(df, price_card, keys, values)


def price_status_text(df: DataFrame, price_card: DataFrame, cloud, region, tier, product, out: str) -> DataFrame:
    """Where a price comes from: `<status> $<rate>/DBU <sku> (<source>)`, or PENDING with the reason."""
    from fleetcost.functions.columns import fmt_number
    d = governed_price(df, price_card, cloud, region, tier, product, "_p", ("status", "billing_sku", "source"))
    text = (F.when(F.col("_p_status").isNull(),
                   F.concat(F.lit("PENDING - the price card lacks "), F.upper(col(tier)), F.lit(" "), F.upper(col(product)),
                            F.lit(" in "), F.upper(col(cloud)), F.lit(" "), F.lower(col(region))))
            .when(F.col("_p_status") == "PENDING", F.concat(F.lit("PENDING - "), F.col("_p_source")))
            .otherwise(F.concat(F.col("_p_status"), F.lit(" $"), fmt_number("_p", 6), F.lit("/DBU "), F.col("_p_billing_sku"),
                                F.lit(" ("), F.col("_p_source"), F.lit(")"))))
    return d.withColumn(out, text).drop("_p", "_p_status", "_p_billing_sku", "_p_source")


def multiplier(df: DataFrame, ref: RefData, cloud, kind, edition, photon, serverless, out: str) -> DataFrame:
    """Acceleration multiplier: 1.0 when neither photon nor serverless, else by cloud and SKU type, 1.0 when unknown."""
    kind = F.upper(col(kind))
    sku = (F.when(kind == "DLT", F.concat(F.lit("DLT_"), F.upper(F.coalesce(col(edition), F.lit("CORE"))), F.lit("_COMPUTE")))
           .when(kind == "ALL_PURPOSE", F.lit("ALL_PURPOSE_COMPUTE")).otherwise(F.lit("JOBS_COMPUTE")))
    on = F.coalesce(col(photon), F.lit(False)) | F.coalesce(col(serverless), F.lit(False))
    keys = [(F.when(on, F.upper(col(cloud))), F.upper("cloud")), (sku, F.upper("sku_type"))]
    return _or(attach(df, ref.multipliers.where("feature = 'photon'"), keys, {out: F.col("multiplier")}, ref, "multiplier"), out, 1.0)


def warehouse_rate(df: DataFrame, ref: RefData, cloud, wh_type, wh_size, clusters, out: str) -> DataFrame:
    """Warehouse DBU per hour times clusters (default 1), 0 when unknown."""
    keys = [(F.upper(col(cloud)), F.upper("cloud")), (F.lower(col(wh_type)), F.col("warehouse_type")),
            (F.upper(col(wh_size)), F.upper("warehouse_size"))]
    d = _or(attach(df, ref.warehouse_rates, keys, {out: F.col("dbu_per_hour")}, ref, "warehouse"), out, 0.0)
    return d.withColumn(out, F.col(out) * F.coalesce(col(clusters), F.lit(1)))


def serverless_rate(df: DataFrame, ref: RefData, cloud, product, size, out: str) -> DataFrame:
    """DBU rate by product and size or model, 0 when unknown."""
    keys = [(F.upper(col(cloud)), F.upper("cloud")), (F.lower(col(product)), F.lower("product")),
            (F.upper(col(size)), F.upper("size_or_model"))]
    return _or(attach(df, ref.serverless_rates, keys, {out: F.col("dbu_rate")}, ref, "serverless"), out, 0.0)


def _token_dbu(df: DataFrame, table: DataFrame, keys, quantity, out: str, ref: RefData, name: str) -> DataFrame:
    values = {out: F.col("dbu_rate"), f"_{out}_div": F.coalesce(F.col("input_divisor"), F.lit(1)),
              f"_{out}_hourly": F.coalesce(F.col("is_hourly"), F.lit(False))}
    d = attach(df, table, keys, values, ref, name)
    q = col(quantity).cast("double")
    dbu = F.when(F.col(f"_{out}_hourly"), q * F.col(out)).otherwise(q / F.col(f"_{out}_div") * F.col(out))
    return d.withColumn(out, F.coalesce(dbu, F.lit(0.0))).drop(f"_{out}_div", f"_{out}_hourly")


def hosted_model_dbu(df: DataFrame, ref: RefData, cloud, model, rate_type, quantity, out: str) -> DataFrame:
    """DBU of a quantity: hourly rates times quantity, token rates per divisor; 0 when unknown."""
    keys = [(F.upper(col(cloud)), F.upper("cloud")), (F.upper(col(model)), F.upper("model")),
            (F.lower(col(rate_type)), F.lower("rate_type"))]
    return _token_dbu(df, ref.hosted_model_rates, keys, quantity, out, ref, "hosted")


def proprietary_model_dbu(df: DataFrame, ref: RefData, cloud, provider, model, endpoint, context, rate_type, quantity,
                          out: str) -> DataFrame:
    """As hosted_model_dbu, with provider, endpoint type (default global) and context length (default all)."""
    keys = [(F.upper(col(cloud)), F.upper("cloud")), (F.upper(col(provider)), F.upper("provider")),
            (F.upper(col(model)), F.upper("model")),
            (F.lower(F.coalesce(col(endpoint), F.lit("global"))), F.lower("endpoint_type")),
            (F.lower(F.coalesce(col(context), F.lit("all"))), F.lower("context_length")),
            (F.lower(col(rate_type)), F.lower("rate_type"))]
    return _token_dbu(df, ref.proprietary_model_rates, keys, quantity, out, ref, "proprietary")


# ---- column rules without a table ------------------------------------------------------------------------------

def product_type(kind, serverless, photon, edition, wh_type) -> Column:
    """Billing product of a workload kind."""
    up = F.upper(col(kind))
    srv, pho = F.coalesce(col(serverless), F.lit(False)), F.coalesce(col(photon), F.lit(False))
    suffix = F.when(pho, F.lit("_(PHOTON)")).otherwise(F.lit(""))
    wh = F.upper(F.coalesce(col(wh_type), F.lit("")))
    return (F.when((up == "JOBS") & srv, F.lit("JOBS_SERVERLESS_COMPUTE"))
            .when(up == "JOBS", F.concat(F.lit("JOBS_COMPUTE"), suffix))
            .when((up == "ALL_PURPOSE") & srv, F.lit("ALL_PURPOSE_SERVERLESS_COMPUTE"))
            .when(up == "ALL_PURPOSE", F.concat(F.lit("ALL_PURPOSE_COMPUTE"), suffix))
            .when((up == "DLT") & srv, F.lit("JOBS_SERVERLESS_COMPUTE"))
            .when(up == "DLT", F.concat(F.lit("DLT_"), F.upper(F.coalesce(col(edition), F.lit("CORE"))), F.lit("_COMPUTE"), suffix))
            .when(up == "DBSQL", F.when(wh == "SERVERLESS", F.lit("SERVERLESS_SQL_COMPUTE"))
                  .when(wh == "PRO", F.lit("SQL_PRO_COMPUTE")).otherwise(F.lit("SQL_COMPUTE")))
            .otherwise(F.concat(up, F.lit("_COMPUTE"))))


def hours_per_month(kind, runs, minutes, days, hours) -> Column:
    """Explicit hours; 24 h a day for always-on kinds; else runs x minutes x days (30 by default)."""
    day = F.coalesce(col(days), F.lit(30))
    run = F.coalesce(col(runs), F.lit(0)) * (F.coalesce(col(minutes), F.lit(0)).cast("double") / 60)
    return (F.when(col(hours).isNotNull(), col(hours)).when(F.upper(col(kind)).isin(*ALWAYS_ON), F.lit(24.0) * day)
            .otherwise(run * day))


def classic_dbu(df: DataFrame, ref: RefData, cloud, driver, worker, workers, photon, kind, edition, out: str) -> DataFrame:
    """(driver + worker x n) x multiplier."""
    d = instance_rate(instance_rate(df, ref, cloud, driver, "_drv"), ref, cloud, worker, "_wrk")
    d = multiplier(d, ref, cloud, kind, edition, photon, F.lit(False), "_mul")
    n = F.coalesce(col(workers), F.lit(0))
    return d.withColumn(out, (F.col("_drv") + F.col("_wrk") * n) * F.col("_mul")).drop("_drv", "_wrk", "_mul")


def serverless_dbu(df: DataFrame, ref: RefData, cloud, driver, worker, workers, kind, mode, out: str) -> DataFrame:
    """Base x multiplier x 2 for interactive work or performance mode."""
    d = classic_dbu(df, ref, cloud, driver, worker, workers, F.lit(True), kind, F.lit(None).cast("string"), out)
    twice = (F.upper(F.coalesce(col(kind), F.lit(""))) == "ALL_PURPOSE") | (F.lower(F.coalesce(col(mode), F.lit("standard"))) == "performance")
    return d.withColumn(out, F.col(out) * F.when(twice, 2.0).otherwise(1.0))


def vector_dbu(df: DataFrame, ref: RefData, cloud, mode, millions, out: str) -> DataFrame:
    """Rate x units; a unit holds 2 million vectors, 64 million when storage-optimised."""
    d = serverless_rate(df, ref, cloud, F.lit("vector_search"), mode, out)
    per_unit = F.when(F.lower(col(mode)) == "storage_optimized", 64.0).otherwise(2.0)
    return d.withColumn(out, F.col(out) * F.ceil(F.coalesce(col(millions), F.lit(0.0)) / per_unit))


def serving_dbu(df: DataFrame, ref: RefData, cloud, size, concurrency, out: str) -> DataFrame:
    """Rate x concurrency for cpu sizes, rate x concurrency / 4 for others; concurrency is 4 by default."""
    d = serverless_rate(df, ref, cloud, F.lit("model_serving"), size, out)
    n = F.coalesce(col(concurrency), F.lit(4)).cast("double")
    return d.withColumn(out, F.col(out) * F.when(F.lower(F.coalesce(col(size), F.lit("cpu"))).like("cpu%"), n).otherwise(n / 4))


def database_dbu(units, nodes) -> Column:
    """Capacity units x nodes (default 1)."""
    return F.coalesce(col(units), F.lit(0)).cast("double") * F.coalesce(col(nodes), F.lit(1))
