"""Named subqueries: price card, lookups."""
from fleetcost.oracle.base import CTES, fmt

_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def card(universe: str, prices: str, as_of: str, price: str, status: str, source: str, region_filter: str = "TRUE") -> str:
    """Price card SQL over a universe and a price log."""
    return f"""
SELECT cloud, region, tier, product_type, billing_sku, CASE WHEN n = 1 THEN price END AS price_per_dbu,
  CASE WHEN n = 1 THEN '{status}' ELSE 'PENDING' END AS status,
  CASE WHEN n = 1 THEN '{source}' ELSE '{source}: expected one current price for ' || billing_sku
       || CASE WHEN n = 0 AND sku_region IS NOT NULL THEN ' or ' || regional_sku ELSE '' END || ', found ' || CAST(n AS VARCHAR) END AS source,
  list_price_reference
FROM (SELECT k.*, CASE WHEN a.n IS NOT NULL THEN k.regional_sku ELSE k.global_sku END AS billing_sku,
        CASE WHEN a.n IS NOT NULL THEN a.n ELSE coalesce(b.n, 0) END AS n, CASE WHEN a.n IS NOT NULL THEN a.price ELSE b.price END AS price
      FROM (SELECT u.*, m.sku_region, u.tier || '_' || u.product_type AS global_sku,
              u.tier || '_' || u.product_type || '_' || coalesce(m.sku_region, '?') AS regional_sku
            FROM (SELECT upper(cloud) AS cloud, lower(region) AS region, upper(tier) AS tier, upper(sku_name) AS product_type,
                    max(price_per_dbu) AS list_price_reference FROM {universe}
                  WHERE sku_name IS NOT NULL AND region IS NOT NULL AND tier IS NOT NULL AND {region_filter} GROUP BY 1, 2, 3, 4) u
            LEFT JOIN (SELECT DISTINCT upper(cloud) AS cloud, lower(region_code) AS region, upper(sku_region) AS sku_region FROM ref_sku_region_map) m
              USING (cloud, region)) k
      LEFT JOIN (SELECT upper(cloud) AS cloud, upper(sku_name) AS sku, count(DISTINCT {price}) AS n, min({price}) AS price FROM {prices}
                 WHERE currency_code = 'USD' AND {price} IS NOT NULL AND price_start_time <= {as_of} AND (price_end_time IS NULL OR price_end_time > {as_of})
                 GROUP BY 1, 2) a ON a.cloud = k.cloud AND a.sku = k.regional_sku AND k.sku_region IS NOT NULL
      LEFT JOIN (SELECT upper(cloud) AS cloud, upper(sku_name) AS sku, count(DISTINCT {price}) AS n, min({price}) AS price FROM {prices}
                 WHERE currency_code = 'USD' AND {price} IS NOT NULL AND price_start_time <= {as_of} AND (price_end_time IS NULL OR price_end_time > {as_of})
                 GROUP BY 1, 2) b ON b.cloud = k.cloud AND b.sku = k.global_sku)"""


CTES["card_ref"] = card("ref_dbu_rates", "ref_prices", _AS_OF, "list_default", "GOVERNED", "account_prices")
CTES["inst_ref"] = "SELECT upper(cloud) AS cloud, upper(instance_type) AS instance_type, min(dbu_rate) AS dbu_rate FROM ref_instance_rates GROUP BY 1, 2"
CTES["vm_ref"] = """SELECT upper(cloud) AS cloud, upper(region) AS region, upper(instance_type) AS instance_type, upper(pricing_tier) AS pricing_tier,
 upper(payment_option) AS payment_option, min(cost_per_hour) AS cost_per_hour FROM ref_vm_costs GROUP BY ALL"""
CTES["mult_ref"] = """SELECT upper(cloud) AS cloud, upper(sku_type) AS sku_type, min(multiplier) AS multiplier FROM ref_multipliers WHERE feature = 'photon' GROUP BY 1, 2"""


def inst(cloud: str, node: str) -> str:
    return f"coalesce((SELECT x.dbu_rate FROM inst_ref x WHERE x.cloud = upper({cloud}) AND x.instance_type = upper({node})), 0)"


def vm(cloud: str, region: str, node: str, tier: str = "'on_demand'", option: str = "'NA'") -> str:
    return (f"coalesce((SELECT x.cost_per_hour FROM vm_ref x WHERE x.cloud = upper({cloud}) AND x.region = upper({region}) AND x.instance_type = upper({node}) "
            f"AND x.pricing_tier = upper({tier}) AND x.payment_option = upper(coalesce({option}, 'NA'))), 0)")


def price(cloud: str, region: str, tier: str, product: str, column: str = "price_per_dbu", card_name: str = "card_ref") -> str:
    return (f"(SELECT min(x.{column}) FROM {card_name} x WHERE x.cloud = upper({cloud}) AND x.region = lower({region}) AND x.tier = upper({tier}) "
            f"AND x.product_type = upper({product}))")


def mult(cloud: str, kind: str, edition: str, photon: str, serverless: str) -> str:
    return (f"CASE WHEN NOT coalesce({photon}, false) AND NOT coalesce({serverless}, false) THEN 1.0 ELSE coalesce((SELECT x.multiplier FROM mult_ref x "
            f"WHERE x.cloud = upper({cloud}) AND x.sku_type = CASE upper({kind}) WHEN 'DLT' THEN 'DLT_' || upper(coalesce({edition}, 'CORE')) || '_COMPUTE' "
            f"WHEN 'ALL_PURPOSE' THEN 'ALL_PURPOSE_COMPUTE' ELSE 'JOBS_COMPUTE' END), 1.0) END")


def product(kind: str, serverless: str, photon: str, edition: str, wh: str) -> str:
    return f"""CASE upper({kind})
 WHEN 'JOBS' THEN CASE WHEN coalesce({serverless}, false) THEN 'JOBS_SERVERLESS_COMPUTE' WHEN coalesce({photon}, false) THEN 'JOBS_COMPUTE_(PHOTON)' ELSE 'JOBS_COMPUTE' END
 WHEN 'ALL_PURPOSE' THEN CASE WHEN coalesce({serverless}, false) THEN 'ALL_PURPOSE_SERVERLESS_COMPUTE' WHEN coalesce({photon}, false) THEN 'ALL_PURPOSE_COMPUTE_(PHOTON)' ELSE 'ALL_PURPOSE_COMPUTE' END
 WHEN 'DLT' THEN CASE WHEN coalesce({serverless}, false) THEN 'JOBS_SERVERLESS_COMPUTE' ELSE 'DLT_' || upper(coalesce({edition}, 'CORE')) || '_COMPUTE' || CASE WHEN coalesce({photon}, false) THEN '_(PHOTON)' ELSE '' END END
 WHEN 'DBSQL' THEN CASE upper(coalesce({wh}, '')) WHEN 'SERVERLESS' THEN 'SERVERLESS_SQL_COMPUTE' WHEN 'PRO' THEN 'SQL_PRO_COMPUTE' ELSE 'SQL_COMPUTE' END
 ELSE upper({kind}) || '_COMPUTE' END"""


def hours(kind: str, runs="runs_per_day", minutes="runtime_minutes", days="days_per_month", given="NULL") -> str:
    return (f"CASE WHEN {given} IS NOT NULL THEN {given} WHEN upper({kind}) IN ('VECTOR_SEARCH', 'MODEL_SERVING', 'LAKEBASE') THEN 24.0 * coalesce({days}, 30) "
            f"ELSE coalesce({runs}, 0) * (CAST(coalesce({minutes}, 0) AS DOUBLE) / 60) * coalesce({days}, 30) END")


def status_text(cloud: str, region: str, tier: str, prod: str) -> str:
    def field(c):
        return price(cloud, region, tier, prod, c)
    return f"""CASE WHEN {field('status')} IS NULL THEN 'PENDING - the price card lacks ' || upper({tier}) || ' ' || upper({prod}) || ' in ' || upper({cloud}) || ' ' || lower({region})
 WHEN {field('status')} = 'PENDING' THEN 'PENDING - ' || {field('source')}
 ELSE {field('status')} || ' $' || {fmt(field('price_per_dbu'), 6)} || '/DBU ' || {field('billing_sku')} || ' (' || {field('source')} || ')' END"""
