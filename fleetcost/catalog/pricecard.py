"""Price card, quotes and rate-card upkeep (PRC), and the joins they rest on."""
from fleetcost.catalog.registry import F, query, rounded
from fleetcost.oracle.base import CTES, rn, rounded as r
from fleetcost.oracle.prices import card
from fleetcost.plans import pricecard as pc
from fleetcost.sources.inputs import PRICE_AS_OF

RATES_AS_OF = "2026-06-01"
_T = f"TIMESTAMP '{PRICE_AS_OF} 00:00:00'"
_LIVE = f"price_start_time <= {_T} AND (price_end_time IS NULL OR price_end_time > {_T})"


def _log(i, name="price_log"):
    return pc.with_pricing_struct(i(name))


_CARD = card("price_universe", "price_log", _T, "list_default", "GOVERNED", "account_prices")
CTES["card_log"] = _CARD


@query("price_card", f"SELECT cloud, region, tier, product_type, billing_sku, {r('price_per_dbu list_price_reference')}, status, source FROM card_log")
def price_card(i):
    d = pc.price_card(i("price_universe"), i.ref.sku_region_map, _log(i), PRICE_AS_OF)
    return rounded(d, "price_per_dbu list_price_reference")


@query("price_source_expr", "SELECT cloud, region, tier, product_type, billing_sku, " + r("price_per_dbu") + ", status, source FROM ("
       + card("price_universe", "price_log", _T, "coalesce(effective_default, list_default)", "REFERENCE_ONLY", "list_prices") + ")")
def price_source_expr(i):
    d = pc.price_card(i("price_universe"), i.ref.sku_region_map, _log(i), PRICE_AS_OF, "LIST_PRICES")
    return rounded(d, "price_per_dbu").drop("list_price_reference")


@query("flt_regions", "SELECT cloud, region, tier, product_type, billing_sku, " + r("price_per_dbu") + ", status FROM ("
       + card("price_universe", "price_log", _T, "list_default", "GOVERNED", "account_prices", "lower(region) IN ('us-east-1', 'westeurope')") + ")")
def regions(i):
    d = pc.price_card(i("price_universe"), i.ref.sku_region_map, _log(i), PRICE_AS_OF, regions=["us-east-1", "WestEurope "])
    return rounded(d, "price_per_dbu").drop("list_price_reference", "source")


@query("price_sku_key", """SELECT DISTINCT cloud, region, tier, product_type, tier || '_' || product_type AS global_sku, tier || '_' || product_type || '_' || coalesce(sku_region, '?') AS regional_sku
 FROM (SELECT upper(cloud) AS cloud, lower(region) AS region, upper(tier) AS tier, upper(sku_name) AS product_type FROM price_universe WHERE sku_name IS NOT NULL AND region IS NOT NULL AND tier IS NOT NULL)
 LEFT JOIN (SELECT upper(cloud) AS cloud, lower(region_code) AS region, upper(sku_region) AS sku_region FROM ref_sku_region_map) USING (cloud, region)""")
def sku_key(i):
    return pc.sku_keys(i("price_universe"), i.ref.sku_region_map).select("cloud", "region", "tier", "product_type", "global_sku", "regional_sku")


@query("flt_effective_at", f"SELECT sku_name, cloud, count(*) AS live_rows, {rn('min(list_default)')} AS lowest, {rn('max(list_default)')} AS highest FROM price_log WHERE {_LIVE} GROUP BY 1, 2")
def effective_at(i):
    from fleetcost.functions import effective_at as eff
    d = i("price_log").where(eff(F.col("price_start_time"), F.col("price_end_time"), pc.as_time(PRICE_AS_OF)))
    return rounded(d.groupBy("sku_name", "cloud").agg(F.count("*").alias("live_rows"), F.min("list_default").alias("lowest"), F.max("list_default").alias("highest")), "lowest highest")


CTES["live_log"] = f"""SELECT upper(cloud) AS cloud, upper(sku_name) AS sku_name, count(DISTINCT list_default) AS n_prices, CASE WHEN count(DISTINCT list_default) = 1 THEN min(list_default) END AS price
 FROM price_log WHERE currency_code = 'USD' AND list_default IS NOT NULL AND {_LIVE} GROUP BY 1, 2"""


@query("ag_exactly_one", f"SELECT cloud, sku_name, n_prices, {r('price')} FROM live_log")
def exactly_one(i):
    return rounded(pc.single_prices(_log(i), PRICE_AS_OF, pc.price_source("ACCOUNT_PRICES")[0]), "price")


@query("jn_priority_keys", f"""SELECT c.l_orderkey, c.l_linenumber, coalesce(a.n_prices, g.n_prices, 0) AS n_prices, {rn('CASE WHEN a.n_prices IS NOT NULL THEN a.price ELSE g.price END')} AS price
 FROM (SELECT l_orderkey, l_linenumber, 'AWS' AS cloud, 'ENTERPRISE_PRODUCT_' || CAST(l_partkey % 40 AS VARCHAR) AS base FROM lineitem) c
 LEFT JOIN live_log a ON a.cloud = c.cloud AND a.sku_name = c.base || '_US_EAST_A' LEFT JOIN live_log g ON g.cloud = c.cloud AND g.sku_name = c.base""")
def priority_keys(i):
    from fleetcost.operators.lookups import attach
    s = pc.single_prices(_log(i), PRICE_AS_OF, pc.price_source("ACCOUNT_PRICES")[0])
    base = F.concat(F.lit("ENTERPRISE_PRODUCT_"), (F.col("l_partkey") % 40).cast("string"))
    d = i("rate_questions").select("l_orderkey", "l_linenumber", F.lit("AWS").alias("cloud"), base.alias("base"))
    for out, key in (("reg", F.concat("base", F.lit("_US_EAST_A"))), ("glob", F.col("base"))):
        d = attach(d, s, [(F.col("cloud"), F.col("cloud")), (key, F.col("sku_name"))], {f"{out}_n": F.col("n_prices"), f"{out}_price": F.col("price")})
    price = F.when(F.col("reg_n").isNotNull(), F.col("reg_price")).otherwise(F.col("glob_price"))
    return rounded(d.select("l_orderkey", "l_linenumber", F.coalesce("reg_n", "glob_n", F.lit(0)).alias("n_prices"), price.alias("price")), "price")


def _live_account(price: str, t: str = _T) -> str:
    return f"""SELECT upper(sku_name) AS sku_name, count(DISTINCT {price}) AS n, CASE WHEN count(DISTINCT {price}) = 1 THEN min({price}) END AS live_rate FROM account_price_log
 WHERE upper(cloud) = 'AWS' AND usage_unit = 'DBU' AND currency_code = 'USD' AND {price} IS NOT NULL AND price_start_time <= {t} AND (price_end_time IS NULL OR price_end_time > {t}) GROUP BY 1"""


CTES["live_account"] = _live_account("list_default")
_MINE = "provider = 'PLATFORM' AND unit = 'DBU' AND region = 'US_EAST_1' AND billing_sku IS NOT NULL"
CTES["refreshed"] = f"""SELECT c.provider, c.service, c.sku, c.unit, c.region, CASE WHEN mine THEN live_rate ELSE rate END AS rate,
 CASE WHEN NOT mine THEN status WHEN live_rate IS NOT NULL THEN 'GOVERNED' ELSE 'PENDING' END AS status,
 CASE WHEN NOT mine THEN source WHEN live_rate IS NOT NULL THEN 'account_prices' ELSE 'account_prices: expected one current price for ' || full_sku || ', found ' || CAST(coalesce(n, 0) AS VARCHAR) END AS source,
 effective_start, effective_end, CASE WHEN mine THEN rate ELSE observed_rate END AS observed_rate, CASE WHEN mine THEN '' ELSE notes END AS notes,
 CASE WHEN mine THEN full_sku END AS billing_sku
 FROM (SELECT *, ({_MINE}) AS mine, billing_sku || '_US_EAST_A' AS full_sku FROM ref_rate_card) c LEFT JOIN live_account l ON mine AND l.sku_name = c.full_sku"""


def _refreshed(i):
    return pc.refresh_rate_card(i.ref.rate_card, _log(i, "account_price_log"), PRICE_AS_OF, "us_east_a")


@query("rate_card_refresh", "SELECT * FROM refreshed")
def rate_card_refresh(i):
    return _refreshed(i)


@query("rate_card_pending", "SELECT provider, sku, unit, region, status, source FROM refreshed WHERE rate IS NULL")
def rate_card_pending(i):
    return _refreshed(i).where("rate IS NULL").select("provider", "sku", "unit", "region", "status", "source")


@query("tk_ordered_listing", "SELECT provider, sku, unit, region, rate, status, observed_rate FROM refreshed ORDER BY provider, sku")
def ordered_listing(i):
    return _refreshed(i).select("provider", "sku", "unit", "region", "rate", "status", "observed_rate").orderBy("provider", "sku")


@query("rate_card_compare", """SELECT sku, rate AS approved_rate, status AS approved_status, live_rate, CASE WHEN live_rate IS NULL THEN 'NO SINGLE LIVE ROW' WHEN abs(rate - live_rate) < 1e-9 THEN 'MATCH' ELSE 'DIFFERS' END AS result
 FROM ref_rate_card LEFT JOIN live_account ON sku_name = upper(sku) WHERE provider = 'PLATFORM' AND unit = 'DBU' AND region = 'US_EAST_1'""")
def rate_card_compare(i):
    return pc.compare_rates(i.ref.rate_card, _log(i, "account_price_log"), PRICE_AS_OF)


def quote_cte(table: str, as_of: str = RATES_AS_OF) -> str:
    return f"""SELECT upper(provider) AS q_provider, upper(sku) AS q_sku, upper(unit) AS q_unit, upper(region) AS q_region, count(*) AS n, min(rate) AS rate, min(status) AS status,
 min(source) AS source, min(notes) AS notes, min(sku) AS card_sku FROM {table} WHERE effective_start <= '{as_of}' AND (effective_end IS NULL OR effective_end > '{as_of}') GROUP BY 1, 2, 3, 4"""


CTES["quote_ref"] = quote_cte("ref_rate_card")
_OK = "(n = 1 AND status IN ('GOVERNED', 'VALIDATED_OBSERVED', 'REFERENCE_ONLY') AND rate IS NOT NULL)"


def quoted(src: str, quote: str = "quote_ref") -> str:
    """Rows of `src` (provider, sku, unit, region) with their quote."""
    return f"""SELECT b.* EXCLUDE (n, rate, status, source, notes, card_sku, q_provider, q_sku, q_unit, q_region), CASE WHEN ok THEN rate END AS quote_rate, CASE WHEN ok THEN status ELSE 'PENDING' END AS quote_status,
 CASE WHEN n = 1 THEN source ELSE '' END AS quote_source,
 CASE WHEN coalesce(n, 0) <> 1 THEN 'No unambiguous rate for ' || provider || '/' || sku || '/' || unit || '/' || region || ' (matches=' || CAST(coalesce(n, 0) AS VARCHAR) || ').'
      WHEN NOT ok THEN 'Rate ' || card_sku || ' is not usable (' || status || ').' WHEN status = 'REFERENCE_ONLY' THEN notes END AS quote_warning
 FROM (SELECT s.*, q.*, coalesce({_OK.replace('status', 'q.status').replace('rate IS', 'q.rate IS')}, false) AS ok FROM {src} s LEFT JOIN {quote} q
   ON q.q_provider = upper(s.provider) AND q.q_sku = upper(s.sku) AND q.q_unit = upper(s.unit) AND q.q_region = upper(s.region)) b"""


_QCOLS = "l_orderkey, l_linenumber, provider, sku, unit, region, quote_rate, quote_status, quote_source, quote_warning"


@query("rate_quote", f"SELECT {_QCOLS} FROM ({quoted('rate_questions')})")
def rate_quote(i):
    return pc.with_quote(i("rate_questions"), i.ref.rate_card, RATES_AS_OF).select(*_QCOLS.split(", "))


@query("rate_overlay", f"""SELECT l_orderkey, l_linenumber, provider, sku, unit, region, coalesce(live_rate, quote_rate) AS quote_rate, CASE WHEN live_rate IS NOT NULL THEN 'GOVERNED' ELSE quote_status END AS quote_status,
 CASE WHEN live_rate IS NOT NULL THEN 'account_prices (live)' ELSE quote_source END AS quote_source,
 CASE WHEN live_rate IS NULL THEN quote_warning WHEN quote_rate IS NOT NULL AND abs(quote_rate - live_rate) > 1e-9 THEN 'Live rate of ' || sku || ' differs from the approved list.' END AS quote_warning
 FROM ({quoted('rate_questions')}) q LEFT JOIN live_account l ON l.sku_name = upper(q.sku) AND upper(provider) = 'PLATFORM' AND upper(unit) = 'DBU' AND upper(region) = 'US_EAST_1'""")
def rate_overlay(i):
    d = pc.overlay_quote(i("rate_questions"), i.ref.rate_card, _log(i, "account_price_log"), RATES_AS_OF, PRICE_AS_OF)
    return d.select(*_QCOLS.split(", "))


CTES["primary_card"] = "SELECT * REPLACE (rate + 1 AS rate) FROM ref_rate_card WHERE service IN ('JOBS', 'SQL', 'DATASYNC')"
CTES["quote_primary"] = quote_cte("primary_card")


@query("rate_fallback", f"""SELECT a.l_orderkey, a.l_linenumber, a.sku, a.region, {', '.join(f'CASE WHEN a.quote_rate IS NOT NULL THEN a.{c} ELSE b.{c} END AS {c}' for c in ('quote_rate', 'quote_status', 'quote_source', 'quote_warning'))}
 FROM ({quoted('rate_questions', 'quote_primary')}) a JOIN ({quoted('rate_questions')}) b USING (l_orderkey, l_linenumber, l_partkey, quantity)""")
def rate_fallback(i):
    primary = i.ref.rate_card.where(F.col("service").isin("JOBS", "SQL", "DATASYNC")).withColumn("rate", F.col("rate") + 1)
    d = pc.fallback_quote(i("rate_questions"), primary, i.ref.rate_card, RATES_AS_OF)
    return d.select("l_orderkey", "l_linenumber", "sku", "region", "quote_rate", "quote_status", "quote_source", "quote_warning")


CTES["conversion_ref"] = f"""SELECT model AS m_model, serving_mode AS m_mode, count(*) AS m_n, min(status) AS m_status, min(account_sku) AS m_account_sku, min(input_dbu_per_million) AS m_input,
 min(output_dbu_per_million) AS m_output FROM ref_model_conversions WHERE effective_start <= '{RATES_AS_OF}' AND (effective_end IS NULL OR effective_end > '{RATES_AS_OF}') GROUP BY 1, 2"""


@query("model_conversion", """SELECT o_orderkey, model, serving_mode, ok, CASE WHEN ok THEN m_account_sku END AS account_sku, CASE WHEN ok THEN m_input END AS input_dbu, CASE WHEN ok THEN m_output END AS output_dbu,
 CASE WHEN coalesce(m_n, 0) <> 1 THEN 'No unambiguous conversion of model ' || model || ' (' || serving_mode || ').' WHEN NOT ok THEN 'Conversion for ' || model || ' is ' || m_status || '; not publishable.' END AS reason
 FROM (SELECT *, coalesce(m_n = 1 AND m_status IN ('GOVERNED', 'VALIDATED_OBSERVED'), false) AS ok FROM model_questions LEFT JOIN conversion_ref ON m_model = model AND m_mode = serving_mode)""")
def model_conversion(i):
    d = pc.with_conversion(i("model_questions"), i.ref.model_conversions, RATES_AS_OF)
    return d.select("o_orderkey", "model", "serving_mode", F.col("m_ok").alias("ok"), F.col("m_account_sku").alias("account_sku"),
                    F.col("m_input_dbu_per_million").alias("input_dbu"), F.col("m_output_dbu_per_million").alias("output_dbu"), F.col("m_reason").alias("reason"))
