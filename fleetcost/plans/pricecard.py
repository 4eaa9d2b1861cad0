"""Governed prices: the price card, exact-match quotes, rate-card refresh, comparison, overlay and fallback."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import effective_at
from fleetcost.operators.lookups import attach

# Rate states, and which of them may be used to price.
GOVERNED, OBSERVED, REFERENCE, PENDING = "GOVERNED", "VALIDATED_OBSERVED", "REFERENCE_ONLY", "PENDING"
USABLE = (GOVERNED, OBSERVED, REFERENCE)


def with_pricing_struct(prices: DataFrame) -> DataFrame:
    """Flat price log to the nested form struct<default, effective_list: struct<default>>."""
    pricing = F.struct(F.col("list_default").alias("default"), F.struct(F.col("effective_default").alias("default")).alias("effective_list"))
    return prices.withColumn("pricing", pricing).drop("list_default", "effective_default")


def price_source(source: str) -> tuple[Column, str, str]:
    """(price expression, status, source name) for ACCOUNT_PRICES or LIST_PRICES."""
    if source == "ACCOUNT_PRICES":
        return F.col("pricing.default").cast("double"), GOVERNED, "account_prices"
    return F.coalesce("pricing.effective_list.default", "pricing.default").cast("double"), REFERENCE, "list_prices"


def as_time(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def single_prices(prices: DataFrame, as_of: str, price: Column, where: Column | None = None) -> DataFrame:
    """Per cloud and SKU: number of distinct current USD prices, and the price when there is exactly one.

    The distinct count is two partial aggregations (SKU and price, then SKU), so a SKU holding most of the log is
    already one row per price and task before the first shuffle.
    """
    p = prices.where((F.col("currency_code") == "USD") & price.isNotNull()
                     & effective_at(F.col("price_start_time"), F.col("price_end_time"), as_time(as_of)))
    if where is not None:
        p = p.where(where)
    d = p.select(F.upper("cloud").alias("cloud"), F.upper("sku_name").alias("sku_name"), price.alias("price")).distinct()
    return d.groupBy("cloud", "sku_name").agg(F.count("*").alias("n_prices"), F.min("price").alias("_min")).select(
        "cloud", "sku_name", "n_prices", F.when(F.col("n_prices") == 1, F.col("_min")).alias("price"))


def region_filter(regions: list[str] | None) -> Column:
    """IN-list of lower-cased region names, or no filter for None or ['ALL']."""
    if regions is None or [r.upper() for r in regions] == ["ALL"]:
        return F.lit(True)
    return F.lower("region").isin(*[r.strip().lower() for r in regions])


def sku_keys(universe: DataFrame, region_map: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Distinct cloud, region, tier, product with the regional and the global billing SKU name."""
    k = (universe.where(F.col("sku_name").isNotNull() & F.col("region").isNotNull() & F.col("tier").isNotNull() & region_filter(regions))
         .groupBy(F.upper("cloud").alias("cloud"), F.lower("region").alias("region"), F.upper("tier").alias("tier"),
                  F.upper("sku_name").alias("product_type"))
         .agg(F.max("price_per_dbu").alias("list_price_reference")))
    m = region_map.select(F.upper("cloud").alias("cloud"), F.lower("region_code").alias("region"), F.upper("sku_region").alias("sku_region")).distinct()
    base = F.concat("tier", F.lit("_"), "product_type")
    return k.join(m, ["cloud", "region"], "left").withColumns({
        "global_sku": base, "regional_sku": F.concat(base, F.lit("_"), F.coalesce("sku_region", F.lit("?")))})


def price_card(universe: DataFrame, region_map: DataFrame, prices: DataFrame, as_of: str, source: str = "ACCOUNT_PRICES",
               regions: list[str] | None = None) -> DataFrame:
    """One row per cloud, region, tier, product: exactly one current price (regional SKU first, else global) or PENDING.

    Prices are reduced to one row per SKU before the two lookups, so the joins never multiply rows.
    """
    expr, status, name = price_source(source)
    s = single_prices(prices, as_of, expr)
    k = sku_keys(universe, region_map, regions)
    k = attach(k, s, [(F.col("cloud"), F.col("cloud")), (F.when(F.col("sku_region").isNotNull(), F.col("regional_sku")), F.col("sku_name"))],
               {"reg_n": F.col("n_prices"), "reg_price": F.col("price")})
    k = attach(k, s, [(F.col("cloud"), F.col("cloud")), (F.col("global_sku"), F.col("sku_name"))],
               {"glob_n": F.col("n_prices"), "glob_price": F.col("price")})
    regional = F.col("reg_n").isNotNull()
    n = F.coalesce("reg_n", "glob_n", F.lit(0))
    sku = F.when(regional, F.col("regional_sku")).otherwise(F.col("global_sku"))
    price = F.when(regional, F.col("reg_price")).otherwise(F.col("glob_price"))
    either = F.when((n == 0) & F.col("sku_region").isNotNull(), F.concat(F.lit(" or "), F.col("regional_sku"))).otherwise(F.lit(""))
    reason = F.concat(F.lit(f"{name}: expected one current price for "), sku, either, F.lit(", found "), n.cast("string"))
    return k.select("cloud", "region", "tier", "product_type", sku.alias("billing_sku"), price.alias("price_per_dbu"),
                    F.when(n == 1, F.lit(status)).otherwise(F.lit(PENDING)).alias("status"),
                    F.when(n == 1, F.lit(name)).otherwise(reason).alias("source"), "list_price_reference")


def quotes(rate_card: DataFrame, as_of: str) -> DataFrame:
    """One row per exact key: matches, and the usable rate with its warning, or PENDING with the reason."""
    live = rate_card.where(effective_at(F.col("effective_start"), F.col("effective_end"), F.lit(as_of)))
    keys = ("provider", "sku", "unit", "region")
    g = live.groupBy(*[F.upper(k).alias(f"q_{k}") for k in keys]).agg(
        F.count("*").alias("matches"), F.min(F.struct("status", "source", "rate", "notes", "sku")).alias("r"))
    one = F.col("matches") == 1
    usable = one & F.col("r.status").isin(*USABLE) & F.col("r.rate").isNotNull()
    return g.select(
        *[f"q_{k}" for k in keys], "matches", F.when(usable, F.col("r.rate")).alias("quote_rate"),
        F.when(usable, F.col("r.status")).otherwise(F.lit(PENDING)).alias("quote_status"),
        F.when(one, F.col("r.source")).otherwise(F.lit("")).alias("quote_source"),
        F.when(usable & (F.col("r.status") == REFERENCE), F.col("r.notes"))
        .when(one & ~usable, F.concat(F.lit("Rate "), F.col("r.sku"), F.lit(" is not usable ("), F.col("r.status"), F.lit(")."))).alias("quote_warning"))


def with_quote(df: DataFrame, rate_card: DataFrame, as_of: str, provider="provider", sku="sku", unit="unit", region="region") -> DataFrame:
    """Exact-match quote for every row: quote_rate, quote_status, quote_source, quote_warning. No substitution."""
    from fleetcost.functions.columns import col
    p, s, u, r = (col(x) for x in (provider, sku, unit, region))
    on = ((F.upper(p) == F.col("q_provider")) & (F.upper(s) == F.col("q_sku")) & (F.upper(u) == F.col("q_unit")) & (F.upper(r) == F.col("q_region")))
    d = df.join(quotes(rate_card, as_of), on, "left")
    n = F.coalesce("matches", F.lit(0))
    none = F.concat(F.lit("No unambiguous rate for "), p, F.lit("/"), s, F.lit("/"), u, F.lit("/"), r, F.lit(" (matches="), n.cast("string"), F.lit(")."))
    return d.withColumns({
        "quote_status": F.coalesce("quote_status", F.lit(PENDING)), "quote_source": F.coalesce("quote_source", F.lit("")),
        "quote_warning": F.when(n != 1, none).otherwise(F.col("quote_warning"))}).drop("matches", "q_provider", "q_sku", "q_unit", "q_region")


def conversions(table: DataFrame, as_of: str) -> DataFrame:
    """One row per model and serving mode: the single publishable conversion, or the reason why there is none."""
    live = table.where(effective_at(F.col("effective_start"), F.col("effective_end"), F.lit(as_of)))
    g = live.groupBy(F.col("model").alias("m_model"), F.col("serving_mode").alias("m_mode")).agg(
        F.count("*").alias("m_matches"),
        F.min(F.struct("status", "account_sku", "input_dbu_per_million", "output_dbu_per_million", "cache_dbu_per_million")).alias("c"))
    ok = (F.col("m_matches") == 1) & F.col("c.status").isin(GOVERNED, OBSERVED)
    return g.select(
        "m_model", "m_mode", "m_matches", ok.alias("m_ok"),
        *[F.when(ok, F.col(f"c.{n}")).alias(f"m_{n}") for n in ("account_sku", "input_dbu_per_million", "output_dbu_per_million", "cache_dbu_per_million")],
        F.when((F.col("m_matches") == 1) & ~ok, F.concat(F.lit("Conversion for "), "m_model", F.lit(" is "), F.col("c.status"), F.lit("; not publishable."))).alias("m_reason"))


def with_conversion(df: DataFrame, table: DataFrame, as_of: str, model="model", mode="serving_mode") -> DataFrame:
    d = df.join(conversions(table, as_of), (F.col(model) == F.col("m_model")) & (F.col(mode) == F.col("m_mode")), "left")
    none = F.concat(F.lit("No unambiguous conversion of model "), F.col(model), F.lit(" ("), F.col(mode), F.lit(")."))
    return d.withColumns({"m_ok": F.coalesce("m_ok", F.lit(False)),
                          "m_reason": F.when(F.coalesce("m_matches", F.lit(0)) != 1, none).otherwise(F.col("m_reason"))}).drop("m_model", "m_mode", "m_matches")


def refresh_rate_card(seed: DataFrame, prices: DataFrame, as_of: str, sku_region: str, source: str = "ACCOUNT_PRICES",
                      region: str = "US_EAST_1") -> DataFrame:
    """Re-price the platform DBU rows from current prices; the old rate stays as observed_rate, other rows are untouched."""
    expr, status, name = price_source(source)
    live = single_prices(prices, as_of, expr, (F.upper("cloud") == "AWS") & (F.col("usage_unit") == "DBU"))
    mine = (F.col("provider") == "PLATFORM") & (F.col("unit") == "DBU") & (F.col("region") == region) & F.col("billing_sku").isNotNull()
    full = F.concat(F.col("billing_sku"), F.lit(f"_{sku_region.upper()}"))
    d = attach(seed.withColumn("_mine", mine), live, [(F.when(mine, full), F.col("sku_name"))], {"live_n": F.col("n_prices"), "live": F.col("price")})
    n = F.coalesce("live_n", F.lit(0))
    priced = F.col("_mine") & (n == 1)

    def pick(new, old):
        return F.when(F.col("_mine"), new).otherwise(F.col(old)).alias(old)

    return d.select(
        "provider", "service", "sku", "unit", "region", F.when(F.col("_mine"), F.col("live")).otherwise(F.col("rate")).alias("rate"),
        pick(F.when(priced, F.lit(status)).otherwise(F.lit(PENDING)), "status"),
        pick(F.when(priced, F.lit(name)).otherwise(F.concat(F.lit(f"{name}: expected one current price for "), full, F.lit(", found "), n.cast("string"))), "source"),
        "effective_start", "effective_end", F.when(F.col("_mine"), F.col("rate")).otherwise(F.col("observed_rate")).alias("observed_rate"),
        pick(F.lit("" if source == "ACCOUNT_PRICES" else "List price used for testing."), "notes"),
        F.when(F.col("_mine"), full).alias("billing_sku"))


def compare_rates(approved: DataFrame, prices: DataFrame, as_of: str, region: str = "US_EAST_1") -> DataFrame:
    """Approved against live price per platform SKU: MATCH, DIFFERS or NO SINGLE LIVE ROW."""
    live = single_prices(prices, as_of, price_source("ACCOUNT_PRICES")[0], (F.upper("cloud") == "AWS") & (F.upper("usage_unit") == "DBU"))
    a = approved.where((F.col("provider") == "PLATFORM") & (F.col("unit") == "DBU") & (F.upper("region") == region))
    d = attach(a, live, [(F.upper("sku"), F.col("sku_name"))], {"live_rate": F.col("price")})
    result = (F.when(F.col("live_rate").isNull(), F.lit("NO SINGLE LIVE ROW"))
              .when(F.abs(F.col("rate") - F.col("live_rate")) < 1e-9, F.lit("MATCH")).otherwise(F.lit("DIFFERS")))
    return d.select("sku", F.col("rate").alias("approved_rate"), F.col("status").alias("approved_status"), "live_rate", result.alias("result"))


def overlay_quote(df: DataFrame, rate_card: DataFrame, prices: DataFrame, as_of: str, live_as_of: str, region: str = "US_EAST_1") -> DataFrame:
    """A single live price wins over the base quote (platform DBU rows of one region only); a difference is a warning."""
    live = single_prices(prices, live_as_of, price_source("ACCOUNT_PRICES")[0], (F.upper("cloud") == "AWS") & (F.upper("usage_unit") == "DBU"))
    mine = (F.upper("provider") == "PLATFORM") & (F.upper("unit") == "DBU") & (F.upper("region") == region)
    d = attach(with_quote(df, rate_card, as_of), live, [(F.when(mine, F.upper("sku")), F.col("sku_name"))], {"live_rate": F.col("price")})
    is_live = F.col("live_rate").isNotNull()
    differs = F.col("quote_rate").isNotNull() & (F.abs(F.col("quote_rate") - F.col("live_rate")) > 1e-9)
    return d.withColumns({
        "quote_warning": F.when(is_live & differs, F.concat(F.lit("Live rate of "), F.col("sku"), F.lit(" differs from the approved list.")))
        .when(~is_live, F.col("quote_warning")),
        "quote_rate": F.coalesce("live_rate", "quote_rate"),
        "quote_status": F.when(is_live, F.lit(GOVERNED)).otherwise(F.col("quote_status")),
        "quote_source": F.when(is_live, F.lit("account_prices (live)")).otherwise(F.col("quote_source"))}).drop("live_rate")


def fallback_quote(df: DataFrame, primary: DataFrame, fallback: DataFrame, as_of: str) -> DataFrame:
    """The primary quote when usable, else the whole quote of the fallback."""
    cols = ("quote_rate", "quote_status", "quote_source", "quote_warning")
    a = with_quote(df, primary, as_of).withColumnsRenamed({c: f"p_{c}" for c in cols})
    b = with_quote(a, fallback, as_of)
    first = F.col("p_quote_rate").isNotNull()
    return b.withColumns({c: F.when(first, F.col(f"p_{c}")).otherwise(F.col(c)) for c in cols}).drop(*[f"p_{c}" for c in cols])
