"""Joins on aliases, validity windows, overlapping intervals and alternative keys."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alias_map(profiles: DataFrame) -> DataFrame:
    """One row per accepted name (the key itself or an alias), so an alias join is an equi-join."""
    names = F.array_union(F.array("profile"), F.split("aliases", ","))
    return profiles.select(F.explode(names).alias("name"), *profiles.columns)


def price_windows(prices: DataFrame) -> DataFrame:
    """One row per SKU, cloud and unit: `p_bounds`, the times at which its valid USD prices change, sorted, and `p_valid`, the prices that
    are valid from each of them on (none in a gap, several where windows overlap)."""
    windows = prices.where("currency_code = 'USD' AND price_start_time IS NOT NULL").groupBy(F.col("sku_name").alias("p_sku"), F.col("cloud").alias("p_cloud"), F.col("usage_unit").alias("p_unit")).agg(
        F.collect_list(F.struct(F.col("price_start_time").alias("start"), F.col("price_end_time").alias("end"), F.col("price").alias("price"))).alias("w"))
    ends = F.filter(F.transform("w", lambda x: x.end), lambda t: t.isNotNull())
    bounds = F.array_sort(F.array_distinct(F.concat(F.transform("w", lambda x: x.start), ends)))
    # two levels, as one expression would work the bounds out again for each of them
    d = windows.select("p_sku", "p_cloud", "p_unit", "w", bounds.alias("p_bounds"))
    valid = F.transform("p_bounds", lambda t: F.transform(F.filter("w", lambda x: (x.start <= t) & (x.end.isNull() | (t < x.end))), lambda x: F.struct(x.price.alias("price"))))
    return d.select("p_sku", "p_cloud", "p_unit", "p_bounds", valid.alias("p_valid"))


def _not_after(bounds: str, t: str):
    """How many of the sorted bounds are not after t, by halving."""
    def halve(acc, _):
        middle, open_ = F.shiftright(acc.lo + acc.hi, 1), acc.lo < acc.hi
        right = F.coalesce(F.get(bounds, middle) <= F.col(t), F.lit(False))
        return F.struct(F.when(open_ & right, middle + 1).otherwise(acc.lo).alias("lo"), F.when(open_ & ~right, middle).otherwise(acc.hi).alias("hi"))
    size = F.size(bounds)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda acc: acc.lo)


def effective_price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with p_sku and unit_price, the USD price valid at their start: both NULL where none is, a row for each where several are.
    `prices` has sku_name, cloud, usage_unit, currency_code, price_start_time, price_end_time and price.

    The windows of a SKU are one sorted array that each usage row searches. The arrays are one row per SKU, cloud and unit; Spark broadcasts them while
    their size is below its threshold, so usage stays where it was read however many rows a SKU has. Beyond that it joins on the three keys, and a hot SKU's
    usage can be split, as the other side has one row for it.
    """
    w = price_windows(prices)
    d = usage.join(w, (F.col("sku_name") == F.col("p_sku")) & (F.col("cloud") == F.col("p_cloud")) & (F.col("usage_unit") == F.col("p_unit")), "left")
    d = d.withColumn("p_at", F.explode_outer(F.get("p_valid", _not_after("p_bounds", "usage_start_time") - 1)))
    return d.select(*[F.col(f"`{c}`") for c in usage.columns], F.when(F.col("p_at").isNotNull(), F.col("p_sku")).alias("p_sku"), F.col("p_at.price").alias("unit_price"))


def _hours(start: str, end: str, until: str | None):
    """Clock hours of an interval. No overlap begins after `until`, so a very long or never closed interval stays short."""
    def hour(c):
        return F.floor(F.unix_timestamp(c) / 3600)
    last = hour(end) if until is None else F.least(hour(end), hour(F.lit(until).cast("timestamp_ntz")))
    return F.sequence(hour(start), F.greatest(hour(start), last))


def interval_overlap(left: DataFrame, right: DataFrame, key: str, l_span: tuple[str, str], r_span: tuple[str, str], until: str | None = None) -> DataFrame:
    """Pairs of rows with the same key whose intervals overlap, with the overlap in hours.

    Both sides are cut into clock hours and joined on key and hour, so a key with very many rows is spread over its hours.
    A pair that shares several hours is kept only in the hour in which the overlap starts. Where all intervals start before `until`, as in a
    look-back window, hours after it are not listed; the result is the same.
    """
    ls, le = l_span
    rs, re_ = r_span
    a = left.withColumn("_h", F.explode(_hours(ls, le, until)))
    b = right.withColumn("_h", F.explode(_hours(rs, re_, until)))
    first = F.greatest(F.col(ls), F.col(rs))
    d = a.join(b, [key, "_h"]).where((F.col(rs) < F.col(le)) & (F.col(re_) > F.col(ls)) & (F.floor(F.unix_timestamp(first) / 3600) == F.col("_h")))
    hours = (F.unix_timestamp(F.least(F.col(re_), F.col(le))) - F.unix_timestamp(first)) / 3600
    return d.withColumn("overlap_hours", hours.cast("double")).drop("_h")


def either_key(df: DataFrame, runs: DataFrame, task_map: DataFrame, run_ref: str, task_ref: str, out: str) -> DataFrame:
    """Run id by direct reference, else through the task. Both right sides are made unique first.

    A row without a reference matches nothing; it goes to a partition by a hash of the row, so those rows don't meet in one task.
    """
    spread = F.concat(F.lit("\x00"), F.xxhash64(*df.columns).cast("string"))
    r = runs.select(F.col("run_id").alias("_run")).distinct()
    m = task_map.groupBy(F.col("task_run_id").alias("_task")).agg(F.min("run_id").alias("_via"))
    d = df.join(r, F.coalesce(F.col(run_ref).cast("string"), spread) == F.col("_run"), "left").join(m, F.coalesce(F.col(task_ref).cast("string"), spread) == F.col("_task"), "left")
    return d.withColumn(out, F.coalesce("_run", "_via")).drop("_run", "_via", "_task")
