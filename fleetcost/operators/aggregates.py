"""Order statistics that no single task has to hold: exact quantiles, time split, peak concurrency.

Each works on counts of equal values (merged before the shuffle) and sorts only inside a part of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcost.sources import sinks

BOUND = 20_000      # different values of one group that a task sorts
PARTS = 1_024       # parts into which a range of values is cut


def exact_quantiles(df: DataFrame, group: str, value: str, probs: dict[str, float], rows: str | None = None, bound: int = BOUND, parts: int = PARTS) -> DataFrame:
    """Linear-interpolated quantiles per group, ignoring NULL and non-finite values; one column per name in `probs`. With `rows`, a column
    of that name counts all rows of the group.

    The input is read once: equal values are counted before the shuffle, and the counts are written. Each wanted position then starts
    with the range of all its group's values. While a range holds more than `bound` different ones it is cut into equal parts, the parts are counted,
    and the part that holds the position is the new range, from its smallest to its largest value; so the range shrinks each time. Parts are of
    equal width and, every other time, of equal ratio from the smallest value on, for values over many orders of magnitude. Only what is left is sorted. Positions are rows of a table: neither groups nor values come to the driver.
    """
    x, spark = F.col(value).cast("double"), df.sparkSession
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def saved(d: DataFrame) -> DataFrame:
        return sinks.overwrite(d, sinks.shared_folder(spark))
    v = saved(df.groupBy(F.col(group).alias("g"), F.when(good, x).alias("x")).agg(F.count("*").alias("c")))
    some = F.col("x").isNotNull()
    total = saved(v.groupBy("g").agg(F.sum("c").alias("rows"), F.sum(F.when(some, F.col("c"))).alias("n"), F.count("x").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    place = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(p)).alias("z")) for name, p in probs.items()]))
    wanted = total.where("d > 0").select("g", "d", "lo", "hi", place.alias("q")).select("g", "d", "lo", "hi", "q.name", "q.z")
    state = saved(wanted.select("g", F.explode(F.array_distinct(F.array(F.floor("z"), F.ceil("z")))).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), "d").distinct())
    log = False
    while True:
        large = state.where(F.col("d") > bound)
        if large.isEmpty():
            break
        r = large.select(F.col("g").alias("r_g"), "lo", "hi", "before").distinct()
        along = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        if log:
            along = F.log1p(along * 2.0 ** 50) / F.log1p(F.lit(2.0 ** 50))
        log = not log
        part = F.least(F.floor(along * parts), F.lit(parts - 1))
        hist = (v.join(r, F.col("g").eqNullSafe(F.col("r_g")) & F.col("x").between(F.col("lo"), F.col("hi"))).groupBy("r_g", F.col("lo").alias("r_lo"), F.col("before").alias("r_before"), part.alias("b"))
                .agg(F.sum("c").alias("n"), F.count("*").alias("p_d"), F.min("x").alias("p_lo"), F.max("x").alias("p_hi")))
        upto = F.sum("n").over(Window.partitionBy("r_g", "r_lo").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("p_before", F.col("r_before") + upto - F.col("n"))
        holds = (F.col("p_before") <= F.col("rank")) & (F.col("rank") < F.col("p_before") + F.col("n"))
        found = large.join(hist, F.col("g").eqNullSafe(F.col("r_g")) & (F.col("lo") == F.col("r_lo")) & holds)
        state = saved(state.where(F.col("d") <= bound).unionByName(found.select("g", "rank", F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi"), F.col("p_before").alias("before"), F.col("p_d").alias("d"))))
    r = state.select(F.col("g").alias("r_g"), "lo", "hi", "before").distinct()
    upto = F.sum("c").over(Window.partitionBy("r_g", "lo").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    sorted_ = v.join(r, F.col("g").eqNullSafe(F.col("r_g")) & F.col("x").between(F.col("lo"), F.col("hi"))).select("r_g", F.col("lo").alias("r_lo"), "x", "c", (F.col("before") + upto - F.col("c")).alias("first"))
    at = state.join(sorted_, F.col("g").eqNullSafe(F.col("r_g")) & (F.col("lo") == F.col("r_lo")) & (F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("first") + F.col("c"))).select("r_g", "rank", F.col("x").alias("at"))
    met = wanted.join(at, F.col("g").eqNullSafe(F.col("r_g")) & F.col("rank").isin(F.floor("z"), F.ceil("z"))).groupBy("g", "name", "z").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    val = F.col("a") + (F.col("b") - F.col("a")) * (F.col("z") - F.floor("z"))
    q = met.groupBy(F.col("g").alias("r_g")).agg(*[F.max(F.when(F.col("name") == n, val)).alias(n) for n in probs])
    return total.join(q, F.col("g").eqNullSafe(F.col("r_g")), "left").select(F.col("g").alias(group), *probs, *([F.col("rows").alias(rows)] if rows else []))


def time_split(df: DataFrame, group: str, t: str, older: float) -> DataFrame:
    """Add `split`: OLDER where percent_rank of `t` within the group is below `older`, else NEWER.

    Only the cut-off time of each group is searched for: minutes are counted, one row per minute is accumulated, and the
    times of the single boundary minute are ranked. The cut-offs, one per group, are one map value that the projection of the
    rows looks up, so the rows themselves are neither sorted nor shuffled.
    """
    c = (df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(t).alias("t")).agg(F.count("*").alias("c"))
         .withColumn("m", F.date_trunc("minute", "t")))
    w = Window.partitionBy("g").orderBy("m")
    minutes = c.groupBy("g", "m").agg(F.sum("c").alias("n")).select(
        "g", "m", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("g")).alias("total"))
    rank = F.col("before") / F.greatest(F.col("total") - 1, F.lit(1))
    edge = minutes.where(rank < older).groupBy("g").agg(F.max_by(F.struct("m", "before", "total"), "m").alias("e")).select("g", "e.*")
    inside = c.join(edge, ["g", "m"]).withColumn("upto", F.sum("c").over(
        Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    pr = (F.col("before") + F.col("upto") - F.col("c")) / F.greatest(F.col("total") - 1, F.lit(1))
    cutoff = inside.where(pr < older).groupBy("g").agg(F.max("t").alias("cutoff"))
    cutoffs = cutoff.agg(F.map_from_entries(F.collect_list(F.struct("g", "cutoff"))).alias("cutoffs")).scalar()
    return df.withColumn("split", F.when(F.col(t) <= F.element_at(cutoffs, F.col(group)), "OLDER").otherwise("NEWER"))


def peak_concurrency(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the largest number of intervals open at one time (an end at t closes before t's total is read).

    Starts and ends are one pass over the input. Events are summed per time, then accumulated level by level: times of a second,
    seconds of a minute, minutes of a day, days. No task sorts more than one level's rows, and the last level is one row per day.
    """
    ev = (df.where(F.col(end).isNotNull())
          .select(F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
          .select("e.t", "e.d").groupBy("t").agg(F.sum("d").alias("d"))
          .select("t", "d", F.date_trunc("second", "t").alias("s"), F.date_trunc("minute", "t").alias("m")))
    upto = (Window.unboundedPreceding, 0)
    sec = (ev.withColumn("run", F.sum("d").over(Window.partitionBy("s").orderBy("t").rowsBetween(*upto)))
           .groupBy("m", "s").agg(F.sum("d").alias("d"), F.max("run").alias("top")))
    mins = (sec.withColumn("run", F.sum("d").over(Window.partitionBy("m").orderBy("s").rowsBetween(*upto)) - F.col("d"))
            .groupBy("m").agg(F.sum("d").alias("d"), F.max(F.col("run") + F.col("top")).alias("top")))
    mins = mins.withColumn("day", F.date_trunc("day", "m"))
    days = (mins.withColumn("run", F.sum("d").over(Window.partitionBy("day").orderBy("m").rowsBetween(*upto)) - F.col("d"))
            .groupBy("day").agg(F.sum("d").alias("d"), F.max(F.col("run") + F.col("top")).alias("top")))
    total = days.withColumn("run", F.sum("d").over(Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(*upto)) - F.col("d"))
    return total.agg(F.max(F.col("run") + F.col("top")).alias("peak_concurrent_statements"))


def single_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: number of distinct values, and the value when there is exactly one."""
    d = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return d.groupBy(*keys).agg(F.count("*").alias("n_values"), F.min(value).alias("_v")).select(
        *keys, "n_values", F.when(F.col("n_values") == 1, F.col("_v")).alias(value))


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Newest version per key. An aggregation (max_by) instead of a window: versions are reduced before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, *[f"_r.{c}" for c in columns])
