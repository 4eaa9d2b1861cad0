"""Mixing sources to target weights: whole copies, then a subset of documents whose lengths sum to what is left of each source's budget."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcost.llm.common import words, written

CAP = 3             # a source gives at most so many times its size
BUCKET_ROWS = 4096  # documents of one source and length are ranked in hash buckets of about so many
DP_BUDGET = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share the total; none gets more than CAP times its size,
    and what is over goes to the others by weight. The common level is found from running sums over the sources in order of the level
    at which each is full, so no repetition is needed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    t = sizes.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn % len(weights)).cast("double").alias("weight"))
    t = t.withColumn("full_at", CAP * F.col("source_size") / F.col("weight"))
    everything, fill = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = lambda c: F.coalesce(F.sum(c).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - before(CAP * F.col("source_size"))) / (F.sum("weight").over(everything) - before("weight"))
    t = t.withColumn("level", level)
    common = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return t.select("source", "source_size", F.least(CAP * F.col("source_size"), F.coalesce(common, F.lit(0.0)) * F.col("weight")).cast("double").alias("target"))


def _table(sizes: np.ndarray, free: np.ndarray, budget: int, width: int) -> np.ndarray:
    """How many of the free documents of each length to take, from a table of about `width` sums that covers 0 to `budget`.

    Counts are split into powers of two, and each cell keeps the first sum that falls into it, with its item and the cell before. Up to
    `width` a cell is one sum, so the result is exact; above, a cell is a range of sums. The largest sum seen at all is the result.
    """
    unit = budget // (width + 1) + 1
    items = []
    for i in np.argsort(-sizes, kind="stable"):
        left, n = min(int(free[i]), budget // int(sizes[i])) if sizes[i] else 0, 1
        while left > 0:
            items.append((i, min(n, left)))
            left, n = left - n, 2 * n
    cells = budget // unit + 1
    total, by, back = np.full(cells, -1, np.int64), np.full(cells, -1, np.int64), np.full(cells, -1, np.int64)
    total[0], best, end = 0, 0, (-1, 0)
    for k, (i, n) in enumerate(items):
        w = int(sizes[i]) * n
        source = np.flatnonzero(total[:(budget - w) // unit + 1] >= 0) if w <= budget else np.array([], int)
        reached = total[source] + w
        source, reached = source[reached <= budget], reached[reached <= budget]
        if not len(source):
            continue
        if reached[-1] > best:
            best, end = int(reached[-1]), (k, int(source[-1]))
        cell = reached // unit
        fresh = total[cell] < 0
        cell, first = np.unique(cell[fresh], return_index=True)
        total[cell], by[cell], back[cell] = reached[fresh][first], k, source[fresh][first]
        if best == budget:
            break
    take = np.zeros_like(free)
    k, at = end
    while k >= 0:
        i, n = items[k]
        take[i] += n
        k, at = int(by[at]), int(back[at])
    return take


def subset_sum(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to `budget` or as little below it as is found.

    An even share of each length comes first, then the longest lengths until the rest fits a table of `dp_budget` sums; the rest is a
    bounded knapsack. Documents longer than the table are in it too: it covers the whole rest then, in ranges of sums. Where that leaves
    words over, the knapsack over all that the even share leaves is tried, and the larger sum counts. Documents of length zero add
    nothing to a sum and are not taken.
    """
    counts = np.where(sizes > 0, counts, 0)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts
    even = (counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    rest = whole = int(budget - (even * sizes).sum())
    take = even.copy()
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= dp_budget:
            break
        more = min(int(counts[i] - take[i]), max(0, rest - dp_budget // 2) // int(sizes[i])) if sizes[i] else 0
        take[i] += more
        rest -= more * int(sizes[i])
    take = take + _table(sizes, counts - take, rest, dp_budget)
    if whole > dp_budget and (take * sizes).sum() < budget:
        other = even + _table(sizes, counts - even, whole, dp_budget)
        take = max(take, other, key=lambda t: int((t * sizes).sum()))
    return take


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source, source_size, target, copies and taken (= copies * size) of every document, null source included.

    A source gives floor(target / size) whole copies; of the rest, documents are counted by length, `subset_sum` says how many of each
    length go in, and those with the smallest seeded hashes of their id do. Copies differ by at most one within a source, and no document
    is taken more than 3 times. Documents without words are in no copy beyond the whole ones. Repeated rows count each; equal rows are
    interchangeable. The same input and seed give the same result. An empty table gives no rows.

    Ids, sources, sizes and hashes are written once, so texts are read once. A task of the knapsack gets one row per length of a source.
    Documents of one source and length are ranked only where a hash bucket of about 4,096 is cut, so a group of any size is spread.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
                    F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"))
    d = written(d)
    hist = d.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    plan = hist.alias("a").join(goal.alias("b"), same("a", "b")).select("a.source", "size", "n", "source_size", "target")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(F.lit(0)).cast("long"))

    def choose(key: tuple, lengths: pd.DataFrame) -> pd.DataFrame:
        p = lengths.sort_values("size")
        budget = 0 if p["whole"].iloc[0] >= CAP else int(round(p["target"].iloc[0] - float(p["whole"].iloc[0]) * p["source_size"].iloc[0]))
        return p.assign(extra=subset_sum(p["size"].to_numpy(), p["n"].to_numpy(), max(0, budget)))

    plan = written(plan.groupBy("source").applyInPandas(choose, "source string, size long, n long, source_size long, target double, whole long, extra long"))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    bucket = F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.col("buckets")).cast("long")
    e = d.alias("d").join(plan.withColumn("buckets", buckets).alias("p"), same("d", "p") & (F.col("d.size") == F.col("p.size")))
    e = e.select("id", "h", "d.source", "d.size", "n", "source_size", "target", "whole", "extra", bucket.alias("bucket"))
    cut = e.where((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).groupBy("source", "size", "bucket").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("need", F.col("extra") - before).where((F.col("need") > 0) & (F.col("need") <= F.col("m"))).select("source", "size", F.col("bucket").alias("at"), "need")
    f = e.alias("e").join(cut.alias("c"), same("e", "c") & (F.col("e.size") == F.col("c.size")), "left").select("e.*", "at", "need")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "id"))
    edge = F.col("bucket") == F.col("at")

    def result(df: DataFrame, extra: Column) -> DataFrame:
        copies = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")
        return df.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    plain = result(f.where(~F.coalesce(edge, F.lit(False))), F.coalesce(F.col("bucket") < F.col("at"), F.col("extra") >= F.col("n")) & (F.col("extra") > 0))
    ranked = result(f.where(edge).withColumn("rank", rank), F.col("rank") <= F.col("need"))
    return plain.unionByName(ranked)


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
