"""Merges of keyed tables as joins (no row-level MERGE on plain files): the result is the new state of the rows that go in.

Keys are unique on both sides, so no join here multiplies rows. by_file() applies a merge to a table on disk and rewrites only the files that hold a key of the source.
"""
from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.sources import sinks


def by_file(path: str, source: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Apply merge(rows, source) to the Parquet table at `path` and read it back. Only the files that hold a key of the source are read whole, merged and replaced by new
    files; all others keep their name and time. A merge that inserts gives the new rows too, as every matched key is in the files it gets.

    The names of the touched files come to the driver, like a table's file list. New files are added before the old ones go; between the two a reader can see both, so a
    table that is read meanwhile needs a lock or a table format with snapshots.
    """
    spark = source.sparkSession
    whole = spark.read.parquet(path)
    keys = source.select(key).distinct()
    held = whole.select(key, F.col("_metadata.file_path").alias("_file")).join(keys, key, "left_semi").select("_file").distinct()
    touched = sorted(unquote(r["_file"]) for r in held.collect())       # the metadata give names as URIs
    rows = spark.read.schema(whole.schema).parquet(*touched) if touched else whole.limit(0)
    sinks.replace_files(merge(rows, source), path, touched)
    return spark.read.schema(whole.schema).parquet(path)


def _marked(target: DataFrame, source: DataFrame, key: str, how: str) -> DataFrame:
    """Join with target columns as they are, source columns as s_<name>, and the marks _t / _s."""
    s = source.select(F.col(key), *[F.col(c).alias(f"s_{c}") for c in source.columns if c != key], F.lit(True).alias("_s"))
    return target.withColumn("_t", F.lit(True)).join(s, key, how)


def conditional_upsert(target: DataFrame, source: DataFrame, key: str, when: Column, update: dict[str, Column],
                       insert: dict[str, Column]) -> DataFrame:
    """Update matched rows that satisfy `when`, keep the other target rows, insert unmatched source rows."""
    d = _marked(target, source, key, "full")
    new, change = F.col("_t").isNull(), F.col("_t").isNotNull() & F.col("_s").isNotNull() & F.coalesce(when, F.lit(False))
    none = F.lit(None)
    return d.select(key, *[
        F.when(new, insert.get(c, none)).when(change, update.get(c, F.col(c))).otherwise(F.col(c)).alias(c)
        for c in target.columns if c != key])


def insert_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Keep every target row; add the source rows whose key is new."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def update_matched(target: DataFrame, source: DataFrame, key: str, update: dict[str, Column]) -> DataFrame:
    """Update the target rows that the source has, keep the others; nothing is inserted."""
    d = _marked(target, source, key, "left")
    hit = F.col("_s").isNotNull()
    return d.select(key, *[F.when(hit, update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c)
                           for c in target.columns if c != key])


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete the keys of `new` from `old`, then append `new`."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
