"""Helpers shared by the corpus operators: words, written tables in the shared folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session whose tasks run in the driver's own process may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.gettempdir()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: its lineage ends there, so a lost executor costs no recomputation.

    The table is removed by dropped(), else when the application ends. The shuffle files of the write are removed when it is done, as
    nothing reads them again; else they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() returned and nothing will read again, also not a result that is still to be computed."""
    for t in tables:
        system, target = _file_system(t.sparkSession, t.written_at)
        system.delete(target, True)
        system.cancelDeleteOnExit(target)


def words(text: Column) -> Column:
    """Array of the words of a text: runs of anything but space and the controls 9 to 13. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def slices(batches: Iterator[pd.DataFrame], rows: int = 200) -> Iterator[pd.DataFrame]:
    """A few rows at a time, so that what a Python worker makes of them stays small."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.iloc[lo:lo + rows]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
