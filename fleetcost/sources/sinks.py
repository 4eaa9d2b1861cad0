"""Sinks: overwrite and append of Parquet tables in a shared folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir; it is removed when the application ends.

    Without that setting executors could not read each other's files, so it is an error, except in a session whose tasks run in the
    driver's own process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(base or tempfile.gettempdir()).rstrip('/')}/fleetcost-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    return f"{path}/table"


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at `path`, schema included, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_evolving(df: DataFrame, path: str) -> DataFrame:
    """Append rows that may bring new columns, and read the table with the merged schema."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", True).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written once as a table in as many buckets by `key` as a shuffle has partitions, and read back: grouping it by the key needs no
    exchange, nor does its side of a join on the key."""
    spark = df.sparkSession
    n, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"fleetcost_{uuid.uuid4().hex}", shared_folder(spark)
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def replace_files(df: DataFrame, path: str, old: list[str]) -> None:
    """Add the rows to the table at `path`, then remove the old files."""
    spark = df.sparkSession
    df.write.mode("append").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in old:
        target = jvm.org.apache.hadoop.fs.Path(name)
        target.getFileSystem(conf).delete(target, False)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with the text, in whatever store the path names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target)
    out.writeBytes(text)
    out.close()


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that `df` has rows of; all others stay. Rows are gathered by partition first, so each has few files."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
