"""Readers: rate CSV files, request documents, look-back scans, write history."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcost.sources import sinks

# Operations that write rows.
WRITE_OPERATIONS = ("WRITE", "STREAMING UPDATE", "MERGE", "COPY INTO", "CREATE TABLE AS SELECT", "REPLACE TABLE AS SELECT",
                    "CREATE OR REPLACE TABLE AS SELECT", "UPDATE")


def read_rate_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One table from one or many CSV parts (`path` may be a folder or a glob); the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_rate_csv_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV parts whose values fit the schema, and those that don't: (file, record), the record as it stands in its file. Every record is in one of the two.

    The files are parsed once, with all columns, and written: a record is judged by the columns that are read, so neither half may read its own.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    d = (spark.read.schema(f"{schema}, _record string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").option("columnPruning", False).csv(path)
         .withColumn("_file", F.col("_metadata.file_path")))
    d = sinks.overwrite(d, sinks.shared_folder(spark))
    return d.where("_record IS NULL").select(*names), d.where("_record IS NOT NULL").select(F.col("_file").alias("file"), F.col("_record").alias("record"))


def read_tables(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of many Parquet tables as one read (with `table_name`), and one row per file: table_name, file, rows read, state READ or SKIPPED. A table whose path is missing
    has one SKIPPED row without a file.

    Files that are broken or go meanwhile are skipped, not fatal; they are found by listing the folders and comparing with the files that gave rows. A file without rows counts as
    SKIPPED: nothing could be read of it. The driver handles paths, one per table; files and rows stay on the executors.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(conf).exists(target)
    have = {name: path for name, path in paths.items() if there(path)}
    place = spark.createDataFrame([(n, have.get(n)) for n in paths], "table_name string, path string")

    def plain(path) -> Column:
        """A path in one form for local files."""
        return F.regexp_replace(path, "^file:/+", "/")

    def named(df: DataFrame) -> DataFrame:
        """With the table of each file (a URI): what stands before its name is the table's path."""
        folder = plain(F.url_decode(F.regexp_replace(F.regexp_replace("file", "/[^/]*$", ""), "[+]", "%2B")))
        own = place.where("path IS NOT NULL").select("table_name", plain(F.regexp_replace("path", "/+$", "")).alias("_path"))
        return df.withColumn("_path", folder).join(own, "_path").drop("_path")
    if not have:
        rows = spark.createDataFrame([], f"{schema}, table_name string")
        return rows, place.select("table_name", F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("rows"), F.lit("SKIPPED").alias("state"))
    read = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(*have.values()).withColumn("file", F.col("_metadata.file_path"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(have.values())).select(F.col("_metadata.file_path").alias("file"))
    counts = read.groupBy("file").agg(F.count("*").alias("rows"))
    files = named(listed).join(counts, "file", "left").select("table_name", "file", F.coalesce("rows", F.lit(0)).alias("rows"))
    states = place.join(files, "table_name", "left").select("table_name", "file", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "READ").otherwise("SKIPPED").alias("state"))
    return named(read).drop("file"), states


def read_documents(spark: SparkSession, path: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """JSON documents of a folder, one per file or one per line."""
    return spark.read.schema(schema).option("multiLine", one_per_file).json(path)


def lookback(df: DataFrame, workspace_id: str, time: str, as_of: str, days: int) -> DataFrame:
    """Rows of one workspace in the `days` before `as_of`. Plain column comparisons, so they reach the file scan."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col("workspace_id") == workspace_id) & (F.col(time) >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(time) < end))


def write_history(history: DataFrame, since: str) -> DataFrame:
    """Write operations of jobs since a time, with the bytes from whichever metric the writer reported."""
    m = F.col("operationMetrics")
    size = F.coalesce(m["numOutputBytes"], m["numTargetBytesAdded"], m["numAddedBytes"]).cast("double")
    return (history.where((F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")) & F.col("operation").isin(*WRITE_OPERATIONS) & F.col("job").isNotNull())
            .select(F.coalesce("job.jobRunId", "job.runId").alias("run_ref"), F.col("job.runId").alias("task_run_id"),
                    size.alias("bytes"), "table_name"))


def unread_tables(expected: DataFrame, history: DataFrame) -> DataFrame:
    """Expected tables without any readable history."""
    return expected.select("table_name").distinct().join(history.select("table_name").distinct(), "table_name", "left_anti")


def union_many(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    """Union by name of any number of frames; an empty typed relation for none."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, as one query."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
