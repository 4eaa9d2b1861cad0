"""Loader of delivered rate files: a folder of CSVs with headers becomes the reference tables that plans look up."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcost.refdata import TABLES

# The delivered file of each table. A table may come in parts, and a file may be a folder of parts.
RATE_FILES = {
    "dbu_rates": "dbu-rates.csv",
    "instance_rates": "instance-dbu-rates.csv",
    "multipliers": "dbu-multipliers.csv",
    "warehouse_rates": "dbsql-rates.csv",
    "warehouse_config": "dbsql-warehouse-config.csv",
    "serverless_rates": "serverless-rates.csv",
    "sku_region_map": "sku-region-map.csv",
    "hosted_model_rates": "fmapi-databricks-rates.csv",
    "proprietary_model_rates": "fmapi-proprietary-rates.csv",
    "vm_costs": "vm-costs_part*.csv",
}


def read_rate_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Reference table `name` out of CSV files. Columns are found by the names in the header, so their order and further columns do not
    matter; a value that is not of its column's type is null. A missing column is an error that lists all that are missing."""
    raw = spark.read.option("header", True).csv(path)
    columns = TABLES[name][0]
    lost = [c for c, _ in columns if c not in raw.columns]
    if lost:
        raise ValueError(f"{path} lacks the columns {', '.join(lost)} of {name}")
    return raw.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in columns])


def read_rate_tables(spark: SparkSession, folder: str, files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables of a folder. `files` names other files, or only those that are there."""
    return {name: read_rate_table(spark, f"{folder.rstrip('/')}/{file}", name) for name, file in (files or RATE_FILES).items()}
