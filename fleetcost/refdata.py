"""Small reference tables: one Python list per table, used by the Spark plans and by the SQL checks.

Every table here has a fixed number of rows (below 200), so its size does not grow with the data. The frames are
built from Arrow, which gives the optimizer their exact size: a lookup join is broadcast only because Spark has
checked that size against spark.sql.autoBroadcastJoinThreshold, and becomes a shuffle join for larger tables.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(),
          "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_SQL = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP"}

# ---- invented instance, VM and price fixtures, by rule ---------------------------------------------------------
_NODES = [("AWS", f"{fam}.{size}", vcpu, vcpu * mem, factor)
          for fam, mem, factor in (("m5d", 4.0, 0.17), ("r5d", 8.0, 0.21), ("c5d", 2.0, 0.15), ("i3", 7.5, 0.25), ("g5", 4.0, 0.45))
          for size, vcpu in (("xlarge", 4.0), ("2xlarge", 8.0), ("4xlarge", 16.0), ("8xlarge", 32.0))]
_NODES += [("Azure", f"Standard_{name}", vcpu, vcpu * mem, factor)
           for name, vcpu, mem, factor in (
               ("DS3_v2", 4.0, 3.5, 0.19), ("DS4_v2", 8.0, 3.5, 0.19), ("DS5_v2", 16.0, 3.5, 0.19), ("E4s_v3", 4.0, 8.0, 0.22),
               ("E8s_v3", 8.0, 8.0, 0.22), ("F4s_v2", 4.0, 2.0, 0.14), ("F8s_v2", 8.0, 2.0, 0.14), ("F16s_v2", 16.0, 2.0, 0.14),
               ("L8s_v2", 8.0, 8.0, 0.26), ("NC6s_v3", 6.0, 18.0, 0.9))]
_NODES += [("GCP", f"{fam}-{n}", float(n), n * mem, factor)
           for fam, mem, factor, sizes in (("n2-highmem", 8.0, 0.2, (4, 8, 16)), ("c2-standard", 4.0, 0.16, (4, 8, 16)))
           for n in sizes]
_NODES += [("GCP", "a2-highgpu-1g", 12.0, 85.0, 0.8), ("GCP", "a2-highgpu-2g", 24.0, 170.0, 0.8)]
_REGIONS = {"AWS": ("us-east-1", "eu-west-1"), "Azure": ("eastus", "westeurope"), "GCP": ("us-central1", "europe-west4")}
_PRODUCTS = {
    "JOBS_COMPUTE": 0.15, "JOBS_COMPUTE_(PHOTON)": 0.16, "JOBS_SERVERLESS_COMPUTE": 0.35,
    "ALL_PURPOSE_COMPUTE": 0.41, "ALL_PURPOSE_COMPUTE_(PHOTON)": 0.43, "ALL_PURPOSE_SERVERLESS_COMPUTE": 0.72,
    "DLT_CORE_COMPUTE": 0.21, "DLT_CORE_COMPUTE_(PHOTON)": 0.22, "DLT_PRO_COMPUTE": 0.26, "DLT_ADVANCED_COMPUTE": 0.37,
    "SQL_COMPUTE": 0.23, "SQL_PRO_COMPUTE": 0.51, "SERVERLESS_SQL_COMPUTE": 0.68,
    "SERVERLESS_REAL_TIME_INFERENCE": 0.08, "DATABASE_SERVERLESS_COMPUTE": 0.4, "GEMINI_MODEL_SERVING": 0.09}
_REGIONAL = ("JOBS_SERVERLESS_COMPUTE", "ALL_PURPOSE_SERVERLESS_COMPUTE", "SERVERLESS_SQL_COMPUTE",
             "SERVERLESS_REAL_TIME_INFERENCE", "DATABASE_SERVERLESS_COMPUTE", "SQL_PRO_COMPUTE")
_SKU_REGION = {"us-east-1": "US_EAST_A", "eu-west-1": "EU_WEST_A", "eastus": "US_EAST_B", "westeurope": "EU_WEST_B",
               "us-central1": "US_CENTRAL_C"}   # europe-west4 has no mapping on purpose
_T = datetime


def _price_rows():
    """Effective-dated price log: one open price per SKU, plus planted duplicate, missing and expired rows."""
    rows = []
    for cloud, regions in _REGIONS.items():
        for tier, uplift in (("PREMIUM", 1.0), ("ENTERPRISE", 1.2)):
            for product, base in _PRODUCTS.items():
                price = round(base * uplift, 4)
                if product in _REGIONAL:
                    for n, region in enumerate(regions):
                        if region in _SKU_REGION and not (product == "SQL_PRO_COMPUTE" and n == 1):
                            rows.append((f"{tier}_{product}_{_SKU_REGION[region]}", cloud.upper(), round(price * (1 + 0.1 * n), 4)))
                if product not in _REGIONAL or product == "SQL_PRO_COMPUTE":
                    rows.append((f"{tier}_{product}", cloud.upper(), price))
    out = [(s, c, "USD", "DBU", _T(2020, 1, 1), None, p, None if n % 3 == 0 else round(p * 0.9, 4))
           for n, (s, c, p) in enumerate(rows)
           if s != "PREMIUM_DLT_ADVANCED_COMPUTE"]                                                     # one SKU without a price
    out.append(("ENTERPRISE_JOBS_COMPUTE", "AWS", "USD", "DBU", _T(2021, 1, 1), None, 0.99, None))      # a second current price
    out.append(("premium_jobs_compute", "aws", "USD", "DBU", _T(2019, 1, 1), _T(2019, 12, 31), 0.5, None))  # expired
    out.append(("PREMIUM_SQL_COMPUTE", "AWS", "EUR", "DBU", _T(2020, 1, 1), None, 0.3, None))           # other currency
    return out


# ---- fixed values: the default sizing profiles (throughput, windows, limits), node families and worker limit ------
_PROFILES = [
    ("INGESTION", "Incremental file ingestion", "INGEST,INCREMENTAL_INGESTION,AUTO_LOADER,AUTOLOADER,COPY_INTO,LANDING,BRONZE",
     "GENERAL", 5.0, 10.0, 20.0, 0.0, "PER_RUN", 1.0, 1, 32, 60, 5, 5, False, False, True, "Schedule incremental triggers"),
    ("ETL", "Joins, aggregations and merges", "DATA_ENGINEERING,TRANSFORMATION,TRANSFORM,BATCH,BATCH_ETL,SILVER,GOLD,MERGE",
     "GENERAL", 2.0, 4.0, 8.0, 0.5, "PER_RUN", 1.0, 2, 32, 120, 5, 10, False, False, True, "Prefer fewer, larger workers"),
    ("STREAMING", "Always-on stream processing", "STREAM,CONTINUOUS_STREAMING,REAL_TIME,REALTIME,KAFKA,KINESIS",
     "COMPUTE", 5.0, 10.0, 20.0, 0.5, "PEAK_HOUR", 3.0, 2, 32, 60, 0, 0, True, False, True, "Keep tight autoscale bounds"),
    ("ML_TRAINING", "Model training", "TRAINING,MODEL_TRAINING,TRAIN,DEEP_LEARNING",
     "GPU", 0.5, 1.0, 2.0, 4.0, "PER_RUN", 1.0, 1, 16, 240, 8, 30, False, False, False, "Use memory or accelerator nodes"),
    ("ML_INFERENCE", "Batch scoring", "INFERENCE,BATCH_SCORING,SCORING,BATCH_INFERENCE",
     "COMPUTE", 2.5, 5.0, 10.0, 0.0, "PER_RUN", 1.0, 2, 32, 60, 5, 10, False, False, True, "Partition the scoring input")]
_FAMILIES = [
    ("AWS", "GENERAL", r"^m5d\.", 4.0), ("AWS", "MEMORY", r"^r5d\.", 4.0), ("AWS", "COMPUTE", r"^c5d\.", 4.0),
    ("AWS", "STORAGE", r"^i3\.", 4.0), ("AWS", "GPU", r"^g5\.", 4.0),
    ("AZURE", "GENERAL", r"^Standard_DS[0-9]+_v2$", 4.0), ("AZURE", "MEMORY", r"^Standard_E[0-9]+s_v3$", 4.0),
    ("AZURE", "COMPUTE", r"^Standard_F[0-9]+s_v2$", 4.0), ("AZURE", "STORAGE", r"^Standard_L[0-9]+s_v2$", 4.0),
    ("AZURE", "GPU", r"^Standard_NC[0-9]+s_v3$", 4.0),
    ("GCP", "GENERAL", r"^n2-highmem-[0-9]+$", 4.0), ("GCP", "MEMORY", r"^n2-highmem-[0-9]+$", 4.0),
    ("GCP", "COMPUTE", r"^c2-standard-[0-9]+$", 4.0), ("GCP", "STORAGE", r"^n2-highmem-[0-9]+$", 4.0),
    ("GCP", "GPU", r"^a2-highgpu-", 12.0)]

_SIZES = (("X-Small", 6.0, 2), ("Small", 12.0, 4), ("Medium", 24.0, 8), ("Large", 40.0, 16))
_USABLE = "2026-01-01"

TABLES: dict[str, tuple[list[tuple[str, str]], list[tuple]]] = {
    "instance_rates": (
        [("cloud", "string"), ("instance_type", "string"), ("vcpus", "double"), ("memory_gb", "double"), ("dbu_rate", "double"),
         ("is_active", "boolean")],
        [(c, t, v, m, round(v * f, 4), not t.startswith("i3.8")) for c, t, v, m, f in _NODES]
        + [("aws", "M5D.XLARGE", 4.0, 16.0, 0.9, False)]),                          # duplicate key, other case
    "vm_costs": (
        [("cloud", "string"), ("region", "string"), ("instance_type", "string"), ("pricing_tier", "string"),
         ("payment_option", "string"), ("cost_per_hour", "double")],
        [(c, r, t, "on_demand", "NA", round(v * (0.05 + 0.01 * n), 4))
         for c, t, v, m, f in _NODES for n, r in enumerate(_REGIONS[c]) if not (t.startswith("c5d.4") and n == 1)]
        + [(c, _REGIONS[c][0], t, "Reserved", "all_upfront", round(v * 0.03, 4)) for c, t, v, m, f in _NODES]),
    "dbu_rates": (
        [("cloud", "string"), ("region", "string"), ("tier", "string"), ("sku_name", "string"), ("product_type", "string"),
         ("price_per_dbu", "double")],
        [(c, r, tier, p, p.split("_(")[0], round(b * 1.1 * u, 4)) for c, rs in _REGIONS.items() for r in rs
         for tier, u in (("PREMIUM", 1.0), ("ENTERPRISE", 1.2)) for p, b in _PRODUCTS.items()
         if not (c == "GCP" and p in ("DLT_PRO_COMPUTE", "SQL_COMPUTE"))]),
    "multipliers": (
        [("cloud", "string"), ("sku_type", "string"), ("feature", "string"), ("multiplier", "double")],
        [(c, s, "photon", m) for c in ("AWS", "Azure", "GCP")
         for s, m in (("JOBS_COMPUTE", 2.9), ("ALL_PURPOSE_COMPUTE", 2.0), ("DLT_CORE_COMPUTE", 2.5), ("DLT_PRO_COMPUTE", 2.4))
         if not (c == "GCP" and s == "ALL_PURPOSE_COMPUTE")]
        + [("AWS", "JOBS_COMPUTE", "other", 9.0)]),
    "warehouse_rates": (
        [("cloud", "string"), ("warehouse_type", "string"), ("warehouse_size", "string"), ("dbu_per_hour", "double")],
        [(c, t, s, d) for c in ("AWS", "Azure", "GCP") for t in ("classic", "pro", "serverless") for s, d, _ in _SIZES]),
    # As delivered: the column warehouse_size holds the type and warehouse_type the size.
    "warehouse_config": (
        [("cloud", "string"), ("warehouse_size", "string"), ("worker_count", "int"), ("driver_instance_type", "string"),
         ("worker_instance_type", "string"), ("warehouse_type", "string")],
        [(c, t, w, d, k, s) for c, d, k in (("AWS", "i3.2xlarge", "i3.xlarge"), ("Azure", "Standard_E8s_v3", "Standard_E4s_v3"))
         for t in ("classic", "pro") for s, _, w in _SIZES if s != "Large"]),
    "serverless_rates": (
        [("cloud", "string"), ("product", "string"), ("size_or_model", "string"), ("dbu_rate", "double")],
        [(c, p, s, r) for c in ("AWS", "Azure", "GCP")
         for p, s, r in (("vector_search", "standard", 4.0), ("vector_search", "storage_optimized", 18.29),
                         ("model_serving", "cpu", 1.0), ("model_serving", "gpu_small", 10.48), ("model_serving", "gpu_large", 78.6))]),
    "hosted_model_rates": (
        [("cloud", "string"), ("model", "string"), ("rate_type", "string"), ("dbu_rate", "double"), ("input_divisor", "long"),
         ("is_hourly", "boolean")],
        [(c, m, t, r, d, h) for c in ("AWS", "Azure", "GCP")
         for m, t, r, d, h in (("small-chat", "input_token", 7.143, 1000000, False), ("small-chat", "output_token", 28.571, 1000000, None),
                               ("small-chat", "provisioned", 50.5, None, True), ("embedder", "input_token", 1.429, 1000000, False),
                               ("embedder", "per_call", 0.002, None, False))]),
    "proprietary_model_rates": (
        [("cloud", "string"), ("provider", "string"), ("model", "string"), ("endpoint_type", "string"), ("context_length", "string"),
         ("rate_type", "string"), ("dbu_rate", "double"), ("input_divisor", "long"), ("is_hourly", "boolean")],
        [(c, p, m, e, x, t, r, 1000000, False) for c in ("AWS", "Azure", "GCP")
         for p, m, e, x, r in (("google", "gem-a", "global", "all", 10.0), ("google", "gem-a", "in_geo", "all", 11.0),
                               ("google", "gem-a", "global", "long", 20.0), ("acme", "acme-1", "global", "all", 42.857))
         for t in ("input_token", "output_token")]
        + [("AWS", "google", "gem-a", "global", "all", "batch_inference", 300.0, None, True)]),
    "sku_region_map": (
        [("cloud", "string"), ("sku_region", "string"), ("region_code", "string")],
        [(c, _SKU_REGION[r], r.upper() if n else r) for c, rs in _REGIONS.items() for n, r in enumerate(rs) if r in _SKU_REGION]),
    "prices": (
        [("sku_name", "string"), ("cloud", "string"), ("currency_code", "string"), ("usage_unit", "string"),
         ("price_start_time", "timestamp_ntz"), ("price_end_time", "timestamp_ntz"), ("list_default", "double"),
         ("effective_default", "double")], _price_rows()),
    "profiles": (
        [("profile", "string"), ("description", "string"), ("aliases", "string"), ("node_category", "string"),
         ("gb_per_core_hour_low", "double"), ("gb_per_core_hour_expected", "double"), ("gb_per_core_hour_high", "double"),
         ("working_set_factor", "double"), ("volume_basis", "string"), ("peak_factor", "double"), ("min_workers", "int"),
         ("preferred_max_workers", "int"), ("default_window_minutes", "int"), ("startup_minutes", "int"),
         ("min_runtime_minutes", "int"), ("always_on", "boolean"), ("photon_default", "boolean"), ("serverless_ok", "boolean"),
         ("tips", "string"), ("source", "string"), ("calibration_status", "string"), ("calibration_runs", "int")],
        [p + ("Planning assumption", "ASSUMED", 0) for p in _PROFILES]),
    "node_families": (
        [("cloud", "string"), ("node_category", "string"), ("instance_pattern", "string"), ("min_vcpus", "double")], _FAMILIES),
    "policy": (
        [("cloud", "string"), ("max_workers", "int"), ("allowed_node_pattern", "string"), ("policy_name", "string"),
         ("policy_id", "string"), ("source", "string")],
        [("AWS", 20, r"^(m5d|r5d|c5d|g5)\.(xlarge|2xlarge|4xlarge)$", "jobs-aws", "P1", "cluster policy jobs-aws"),
         ("AZURE", 100, None, "Default guardrail", None, "default guardrail")]),
    # Invented account rates. Provider PLATFORM bills compute units, provider CLOUD bills infrastructure.
    "rate_card": (
        [("provider", "string"), ("service", "string"), ("sku", "string"), ("unit", "string"), ("region", "string"),
         ("rate", "double"), ("status", "string"), ("source", "string"), ("effective_start", "string"), ("effective_end", "string"),
         ("observed_rate", "double"), ("notes", "string"), ("billing_sku", "string")],
        [("PLATFORM", "JOBS", "ENTERPRISE_JOBS_SERVERLESS", "DBU", "US_EAST_1", 0.31, "GOVERNED", "account prices", _USABLE, None, None, "", "ENTERPRISE_JOBS_SERVERLESS_COMPUTE"),
         ("PLATFORM", "SQL", "SQL_PRO", "DBU", "US_EAST_1", 0.44, "GOVERNED", "account prices", _USABLE, None, None, "", "ENTERPRISE_SQL_PRO_COMPUTE"),
         ("PLATFORM", "ALL_PURPOSE", "ENTERPRISE_ALL_PURPOSE_COMPUTE", "DBU", "US_EAST_1", 0.52, "GOVERNED", "account prices", _USABLE, None, None, "", "ENTERPRISE_ALL_PURPOSE_COMPUTE"),
         ("PLATFORM", "MODELS", "ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE", "DBU", "US_EAST_1", 0.08, "REFERENCE_ONLY", "public list", _USABLE, None, None, "Model rate is a planning fallback.", "ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE"),
         ("PLATFORM", "MODELS", "ENTERPRISE_OLD_SKU", "DBU", "US_EAST_1", 0.5, "GOVERNED", "account prices", "2024-01-01", "2025-01-01", None, "", None),
         ("CLOUD", "DATASYNC", "DataSync-Bytes", "GB", "US_EAST_1", 0.015, "VALIDATED_OBSERVED", "validated export", _USABLE, None, 0.01, "", None),
         ("CLOUD", "S3", "TimedStorage-ByteHrs", "GB_MONTH", "US_EAST_1", 0.025, "REFERENCE_ONLY", "public list", _USABLE, None, 0.02, "Storage uses the list rate.", None),
         ("CLOUD", "S3", "Requests-Tier1", "REQUEST_1000", "US_EAST_1", 0.006, "VALIDATED_OBSERVED", "validated export", _USABLE, None, 0.004, "", None),
         ("CLOUD", "S3", "Requests-Tier2", "REQUEST_1000", "US_EAST_1", 0.0005, "VALIDATED_OBSERVED", "validated export", _USABLE, None, None, "", None),
         ("CLOUD", "KMS", "KMS-Requests", "REQUEST_10000", "US_EAST_1", 0.03, "VALIDATED_OBSERVED", "validated export", _USABLE, None, None, "", None),
         ("CLOUD", "KMS", "KMS-Keys", "KEY_MONTH", "US_EAST_1", 1.0, "VALIDATED_OBSERVED", "validated export", _USABLE, None, None, "", None),
         ("CLOUD", "KMS", "KMS-Keys", "KEY_MONTH", "AP_SOUTH_1", 1.1, "GOVERNED", "validated export", _USABLE, None, None, "", None),
         ("cloud", "KMS", "kms-keys", "KEY_MONTH", "AP_SOUTH_1", 1.2, "GOVERNED", "validated export", _USABLE, None, None, "", None),
         ("CLOUD", "DATASYNC", "DataSync-Bytes", "GB", "AP_SOUTH_1", None, "PENDING", "awaiting quote", _USABLE, None, None, "", None)]),
    "model_conversions": (
        [("model", "string"), ("serving_mode", "string"), ("account_sku", "string"), ("input_dbu_per_million", "double"),
         ("output_dbu_per_million", "double"), ("cache_dbu_per_million", "double"), ("status", "string"), ("source", "string"),
         ("effective_start", "string"), ("effective_end", "string")],
        [(m, "PAY_PER_TOKEN", "ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE", i, o, c, s, "public list", _USABLE, None)
         for m, i, o, c, s in (("nano-chat", 3.0, 18.0, 0.3, "GOVERNED"), ("embed-large", 2.0, 0.0, None, "GOVERNED"),
                               ("pro-chat", 36.0, 210.0, 3.5, "VALIDATED_OBSERVED"), ("draft-chat", 9.0, 9.0, None, "REFERENCE_ONLY"),
                               ("half-chat", 5.0, None, None, "GOVERNED"))]),
    "node_types": (
        [("node_type", "string"), ("core_count", "double"), ("memory_mb", "long")],
        [("n.small", 4.0, 16384), ("n.small", 4.0, 16000), ("n.medium", 8.0, 32768), ("n.large", 16.0, 65536)]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    """Reference table `name` as a local relation with a known size."""
    return frame_of(spark, *TABLES[name])


def frame_of(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """Inline constant relation: typed rows that are part of the plan."""
    cols = list(zip(*rows)) if rows else [[] for _ in columns]
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[t]) for (_, t), c in zip(columns, cols)],
                                          names=[n for n, _ in columns]))


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(columns: list[tuple[str, str]], rows: list[tuple]) -> str:
    """The same rows as a SQL VALUES relation, for the SQL checks."""
    cast = ", ".join(f"CAST(c{i} AS {_SQL[t]}) AS {n}" for i, (n, t) in enumerate(columns))
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) v({', '.join(f'c{i}' for i in range(len(columns)))})"


@dataclass
class RefData:
    """The reference tables a plan needs. Any of them may be replaced by a table of the caller."""
    instance_rates: DataFrame
    vm_costs: DataFrame
    dbu_rates: DataFrame
    multipliers: DataFrame
    warehouse_rates: DataFrame
    warehouse_config: DataFrame
    serverless_rates: DataFrame
    hosted_model_rates: DataFrame
    proprietary_model_rates: DataFrame
    sku_region_map: DataFrame
    prices: DataFrame
    profiles: DataFrame
    node_families: DataFrame
    policy: DataFrame
    rate_card: DataFrame
    model_conversions: DataFrame
    node_types: DataFrame
    price_card: DataFrame | None = None
    kept: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def fixtures(cls, spark: SparkSession) -> "RefData":
        return cls(**{f.name: frame(spark, f.name) for f in fields(cls) if f.name in TABLES})

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> "RefData":
        """The given tables (loaded rate files, for instance), and the fixtures for all others."""
        return cls(**{f.name: tables[f.name] if f.name in tables else frame(spark, f.name) for f in fields(cls) if f.name in TABLES or f.name in tables})

    def replaced(self, **tables: DataFrame) -> "RefData":
        """The same tables but for these; what was reduced from them is reduced anew."""
        return replace(self, kept={}, **tables)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A reduced reference table, cached: it is read by many plans and is recomputed if its executor is lost."""
        if name not in self.kept:
            self.kept[name] = build().cache()
        return self.kept[name]
