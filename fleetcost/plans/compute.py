"""Compute choice for a processing component, as one struct expression: no join and no row per option."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: workload types, options in their order with base scores, billing SKU and verification -------------
WORKLOAD_TYPES = ("CONTINUOUS_STREAMING", "EVENT_DRIVEN_BATCH", "SCHEDULED_BATCH", "ML_TRAINING", "BATCH_SCORING")
KNOWN_PATTERNS = ("CONTINUOUS", "SCHEDULED", "AS_NEEDED")
JOBS_SKU = "ENTERPRISE_JOBS_SERVERLESS"
OPTIONS = (   # name, workload types (streaming is decided by rules), base score, SKU, verified
    ("JOBS_SERVERLESS", ("SCHEDULED_BATCH", "EVENT_DRIVEN_BATCH", "ML_TRAINING", "BATCH_SCORING"), 70, JOBS_SKU, True),
    ("CLASSIC_JOBS_COMPUTE", ("SCHEDULED_BATCH", "EVENT_DRIVEN_BATCH", "ML_TRAINING", "BATCH_SCORING"), 45, None, True),
    ("SERVERLESS_PIPELINE", ("SCHEDULED_BATCH",), 55, None, False),
    ("GPU_JOBS_COMPUTE", ("ML_TRAINING", "BATCH_SCORING"), 35, None, False))
STREAM_OPTIONS = ("SERVERLESS_PIPELINE", "JOBS_SERVERLESS", "CLASSIC_JOBS_COMPUTE")
FIELDS = ("selected string", "alternative string", "score int", "confidence string", "status string", "sku string", "eligible array<string>", "streaming_decision string")


def _decision(*values) -> Column:
    parts = []
    for v, f in zip(values, FIELDS):
        name, kind = f.split(" ", 1)
        parts.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return F.struct(*parts)


def streaming(c: Column) -> Column:
    """Four ordered rules; the last prices an unconfirmed stream by a visible proxy."""
    every = F.array(*map(F.lit, STREAM_OPTIONS))
    fast = (c["streaming_mode"] == "TRUE_CONTINUOUS_LOW_LATENCY") | (c["latency_requirement"] == "SECONDS") | c["declarative_pipeline_preferred"]
    slow = (c["streaming_mode"] == "INCREMENTAL_AVAILABLE_NOW") | (c["latency_requirement"] == "MINUTES_OR_MORE")
    return (F.when(c["requires_custom_runtime"] | c["requires_custom_networking"],
                   _decision("CLASSIC_JOBS_COMPUTE", "SERVERLESS_PIPELINE", 90, "MEDIUM", "CUSTOM_REQUIREMENT_COST_INPUTS_REQUIRED", None, every, "CUSTOM_REQUIREMENTS"))
            .when(fast, _decision("SERVERLESS_PIPELINE", "JOBS_SERVERLESS", 90, "HIGH", "PIPELINE_RATE_REQUIRED", None, every, "TRUE_CONTINUOUS_LOW_LATENCY"))
            .when(slow, _decision("JOBS_SERVERLESS", "SERVERLESS_PIPELINE", 90, "HIGH", "COST_MODEL_READY", JOBS_SKU, every, "INCREMENTAL_AVAILABLE_NOW"))
            .otherwise(_decision("JOBS_SERVERLESS", "SERVERLESS_PIPELINE", 70, "MEDIUM", "PRICING_PROXY_PENDING_STREAMING_CLASSIFICATION", JOBS_SKU, every, "UNCONFIRMED")))


def scores(c: Column) -> Column:
    """Eligible options of a batch component, best first: array of (negative score, name, sku, verified)."""
    custom = c["requires_custom_runtime"] | c["requires_custom_networking"]

    def points(condition: Column, yes: int, no: int = 0) -> Column:
        return F.when(condition, yes).otherwise(no)
    extra = {
        "JOBS_SERVERLESS": points(c["pattern"].isin(*KNOWN_PATTERNS), 15) + points(custom, -45) + points(c["requires_gpu"], -40),
        "CLASSIC_JOBS_COMPUTE": points(custom, 45, -15),
        "SERVERLESS_PIPELINE": points(c["declarative_pipeline_preferred"], 35, -20),
        "GPU_JOBS_COMPUTE": points(c["requires_gpu"], 50, -50)}
    options = [F.when(c["workload_type"].isin(*types), F.struct((-(F.lit(base) + extra[name])).alias("neg"), F.lit(name).alias("name"),
                                                                F.lit(sku).cast("string").alias("sku"), F.lit(verified).alias("verified")))
               for name, types, base, sku, verified in OPTIONS]
    return F.array_sort(F.array_compact(F.array(*options)))


def decide(c: Column, ranked: Column) -> Column:
    """Decision of one component; `ranked` is its scores()."""
    best, second = F.get(ranked, 0), F.get(ranked, 1)
    score = -best["neg"]
    confidence = F.when((score >= 85) & best["verified"], "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")
    batch = _decision(best["name"], second["name"], score, confidence, F.when(best["sku"].isNotNull(), "COST_MODEL_READY").otherwise("RECOMMENDATION_READY_COST_INPUTS_REQUIRED"),
                      best["sku"], F.transform(ranked, lambda o: o["name"]), "NOT_APPLICABLE")
    none = _decision("ARCHITECTURE_REVIEW_REQUIRED", None, None, "LOW", "NO_ELIGIBLE_OPTION", None, F.array().cast("array<string>"), "NOT_APPLICABLE")
    return F.when(c["workload_type"] == "CONTINUOUS_STREAMING", streaming(c)).when(F.size(ranked) == 0, none).otherwise(batch)


def with_decisions(requests: DataFrame) -> DataFrame:
    """Column `components`: array of (c, d), each processing component with its decision."""
    ranked = F.transform("processing", lambda c: F.struct(c.alias("c"), scores(c).alias("r")))
    return requests.withColumn("components", F.transform(ranked, lambda x: F.struct(x["c"].alias("c"), decide(x["c"], x["r"]).alias("d"))))


def decisions(requests: DataFrame) -> DataFrame:
    """One row per processing component."""
    # explode_outer: the optimizer copies the whole array expression into a filter in front of a plain explode
    return (with_decisions(requests).select("request_id", F.explode_outer("components").alias("x")).where("x IS NOT NULL")
            .select("request_id", F.col("x.c.component_id").alias("component_id"), F.col("x.c.workload_type").alias("workload_type"), "x.d.*"))
