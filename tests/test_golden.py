"""Published figures, on tiny request tables with the published rates."""
import json

import pytest
from pyspark.sql import functions as F

from fleetcost.plans import lines as ln, requests as rq, sizing as sz, totals as tt
from fleetcost.refdata import TABLES, RefData, frame_of

# Published rates per unit and DBU per million tokens.
RATES = [("PLATFORM", "ENTERPRISE_JOBS_SERVERLESS", "DBU", 0.3465, "GOVERNED"), ("PLATFORM", "SQL_PRO", "DBU", 0.4235, "GOVERNED"),
         ("PLATFORM", "ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE", "DBU", 0.07, "REFERENCE_ONLY"), ("CLOUD", "DataSync-Bytes", "GB", 0.0125, "VALIDATED_OBSERVED"),
         ("CLOUD", "TimedStorage-ByteHrs", "GB_MONTH", 0.023, "REFERENCE_ONLY"), ("CLOUD", "Requests-Tier1", "REQUEST_1000", 0.005, "VALIDATED_OBSERVED"),
         ("CLOUD", "Requests-Tier2", "REQUEST_1000", 0.0004, "VALIDATED_OBSERVED"), ("CLOUD", "KMS-Requests", "REQUEST_10000", 0.03, "VALIDATED_OBSERVED"),
         ("CLOUD", "KMS-Keys", "KEY_MONTH", 1.0, "VALIDATED_OBSERVED")]
MODELS = [("nano", 2.857, 17.857), ("embed", 1.857, 0.0), ("pro", 35.714, 214.286), ("max", 42.857, 214.286)]
AS_OF = "2026-10-05"
ALL = ["LOW", "EXPECTED", "HIGH", "STRESS"]

STREAM = {
    "scenarios": ALL, "calibration_allowed": False,
    "processing": [
        {"component_id": "U-C01", "name": "Stream", "workload_type": "CONTINUOUS_STREAMING", "pattern": "CONTINUOUS", "dbu_per_hour": {"LOW": 0.5, "EXPECTED": 1.0, "HIGH": 1.5, "STRESS": 2.0}},
        {"component_id": "U-C02", "name": "Backfill", "workload_type": "EVENT_DRIVEN_BATCH", "pattern": "AS_NEEDED", "runtime_hours_low": 1, "runtime_hours_expected": 3, "runtime_hours_high": 5,
         "dbu_per_hour": {"LOW": 0.312, "EXPECTED": 0.55 / 3, "HIGH": 1.56 / 5, "STRESS": 1.56 / 5}, "dbu_per_hour_evidence": "CONFIRMED"}],
    "sql": {"component_id": "U-SQL", "name": "Reports", "concurrent_users": 10, "working_days_per_month": 22},
    "transfer": {"daily_gb_low": 6, "daily_gb_expected": 8, "daily_gb_high": 10, "transfer_days_per_month": 22, "initial_transfer_gb": 10000},
    "storage": {"retained_tb": 10, "files_per_day": 200, "encrypted_files_per_day": 40, "kms_keys": 1, "days_per_month": 30, "s3_write_requests_per_file": 1, "kms_requests_per_encrypted_file": 1}}


def _with(section, **values):
    return {**STREAM, section: {**STREAM[section], **values}}


def _calls(cid, model, calls, low, high, out_low, out_high):
    return {"component_id": cid, "model": model, "role": "r", "calls_per_day": calls, "input_tokens_low": low, "input_tokens_high": high, "output_tokens_low": out_low, "output_tokens_high": out_high}


BATCH = {"component_id": "C01", "name": "Load", "workload_type": "SCHEDULED_BATCH", "runtime_hours_low": 2, "runtime_hours_expected": 2, "runtime_hours_high": 2}
REQUESTS = {
    1: STREAM,
    2: {**_with("storage", retained_tb=8), "transfer": {**STREAM["transfer"], "initial_transfer_gb": 8000}},
    3: _with("storage", s3_read_requests_per_file=3),
    4: {"scenarios": ALL, "sql": {"component_id": "S", "name": "Reports", "concurrent_users": 25, "working_days_per_month": 22}},
    5: {"scenarios": ALL, "processing": [{**BATCH, "runs_per_month": 30}]},
    6: {"scenarios": ALL, "transfer": {"daily_gb_low": 8, "daily_gb_expected": 8, "daily_gb_high": 8, "transfer_days_per_month": 22, "initial_transfer_gb": 5000}},
    7: {"scenarios": ALL, "processing": [{"component_id": "C01", "name": "Stream", "workload_type": "CONTINUOUS_STREAMING"}]},
    8: {"scenarios": ALL, "storage": {"retained_tb": 2, "files_per_day": 100, "encrypted_files_per_day": 10, "kms_keys": 1, "s3_read_requests_per_file": 3}},
    9: {"model_endpoints": [_calls("M1", "nano", 330, 500, 10000, 50, 300), {**_calls("M2", "embed", 300, 50, 600, 0, 0), "output_tokens_expected": 0},
                            _calls("M3", "pro", 215, 1000, 4000, 100, 2000), _calls("M4", "max", 132, 5000, 40000, 300, 1500)],
        "one_time_model_jobs": [
            {"component_id": "J1", "model": "pro", "description": "Index", "input_tokens_low": 70000000, "input_tokens_high": 75000000, "output_tokens_low": 22000000, "output_tokens_high": 24000000},
            {"component_id": "J2", "model": "embed", "description": "Embed", "input_tokens_low": 33000000, "input_tokens_high": 33000000, "output_tokens_low": 0, "output_tokens_high": 0}]},
    10: {"scenarios": ALL, "model_endpoints": [{"component_id": "M", "model": "pro", "role": "r", "calls_per_day": 100, "input_tokens_expected": 1000, "output_tokens_expected": 100}]},
    11: {"scenarios": ALL, "processing": [BATCH]},
    12: {"scenarios": ALL, "processing": [{"component_id": "C01", "name": "Stream", "workload_type": "CONTINUOUS_STREAMING", "latency_requirement": "SECONDS"}]}}
EXPECTED = [
    (1, "LOW", "core_monthly_usd", 146.76), (1, "EXPECTED", "core_monthly_usd", 292.60), (1, "HIGH", "core_monthly_usd", 531.78), (1, "STRESS", "core_monthly_usd", 808.95),
    (1, "HIGH", "recurring_monthly_usd", 762.81), (1, "HIGH", "first_year_usd", 9278.76), (1, "HIGH", "one_time_usd", 125.00),
    (2, "HIGH", "recurring_monthly_usd", 716.81), (2, "HIGH", "first_year_usd", 8701.76), (2, "HIGH", "one_time_usd", 100.00), (3, "HIGH", "recurring_monthly_usd", 762.83),
    (4, "HIGH", "recurring_monthly_usd", 298.14), (5, "EXPECTED", "recurring_monthly_usd", 20.79), (6, "EXPECTED", "recurring_monthly_usd", 2.20), (6, "EXPECTED", "one_time_usd", 62.50),
    (6, "EXPECTED", "first_year_usd", 88.90), (7, "EXPECTED", "recurring_monthly_usd", 252.94), (8, "EXPECTED", "recurring_monthly_usd", 47.02), (9, "LOW", "recurring_monthly_usd", 104.69),
    (9, "EXPECTED", "recurring_monthly_usd", 475.60), (9, "HIGH", "recurring_monthly_usd", 846.51), (9, "LOW", "one_time_usd", 509.29), (9, "HIGH", "one_time_usd", 551.79),
    (10, "EXPECTED", "recurring_monthly_usd", 12.00)]


@pytest.fixture(scope="module")
def priced(spark):
    columns = TABLES["rate_card"][0]
    rates = frame_of(spark, columns, [(p, "s", k, u, "US_EAST_1", r, s, "published", "2026-01-01", None, None, "note" if s == "REFERENCE_ONLY" else "", None) for p, k, u, r, s in RATES])
    conversions = frame_of(spark, TABLES["model_conversions"][0], [(m, "PAY_PER_TOKEN", "ENTERPRISE_SERVERLESS_REAL_TIME_INFERENCE", i, o, None, "GOVERNED", "p", "2026-01-01", None) for m, i, o in MODELS])
    raw = spark.createDataFrame([(k, json.dumps({"use_case_id": str(k), "use_case_name": "n", **v})) for k, v in REQUESTS.items()], "request_id long, request_json string")
    return ln.line_items(rq.parse(raw), rates, conversions, AS_OF, carry=("scenarios", "calibration_allowed")).cache()


def test_figures(priced):
    t = {(r["request_id"], r["scenario"]): r for r in tt.totals(priced).collect()}
    for k, sc, name, value in EXPECTED:
        assert abs(t[k, sc][name] - value) < 0.005 + 1e-9, (k, sc, name, t[k, sc][name], value)


def test_confidence(priced):
    c = {r["request_id"]: r for r in tt.confidence(priced).collect()}
    assert c[1]["rating"] == "LOW" and c[1]["reason"].startswith("55%")


def test_pending_lines(priced):
    pend = {(r["request_id"], r["component_id"]): r for r in priced.where("scenario = 'EXPECTED' AND treatment = 'PENDING'").collect()}
    assert (1, "S3-READ-REQUESTS") in pend and (1, "KMS-DECRYPT-REQUESTS") in pend
    assert "runs per month is required" in pend[11, "C01"]["formula"]
    assert pend[12, "C01"]["description"].endswith("(SERVERLESS_PIPELINE)")
    assert all(r["cost_usd"] is None for r in pend.values())


def test_zero_runs_is_not_a_forecast(priced):
    low = priced.where("request_id = 1 AND component_id = 'U-C02' AND scenario = 'LOW'").first()
    assert low["cost_usd"] == 0 and low["basis"] == "NO_RUN_MODELED" and "not a forecast" in low["warnings"][0]


def test_sizing_example(spark):
    columns = "request_id long, workload string, data_gb double, runs_per_day int, window_minutes int, cloud string, node_type string, max_workers int, region string"
    r = sz.recommend(spark.createDataFrame([(1, "INGESTION", 10.0, 1, None, "AWS", None, None, None)], columns), RefData.fixtures(spark)).first()
    assert (r["num_workers"], r["runtime_minutes_low"], r["runtime_minutes_expected"], r["runtime_minutes_high"]) == (1, 13, 20, 35)
    assert r["status"] == "FITS_WINDOW"


def test_not_a_row_without_volume_or_profile(spark):
    columns = "request_id long, workload string, data_gb double, runs_per_day int, window_minutes int, cloud string, node_type string, max_workers int, region string"
    rows = [(1, "mystery", 10.0, 1, None, "AWS", None, None, None), (2, "ETL", 0.0, 1, None, "AWS", None, None, None), (3, "NULL", 5.0, 1, None, "AWS", None, None, None)]
    assert sz.recommend(spark.createDataFrame(rows, columns), RefData.fixtures(spark)).count() == 0


def test_totals_are_sums_of_included_lines(priced):
    t = tt.totals(priced).select("request_id", "scenario", "recurring_monthly_usd")
    s = priced.where("treatment = 'INCLUDED' AND recurrence = 'RECURRING_MONTHLY'").groupBy("request_id", "scenario").agg(F.sum("cost_usd").alias("s"))
    d = t.join(s, ["request_id", "scenario"], "left").where("abs(recurring_monthly_usd - coalesce(s, 0)) > 1e-9")
    assert d.count() == 0
    no_pending = tt.totals(priced.where("treatment = 'INCLUDED'")).select("request_id", "scenario", F.col("recurring_monthly_usd").alias("m"))
    assert t.join(no_pending, ["request_id", "scenario"]).where("abs(m - recurring_monthly_usd) > 1e-9").count() == 0
