"""Order statistics, joins, price rules, readers and plans against brute force on small fixtures."""
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcost.catalog import REGISTRY
from fleetcost.functions import fmt_number, round_half_up
from fleetcost.operators import aggregates as agg
from fleetcost.operators import joins as jn
from fleetcost.plans import outputs as out
from fleetcost.plans import pricecard as pc
from fleetcost.plans import validate as vd
from fleetcost.refdata import RefData
from fleetcost.sources import rates, readers

T0 = datetime(2024, 1, 1)


def test_exact_quantiles_with_a_hot_value_and_bad_values(spark):
    rnd = random.Random(1)
    rows = [("a", rnd.choice([5.0, rnd.random() * 100])) for _ in range(3000)] + [("b", float(n)) for n in range(7)] + [("c", 1.5), ("a", None), ("a", float("nan")), ("a", float("inf"))]
    got = {r["g"]: r for r in agg.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None and np.isfinite(x)]
        assert np.allclose([got[g]["q1"], got[g]["q2"], got[g]["q3"]], np.quantile(v, [0.25, 0.5, 0.75]))


def test_time_split_with_ties(spark):
    rnd = random.Random(2)
    rows = [(n, g, T0 + timedelta(seconds=rnd.choice([0, 0, 30, rnd.randrange(9000)]))) for g in ("x", "y") for n in range(400)] + [(0, "z", T0)]
    d = spark.createDataFrame([(n, g, t) for n, g, t in rows], "id int, g string, t timestamp_ntz")
    got = {(r["id"], r["g"]): r["split"] for r in agg.time_split(d, "g", "t", 0.67).collect()}
    for n, g, t in rows:
        mine = [u for _, h, u in rows if h == g]
        pr = sum(u < t for u in mine) / max(len(mine) - 1, 1)
        assert got[n, g] == ("OLDER" if pr < 0.67 else "NEWER")


def test_peak_concurrency(spark):
    rnd = random.Random(3)
    rows = [(T0 + timedelta(seconds=s), T0 + timedelta(seconds=s + rnd.randrange(1, 400))) for s in (rnd.randrange(0, 7200) for _ in range(500))]
    events = sorted({t for r in rows for t in r})
    expected = max(sum(a <= t for a, _ in rows) - sum(b <= t for _, b in rows) for t in events)
    got = agg.peak_concurrency(spark.createDataFrame(rows, "s timestamp_ntz, e timestamp_ntz"), "s", "e").first()[0]
    assert got == expected


def test_interval_overlap_has_each_pair_once(spark):
    rnd = random.Random(4)

    def spans(n, longest):
        return [(k, rnd.choice("pq"), T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + rnd.randrange(1, longest))) for k, m in ((k, rnd.randrange(0, 600)) for k in range(n))]
    a, b = spans(60, 400), spans(80, 90)
    left, right = (spark.createDataFrame(r, f"{p}_id int, k string, {p}_s timestamp_ntz, {p}_e timestamp_ntz") for r, p in ((a, "l"), (b, "r")))
    got = {(r["l_id"], r["r_id"]): r["overlap_hours"] for r in jn.interval_overlap(left, right, "k", ("l_s", "l_e"), ("r_s", "r_e")).collect()}
    expected = {(x[0], y[0]): (min(x[3], y[3]) - max(x[2], y[2])).total_seconds() / 3600 for x in a for y in b if x[1] == y[1] and y[2] < x[3] and y[3] > x[2]}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_a_second_current_price_makes_the_row_pending(spark):
    ref = RefData.fixtures(spark)
    card = pc.price_card(ref.dbu_rates, ref.sku_region_map, pc.with_pricing_struct(ref.prices), "2024-02-01")
    rows = {(r["cloud"], r["region"], r["tier"], r["product_type"]): r for r in card.collect()}
    twice = rows["AWS", "us-east-1", "ENTERPRISE", "JOBS_COMPUTE"]
    assert twice["status"] == "PENDING" and twice["price_per_dbu"] is None and "found 2" in twice["source"]
    assert rows["AWS", "us-east-1", "PREMIUM", "DLT_ADVANCED_COMPUTE"]["status"] == "PENDING"
    assert rows["AWS", "us-east-1", "PREMIUM", "JOBS_COMPUTE"]["price_per_dbu"] == 0.15


def test_rounding_and_number_text(spark):
    r = spark.range(1).select(round_half_up(F.lit(1.005), 2).alias("a"), round_half_up(F.lit(252.945), 2).alias("b"), fmt_number(F.lit(1e7)).alias("c"), fmt_number(F.lit(1234.5)).alias("d"),
                              fmt_number(F.lit(0.0)).alias("e"), fmt_number(F.lit(100.0)).alias("f")).first()
    assert tuple(r) == (1.01, 252.95, "10,000,000", "1,234.5", "0", "100")


def test_number_text_needs_no_pattern(spark):
    rows = [(100.0, "100"), (-1200.5, "-1,200.5"), (0.0, "0"), (0.00004, "0"), (10.0305, "10.0305"), (1e6, "1,000,000"), (None, None)]
    d = spark.createDataFrame(rows, "x double, text string").select(fmt_number("x").alias("got"), fmt_number("x", 0).alias("whole"), "text")
    assert [r["got"] for r in d.collect()] == [t for _, t in rows] and d.first()["whole"] == "100"
    assert "regexp" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_one_document_per_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.json").write_text('{\n "use_case_id": "U%d",\n "sql": {"concurrent_users": %d}\n}' % (n, n))
    d = readers.read_documents(spark, str(tmp_path), "use_case_id string, sql struct<concurrent_users: int>")
    assert sorted((r["use_case_id"], r["sql"]["concurrent_users"]) for r in d.collect()) == [("U0", 0), ("U1", 1), ("U2", 2)]


def test_union_of_nothing_is_typed(spark):
    d = readers.union_many(spark, [], "a string, b double")
    assert d.count() == 0 and [f.dataType.simpleString() for f in d.schema] == ["string", "double"]


def test_unknown_field_names_the_nearest(spark):
    raw = spark.createDataFrame([(1, '{"use_case_id": "U", "use_case_name": "n", "sql": {"component_id": "S", "name": "n", "concurent_users": 3}}')], "request_id long, request_json string")
    rows = vd.check(raw, RefData.fixtures(spark).model_conversions).collect()
    assert any(r["issue"] == "UNKNOWN_FIELD" and "concurrent_users" in r["question"] for r in rows)
    assert any(r["issue"] == "MISSING" and r["field"] == "concurrent_users" for r in rows)


def test_lookback_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("workspace_id", F.col("event_type"))
    d = readers.lookback(events, "click", "ts", "2024-01-20", 5).select("event_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id" in plan and "props" not in plan


@pytest.mark.parametrize("key", ["est_jobs_classic", "rate_quote", "siz_priced", "dcp_line_items", "price_card", "chk_not_json", "jn_alias", "jn_cross_single"])
def test_plans_have_no_python_and_no_cross_join(spark, sf_dir, key):
    plan = REGISTRY[key].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_line_items_are_not_shuffled(spark, sf_dir):
    """Exchanges occur only in the small lookup tables, below a broadcast."""
    plan = REGISTRY["dcp_line_items"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and plan.count("FileScan parquet") == 1


def test_overrides_reach_every_kind_of_field_and_report_what_they_cannot_set(spark):
    from fleetcost.plans import requests as rq
    raw = spark.createDataFrame([(1, '{"use_case_id": "A", "processing": [{"component_id": "A-C01", "quantity": 1}], "storage": {"retained_tb": 5}}')], "request_id long, request_json string")
    ov = spark.createDataFrame([(1, "storage.retained_tb", None), (1, "sql.concurrent_users", "7"), (1, "assumptions.batch_dbu_per_hour", "2.5"), (1, "_areas.transfer", "EXCLUDED"),
                                (1, "processing[C01].dbu_per_hour", '{"HIGH": 3}'), (1, "processing[C01].quantity", "many"), (1, "processing[C9].quantity", "2"), (1, "moon", "1"),
                                (1, "scenarios", "LOW, HIGH")], "request_id long, path string, value string")
    base = rq.parse(raw)
    r = rq.apply_overrides(base, ov).first()
    assert (r["storage"]["retained_tb"], r["sql"]["concurrent_users"], r["assumptions"]["batch_dbu_per_hour"], r["_areas"]) == (None, 7, 2.5, {"transfer": "EXCLUDED"})
    assert (r["processing"][0]["dbu_per_hour"], r["processing"][0]["quantity"], r["scenarios"]) == ({"HIGH": 3.0}, 1, ["LOW", "HIGH"])
    assert {e["path"] for e in rq.override_errors(base, ov).collect()} == {"processing[C01].quantity", "processing[C9].quantity", "moon"}


def test_intervals_that_never_end_stay_short(spark):
    left = spark.sql("SELECT 'a' AS k, 1 AS l_id, TIMESTAMP_NTZ '2024-01-01 00:30:00' AS l_s, TIMESTAMP_NTZ '9999-01-01 00:00:00' AS l_e")
    right = spark.sql("SELECT 'a' AS k, 2 AS r_id, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS r_s, TIMESTAMP_NTZ '2024-01-02 01:30:00' AS r_e")
    got = jn.interval_overlap(left, right, "k", ("l_s", "l_e"), ("r_s", "r_e"), "2024-01-03 00:00:00").select("l_id", "r_id", "overlap_hours").collect()
    assert [tuple(x) for x in got] == [(1, 2, 1.5)]


def test_rate_files_are_read_by_header_and_lost_columns_are_named(spark, tmp_path):
    (tmp_path / "dbu-multipliers.csv").write_text("category,multiplier,feature,sku_type,cloud\nx,2.5,photon,JOBS_COMPUTE,AWS\nx,many,photon,JOBS_COMPUTE,GCP\n")
    (tmp_path / "sku-region-map.csv").write_text("cloud,sku_region\nAWS,US_EAST_A\n")
    (tmp_path / "vm-costs_part1.csv").write_text("cloud,region,instance_type,pricing_tier,payment_option,cost_per_hour\nAWS,r,a,on_demand,NA,1\n")
    (tmp_path / "vm-costs_part2.csv").write_text("cloud,region,instance_type,pricing_tier,payment_option,cost_per_hour\nAWS,r,b,on_demand,NA,2\n")
    got = rates.read_rate_tables(spark, str(tmp_path), {n: rates.RATE_FILES[n] for n in ("multipliers", "vm_costs")})
    assert sorted(map(tuple, got["multipliers"].collect()), key=str) == [("AWS", "JOBS_COMPUTE", "photon", 2.5), ("GCP", "JOBS_COMPUTE", "photon", None)]
    assert {(r["instance_type"], r["cost_per_hour"]) for r in got["vm_costs"].collect()} == {("a", 1.0), ("b", 2.0)}
    with pytest.raises(ValueError, match="region_code"):
        rates.read_rate_tables(spark, str(tmp_path), {"sku_region_map": "sku-region-map.csv"})
    assert RefData.of(spark, got).vm_costs is got["vm_costs"]


def test_what_is_refused_follows_from_who_asks(spark):
    job = '"component_id": "C1", "name": "Load", "workload_type": "SCHEDULED_BATCH"'
    docs = {1: '{"use_case_id": "U", "use_case_name": "N", "processing": [{%s, "runtime_hours_expected": 1}]}' % job,                  # incomplete
            2: '{"use_case_id": "U", "use_case_name": "N", "processing": [{%s, "runs_per_month": -1}]}' % job,                          # refused by the calculator
            3: "no json; at all"}
    rows = [(k * 10 + n, text, named) for k, text in docs.items() for n, named in enumerate((False, True, None))]
    raw = spark.createDataFrame(rows, "request_id long, request_json string, named boolean")
    judged = vd.judged(vd.checked(raw, RefData.fixtures(spark).model_conversions), F.when(F.col("request_id") % 10 == 0, False).when(F.col("request_id") % 10 == 1, True))
    got = out.settled(judged)
    status = {r["request_id"]: r["request_status"].replace("OK", "READY") for r in got.collect()}
    assert status == {10: "NEEDS_INPUT", 11: "READY", 12: "READY", 20: "NEEDS_INPUT", 21: "NEEDS_INPUT", 22: "REJECTED", 30: "NEEDS_INPUT", 31: "NEEDS_INPUT", 32: "REJECTED"}
    errors = {(r["request_id"], r["detail"]) for r in out.refused_details(got).where("section = 'ERROR'").collect()}
    assert (22, "INVALID_VALUE runs_per_month (C1), received -1") in errors and (32, "NOT_JSON request") in errors
    assert {r[0] for r in errors} == {10, 20, 21, 22, 30, 31, 32}


def _asked(spark, *rows):
    return spark.createDataFrame([(n, d, o) for n, (d, o) in enumerate(rows)], "request_id long, request_json string, overrides_json string")


def test_overrides_change_the_document_before_it_is_checked(spark):
    doc = '{"use_case_id": "A", "use_case_name": "n", "processing": [{"component_id": "A-C01", "runs_per_month": 3}, 7, {"component_id": "C01"}], "sql": [1], "storage": null, "odd": {"x": 1}}'
    changes = ('{"processing[C01].runs_per_month": "many", "processing[C9].quantity": 1, "sql.concurrent_users": 2, "storage.retained_tb": null, "storage.files_per_day": 5, "_areas.sql": "EXCLUDED",'
               ' "transfer": {"daily_gb_low": 1, "daily_gb_high": 1}, "transfer.daily_gb_high": -1, "region": "X"}')
    d = vd.parsed(_asked(spark, (doc, changes), (doc, None), (doc, " "), ("[1]", changes), ("{", changes), (None, changes), (doc, "[1]")))
    got = {r["request_id"]: r["v"] for r in d.select("request_id", F.to_json("v").alias("v")).collect()}
    import json
    new = json.loads(got[0])
    assert new == {"use_case_id": "A", "use_case_name": "n", "processing": [{"component_id": "A-C01", "runs_per_month": "many"}, 7, {"component_id": "C01", "runs_per_month": "many"}], "sql": [1],
                   "storage": {"retained_tb": None, "files_per_day": 5}, "odd": {"x": 1}, "_areas": {"sql": "EXCLUDED"}, "transfer": {"daily_gb_low": 1, "daily_gb_high": -1}, "region": "X"}
    assert all(json.loads(got[n]) == json.loads(doc) for n in (1, 2, 6)) and got[3] == "[1]" and got[4] is got[5] is None


def test_a_negative_override_is_refused_by_name_and_a_malformed_one_stops_the_rest(spark):
    doc = '{"use_case_id": "SEND", "use_case_name": "n", "transfer": {"daily_gb_low": 3, "daily_gb_expected": 4, "daily_gb_high": 6}}'
    conv = RefData.fixtures(spark).model_conversions
    rows = _asked(spark, (doc, '{"transfer.daily_gb_high": -1}'), (doc, '{"transfer.daily_gb_high": 9}'), (doc, "{"), (doc, '{"processing[C1].quantity": 2}'), (doc, "7"))
    d = vd.judged(vd.checked(rows, conv), F.lit(True)).select("request_id", "status", "texts").collect()
    got = {r["request_id"]: (r["status"], r["texts"]) for r in d}
    assert got == {0: ("NEEDS_INPUT", ["INVALID_VALUE daily_gb_high (transfer), received -1"]), 1: ("READY", []), 2: ("NEEDS_INPUT", ["NOT_JSON overrides"]),
                   3: ("NEEDS_INPUT", ["INVALID_VALUE processing[C1].quantity (C1), received 2"]), 4: ("NEEDS_INPUT", ["INVALID_VALUE overrides, received 7"])}
    texts = vd.override_texts(spark.createDataFrame([(1, "a.b", "-1"), (1, "c", "word"), (1, "d", None), (1, "e", '{"x": [1]}')], "request_id long, path string, value string")).first()
    import json
    assert json.loads(texts["overrides_json"]) == {"a.b": -1, "c": "word", "d": None, "e": {"x": [1]}}


def test_the_check_reads_its_documents_once_and_shuffles_nothing(spark, sf_dir):
    from fleetcost.sources.inputs import load
    plan = vd.verdicts(vd.checked(load(spark, sf_dir, "raw_requests"), RefData.fixtures(spark).model_conversions))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan and plan.split("Subquery")[0].count("Exchange") == 0


def test_documents_of_one_small_file_are_checked_by_all_tasks(spark, tmp_path):
    from fleetcost.catalog import results
    from fleetcost.catalog.registry import Inputs
    keys = [*range(64), 7, 7, None]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = results.documents(Inputs(spark, str(tmp_path))).select("request_id", F.col("_metadata.file_path").alias("file")).collect()
    assert sorted(str(r["request_id"]) for r in got) == sorted(map(str, keys)) and len({r["file"] for r in got}) == 8


def test_the_check_describes_single_fields_and_no_whole_document(spark, sf_dir):
    from fleetcost.sources.inputs import load
    plan = vd.checked(load(spark, sf_dir, "raw_requests"), RefData.fixtures(spark).model_conversions)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("SchemaOfVariant") <= 20      # a field, a component id of each section, a model


@pytest.mark.parametrize("bound, parts", [(20_000, 1_024), (40, 64)])
def test_quantiles_by_refinement(spark, bound, parts):
    rnd = random.Random(9)
    rows = ([("a", rnd.lognormvariate(0, 3)) for _ in range(2000)] + [("a", 1e300), ("a", -1e300), ("a", float("-inf")), ("a", 7.0)] + [("b", 2.0)] * 500 + [("b", 3.0)] + [("c", float(2 ** n)) for n in range(300)]
            + [(None, float(n % 40)) for n in range(90)] + [("empty", None), ("empty", float("nan"))])
    d = spark.createDataFrame(rows, "grp string, v double")
    got = {r["grp"]: r for r in agg.exact_quantiles(d, "grp", "v", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}, rows="n", bound=bound, parts=parts).collect()}
    assert got["empty"]["n"] == 2 and got["empty"]["q2"] is None and got.keys() == {"a", "b", "c", None, "empty"}
    for g in ("a", "b", "c", None):
        v = np.array(sorted(x for k, x in rows if k == g and x is not None and np.isfinite(x)))
        assert got[g]["n"] == sum(k == g for k, _ in rows)
        for name, p in (("q0", 0.0), ("q1", 0.25), ("q2", 0.5), ("q3", 0.9), ("q4", 1.0)):
            z = (len(v) - 1) * p
            lo, hi = v[int(np.floor(z))], v[int(np.ceil(z))]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (z - np.floor(z)), rel=1e-12), (g, name)


def test_quantiles_of_a_million_different_values(spark):
    d = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7_919, F.lit(1_000_003)) / 3).alias("v"))
    v = np.sort(np.arange(1_000_000) * 7_919 % 1_000_003 / 3)
    got = agg.exact_quantiles(d, "g", "v", {"a": 0.1, "b": 0.5, "c": 0.999}, bound=1_000).first()
    assert np.allclose([got["a"], got["b"], got["c"]], np.quantile(v, [0.1, 0.5, 0.999]), rtol=1e-12)


def test_effective_prices_are_a_plain_join_and_usage_is_not_shuffled(spark, sf_dir):
    rnd = random.Random(6)
    day = lambda n: T0 + timedelta(days=n)
    prices = [(rnd.choice("st"), rnd.choice("cd"), "DBU", "USD", day(a), rnd.choice([None, day(a + rnd.randrange(0, 9))]), rnd.choice([None, n / 10])) for n, a in enumerate(rnd.randrange(0, 40) for _ in range(40))]
    prices += [("s", "c", "DBU", "EUR", day(0), None, 9.0), ("s", "c", "DBU", "USD", None, None, 8.0)]
    usage = [(n, rnd.choice(["s", "t", "u", None]), rnd.choice("cd"), "DBU", rnd.choice([None, day(rnd.randrange(-2, 60)), T0 + timedelta(hours=rnd.randrange(0, 1400))])) for n in range(300)]
    p = spark.createDataFrame(prices, "sku_name string, cloud string, usage_unit string, currency_code string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, price double")
    u = spark.createDataFrame(usage, "id int, sku_name string, cloud string, usage_unit string, usage_start_time timestamp_ntz")
    want = []
    for n, s, c, unit, t in usage:
        hits = [x for x in prices if x[:4] == (s, c, unit, "USD") and x[4] is not None and t is not None and x[4] <= t and (x[5] is None or t < x[5])]
        want += [(n, s, x[6]) for x in hits] or [(n, None, None)]
    got = [tuple(r) for r in jn.effective_price(u, p).select("id", "p_sku", "unit_price").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = REGISTRY["jn_effective_price"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("FileScan parquet") == 1 and "hashpartitioning(l_" not in plan


def test_run_facts_are_read_in_buckets(spark, sf_dir):
    """The evidence reads each measured log once; the table of runs joins what is measured without an exchange of its own."""
    from fleetcost.catalog.calibration import _History
    from fleetcost.catalog.registry import Inputs
    h = _History(Inputs(spark, sf_dir))
    plan = h.evidence()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 3 and plan.count("supplier.parquet") == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = h.facts.runs.select("run_id", "nm").join(h.facts.tasks.groupBy("run_id").count(), "run_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in joined and "Bucketed: true" in joined


def test_merges_leave_untouched_files_alone(spark, tmp_path):
    from fleetcost.operators import merges as mg
    path = str(tmp_path / "a table")
    rows = spark.range(0, 1000, 1, 1).select("id", (F.col("id") * 2).alias("v"))
    rows.repartitionByRange(5, "id").write.parquet(path)
    files = lambda: {f.name: f.stat().st_mtime_ns for f in (tmp_path / "a table").glob("*.parquet")}
    before = files()
    source = spark.createDataFrame([(3, 7), (5, 8), (2000, 9)], "id long, v long")
    out = mg.by_file(path, source, "id", lambda t, s: mg.conditional_upsert(t, s, "id", F.lit(True), {"v": F.col("s_v")}, {"v": F.col("s_v")}))
    after = files()
    kept = before.keys() & after.keys()
    assert len(before) == 5 and len(kept) == 4 and all(before[f] == after[f] for f in kept)
    want = {n: n * 2 for n in range(1000)} | {3: 7, 5: 8, 2000: 9}
    assert {r["id"]: r["v"] for r in out.collect()} == want and out.count() == 1001
    again = mg.by_file(path, spark.createDataFrame([(-1, 1)], "id long, v long"), "id", lambda t, s: mg.replace_keys(t, s, "id"))
    assert again.count() == 1002 and after.items() <= files().items()


def test_broken_missing_and_empty_tables_are_listed(spark, tmp_path):
    ok, bad = tmp_path / "ok+1 %", tmp_path / "bad"
    spark.range(5).write.parquet(str(ok))
    spark.range(7).coalesce(1).write.parquet(str(bad))
    (bad / "part-x.parquet").write_text("nothing of the kind")
    rows, files = readers.read_tables(spark, {"ok": str(ok), "bad": f"file://{bad}", "gone": str(tmp_path / "gone")}, "id long")
    assert {r["table_name"]: r["n"] for r in rows.groupBy("table_name").agg(F.count("*").alias("n")).collect()} == {"ok": 5, "bad": 7}
    got = sorted((r["table_name"], r["state"], r["rows"]) for r in files.collect() if r["rows"] or r["table_name"] != "ok")
    assert [x for x in got if x[0] != "ok"] == [("bad", "READ", 7), ("bad", "SKIPPED", 0), ("gone", "SKIPPED", 0)] and sum(x[2] for x in got if x[0] == "ok") == 5
    rows, files = readers.read_tables(spark, {"gone": str(tmp_path / "gone")}, "id long")
    assert rows.count() == 0 and [tuple(r) for r in files.collect()] == [("gone", None, 0, "SKIPPED")]


def test_every_record_of_a_rate_file_is_loaded_or_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sku,price\nx,1.5\ny,many\nz,\n")
    (tmp_path / "b.csv").write_text("sku,price\nw,2,3\nv,4\n")
    good, bad = readers.read_rate_csv_checked(spark, str(tmp_path), "sku string, price double")
    assert sorted(map(tuple, good.collect())) == [("v", 4.0), ("x", 1.5), ("z", None)]
    assert sorted((r["file"].rsplit("/", 1)[1], r["record"]) for r in bad.collect()) == [("a.csv", "y,many"), ("b.csv", "w,2,3")]
    assert good.count() + bad.count() == 5


def test_days_are_added_and_only_the_window_is_read(spark, tmp_path):
    from fleetcost.plans import calibrate as cal
    rows = [("w1" if n % 5 else "w2", (T0 + timedelta(days=n % 40)).date(), T0 + timedelta(days=n % 40, hours=1), T0 + timedelta(days=n % 40, hours=1 + n % 4), "x_jobs_y", f"j{n % 40 // 9}", None, None, float(n % 7)) for n in range(300)]
    u = spark.createDataFrame(rows, "workspace_id string, usage_date date, usage_start_time timestamp_ntz, usage_end_time timestamp_ntz, sku_name string, job_id string, cluster_id string, warehouse_id string, usage_quantity double")
    path = str(tmp_path / "days")
    for first, last in (("2024-01-01", "2024-01-20"), ("2024-01-15", "2024-02-05"), ("2024-01-01", "2024-01-03")):
        cal.add_billing_days(u, "w1", first, last, path)
    table = spark.read.parquet(path)
    got, want = (sorted(map(tuple, cal.billing_resources(d, 30).collect()), key=str) for d in (
        cal.window_of_days(table, "w1", "2024-02-01", 30), cal.billing_days(readers.lookback(u, "w1", "usage_start_time", "2024-02-01 00:00:00", 30))))
    assert got == want and len(got) > 0
    plan = cal.window_of_days(table, "w1", "2024-02-01", 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace_id" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_drift_parses_a_template_once_and_merges_two_maps(spark, sf_dir):
    from fleetcost.plans import reconcile as rec, requests as rq
    docs = {"same": '{"region": "US", "sql": {"component_id": "S", "concurrent_users": 3}}',
            "less": '{"region": "US"}',
            "more": '{"region": "EU", "sql": {"component_id": "S", "concurrent_users": 4, "total_users": 9}, "processing": [{"component_id": "C1", "quantity": 2}, {"component_id": "C2", "dbu_per_hour": {"HIGH": 2}}]}',
            "nulls": '{"region": null, "sql": {"component_id": null, "concurrent_users": null}, "storage": {"retained_tb": null}}',
            "no JSON": "x", "empty": "{}", "null": None}
    base = rq.parse(spark.createDataFrame([("T", docs["same"]), ("U", docs["more"]), ("unused", "{}")], "template string, request_json string"))
    own = rq.parse(spark.createDataFrame([(n, t, docs[d]) for n, (t, d) in enumerate((t, d) for t in ("T", "U", "gone", None) for d in docs)], "request_id long, template string, request_json string"))
    own = own.unionByName(own.where("request_id = 2"))      # one request twice
    maps = {r["template"]: r["m"] for r in base.select("template", rec.input_map().alias("m")).collect()}
    want = [(r["request_id"], r["template"], k, maps[r["template"]].get(k), r["m"].get(k)) for r in own.select("request_id", "template", rec.input_map().alias("m")).collect() if r["template"] in maps
            for k in r["m"].keys() | maps[r["template"]].keys() if r["m"].get(k) != maps[r["template"]].get(k)]
    assert len(want) > 60 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in rec.drift(own, base).collect())
    none = own.where("request_id = 0").withColumn("processing", F.lit(None).cast(rq.section_ddl("processing")))
    assert rec.drift(none, base).collect() == []            # a list that is null gives no map, so no rows
    twice = rq.parse(spark.createDataFrame([(0, "T", '{"processing": [{"component_id": "C"}, {"component_id": "C"}]}')], "request_id long, template string, request_json string"))
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        rec.drift(twice, base).collect()
    plan = REGISTRY["rec_drift"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "ExistingRDD" not in plan and "array_union" not in plan


def test_requests_out_of_templates(spark):
    from fleetcost.plans import requests as rq
    templates = spark.createDataFrame([("A", '{"region": "US", "storage": {"retained_tb": 2}}'), ("B", "{}"), ("B", '{"region": "EU"}'), (None, "{}")], "template string, request_json string")
    asked = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B"), (3, "none"), (4, None), (None, "A")], "request_id long, template string")
    given = spark.createDataFrame([(1, "retained_storage_tb", "7"), (1, "retained_storage_tb", None), (2, "region", "AP"), (2, "sql.total_users", "many"), (None, "region", "AP"), (9, "region", "AP")], "request_id long, path string, value string")
    d = rq.from_template(asked, templates, given)
    assert d.columns[:3] == ["request_id", "template", "request_json"]
    got = sorted((str(r["request_id"]), r["template"], r["region"], r["storage"]["retained_tb"] if r["storage"] else None) for r in d.collect())
    assert got == [("1", "A", "US", 7.0), ("1", "A", "US", 7.0), ("2", "B", "AP", None), ("2", "B", "AP", None), ("None", "A", "US", 2.0)]


def test_calibrated_values_keep_no_sketch_per_job(spark, tmp_path):
    import math
    import re
    from fleetcost.plans import calibrate as cal
    rnd = random.Random(8)

    def one(n):
        basis = rnd.choice([cal.WRITTEN, cal.PROXY, None]) if n % 50 == 0 else cal.WRITTEN if n % 3 else cal.PROXY
        return (rnd.choice(["A", "A", "A", "B", None]), basis, None if n % 11 == 0 else "hot" if n % 5 == 0 else f"j{n % 200}", rnd.choice([None, float(n % 9)]), rnd.choice([0.0, 1.5, None]),
                rnd.choice([None, 0.0, n % 37 / 8]), None if n % 4 == 0 else float(n % 100), rnd.choice([None, 2.0]), cal.USED if n % 7 else "below min_gb_per_run")
    rows = [one(n) for n in range(3000)] + [("only proxy", cal.PROXY, None, None, 0.0, 1.0, None, None, cal.USED)] * 2 + [("few", b, "x", 1.0, 2.0, 3.0, 4.0, 5.0, cal.USED) for b in (cal.WRITTEN, cal.PROXY)] + [("left out", cal.PROXY, "x", 1.0, 2.0, 3.0, 4.0, 5.0, "no")]
    ev = spark.createDataFrame(rows, "profile string, volume_basis string, job_id string, setup_minutes double, gb_sized double, gb_per_core_hour double, cpu_pct double, dbu_cost_usd double, calibration_use string")
    assert ev.columns == list(cal.VALUED)
    ev.write.parquet(str(tmp_path / "ev"))
    ev = spark.read.parquet(str(tmp_path / "ev"))

    def at(v, p):
        v = sorted(x for x in v if x is not None)
        return v[max(0, math.ceil(p * len(v)) - 1)] if v else None
    want = []
    for profile in {r[0] for r in rows}:
        of = {b: [r for r in rows if r[0] == profile and r[1] == b and r[8] == cal.USED and (r[5] or 0) > 0] for b in (cal.WRITTEN, cal.PROXY)}
        if not any(r[0] == profile and r[8] == cal.USED and (r[5] or 0) > 0 for r in rows):
            continue
        basis = cal.WRITTEN if len(of[cal.WRITTEN]) >= 5 or not of[cal.PROXY] else cal.PROXY
        u = of[basis]
        paid, gb = ([r[k] for r in u if r[k] is not None] for k in (7, 4))
        want.append((profile, basis, len(u), *[at([r[5] for r in u], p) for p in (0.25, 0.5, 0.75)], at([r[3] for r in u], 0.5), at([r[6] for r in u], 0.5), len({r[2] for r in u} - {None}), sum(paid) / sum(gb) if paid and sum(gb) else None))
    d = cal.calibrated_values(ev, 5)
    got = [tuple(r) for r in d.collect()]
    assert d.columns == ["profile", "basis", "runs", "cal_low", "cal_expected", "cal_high", "cal_startup", "median_cpu_pct", "jobs", "usd_per_gb"]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r[0] for r in got} == {"A", "B", None, "only proxy", "few"}
    assert cal.calibrated_values(ev.where("false"), 5).collect() == []
    keys = re.findall(r"keys=\[([^\]]*)\][^\n]*percentile_approx", d._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("job_id" in k for k in keys)
