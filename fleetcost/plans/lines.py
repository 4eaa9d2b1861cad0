"""Line items of estimate requests.

One pass over the requests: explode the scenarios, build every section's draft lines as one array, explode that, then
join two small tables (model conversions, rate quotes). Nothing is shuffled; five engines do not mean five scans.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import by_scenario, fmt_number, round_half_up
from fleetcost.plans import pricecard as pc
from fleetcost.plans.compute import with_decisions
from fleetcost.plans.requests import resolved_assumptions, with_defaults

# ---- fixed values: vocabulary of the line items ----------------------------------------------------------------------
MONTHLY, ONE_TIME = "RECURRING_MONTHLY", "ONE_TIME"
INCLUDED, PENDING = "INCLUDED", "PENDING"
CONFIRMED, RANGE, PLANNING = "CONFIRMED", "RANGE_DERIVED", "PLANNING_ASSUMPTION"
PROCESSING, SQL, TRANSFER, STORAGE, MODEL = "DATA_PROCESSING", "SQL_REPORTING", "DATA_TRANSFER", "AWS_STORAGE", "MODEL_API"
CORE_ENGINES = (PROCESSING, SQL, TRANSFER)

# texts of pending reasons and warnings
NO_QUANTITY = "Quantity is missing: pending, not zero."
NO_RUN = "No run is modeled in this scenario; this is not a forecast of zero cost."
SQL_NOTE = "SQL capacity bands are a planning assumption, not a capacity guarantee."
NO_READS = "Read frequency is not supplied: pending, not zero."
NO_DECRYPT = "Decrypt requests depend on the read frequency: pending, not zero."
NO_TOKENS = "Token quantity is missing; output is never inferred from input."

_DRAFT = (("component_id", "string"), ("engine", "string"), ("description", "string"), ("unit", "string"), ("provider", "string"), ("sku", "string"),
          ("quantity", "double"), ("recurrence", "string"), ("evidence", "string"), ("basis", "string"), ("prefix", "string"), ("reason", "string"),
          ("warning", "string"), ("model", "string"), ("serving_mode", "string"), ("input_tokens", "double"), ("output_tokens", "double"))


def _draft(**v) -> Column:
    """A draft line; `reason` set means pending whatever the rate, `model` set means the quantity comes from a conversion."""
    return F.struct(*[(v[n] if isinstance(v.get(n), Column) else F.lit(v.get(n))).cast(t).alias(n) for n, t in _DRAFT])


def _calibrated(values: Column, peers: Column, index: Column, minimum: Column) -> Column:
    return F.when(peers >= minimum, F.get(values, index))


def _index(sc: Column) -> Column:
    return F.when(sc == "LOW", 0).when(sc == "EXPECTED", 1).otherwise(2)


def _processing(x: Column, sc: Column, a: Column, cal: Column | None) -> Column:
    """Streaming: hours x DBU/hour x copies. Batch: runs x runtime x DBU/hour x copies. Fixed intensity wins over history over default."""
    c, d = x["c"], x["d"]
    copies = c["quantity"]
    fixed = c["dbu_per_hour"][sc]
    fixed_basis = F.when(F.coalesce(c["dbu_per_hour_basis"], F.lit("")) == "", "TEAM_FIXED_DBU_PER_HOUR").otherwise(c["dbu_per_hour_basis"])
    minimum = a["min_calibration_peers"]
    none = F.lit(None).cast("double")
    hist_month = none if cal is None else _calibrated(cal["continuous_monthly_dbu"], cal["continuous_peers"], _index(sc), minimum)
    hist_hour = none if cal is None else _calibrated(cal["batch_dbu_per_hour"], cal["batch_peers"], _index(sc), minimum)
    common = {"component_id": c["component_id"], "engine": PROCESSING, "description": F.concat(c["name"], F.lit(" ("), d["selected"], F.lit(")")), "unit": "DBU",
              "provider": "PLATFORM", "sku": d["sku"], "recurrence": MONTHLY}
    times = F.concat(F.lit(" x "), copies.cast("string"))

    hours, default = a["continuous_hours_per_month"], a["continuous_dbu_per_hour"][sc]
    rate = F.coalesce(fixed, default)
    stream_basis = F.when(fixed.isNotNull(), fixed_basis).when(hist_month.isNotNull(), "HISTORICALLY_CALIBRATED").otherwise("PLANNING_DEFAULT_DBU_PER_HOUR")
    by_history = fixed.isNull() & hist_month.isNotNull()
    stream = _draft(
        **common, quantity=F.when(by_history, hist_month * copies).otherwise(hours * rate * copies),
        evidence=F.when(fixed.isNotNull(), c["dbu_per_hour_evidence"]).when(hist_month.isNotNull(), CONFIRMED).otherwise(PLANNING),
        basis=F.concat(stream_basis, F.when(d["streaming_decision"] == "UNCONFIRMED", " | JOBS_SERVERLESS_PRICING_PROXY_PENDING_STREAMING_CLASSIFICATION").otherwise("")),
        prefix=F.when(by_history, F.concat(F.lit("calibrated "), fmt_number(hist_month), F.lit(" DBU/month"), times))
        .otherwise(F.concat(fmt_number(hours), F.lit(" h x "), fmt_number(rate), F.lit(" DBU/h"), times)))

    runtime = by_scenario(sc, c["runtime_hours_low"], c["runtime_hours_expected"], c["runtime_hours_high"])
    event = c["workload_type"] == "EVENT_DRIVEN_BATCH"
    runs = F.coalesce(c["runs_per_month"], F.when(event, a["unconfirmed_event_runs_per_month"][sc]))
    known = c["runs_per_month"].isNotNull()
    hourly = F.coalesce(fixed, hist_hour, a["batch_dbu_per_hour"])
    rate_evidence = F.when(fixed.isNotNull(), c["dbu_per_hour_evidence"]).when(hist_hour.isNotNull(), CONFIRMED).otherwise(PLANNING)
    rate_basis = F.when(fixed.isNotNull(), fixed_basis).when(hist_hour.isNotNull(), "HISTORICALLY_CALIBRATED_DBU_PER_HOUR").otherwise("PLANNING_DEFAULT_DBU_PER_HOUR")
    batch = _draft(
        **common, quantity=runs * runtime * hourly * copies,
        evidence=F.when(known & (rate_evidence == CONFIRMED), CONFIRMED).otherwise(PLANNING),
        basis=F.concat(F.when(runs == 0, "NO_RUN_MODELED").otherwise(rate_basis), F.when(~known & (runs > 0), " | RUN_FREQUENCY_UNCONFIRMED").otherwise("")),
        prefix=F.concat(fmt_number(runs), F.lit(" runs x "), fmt_number(runtime), F.lit(" h x "), fmt_number(hourly), F.lit(" DBU/h"), times),
        warning=F.when(runs == 0, NO_RUN))
    incomplete = runtime.isNull() | runs.isNull()
    missing = _draft(**common, evidence=PLANNING, basis="INPUT_REQUIRED",
                     reason=F.concat(c["component_id"], F.when(runtime.isNull(), ": runtime per run is required.").otherwise(": runs per month is required.")))
    unpriced = _draft(**common, evidence=PLANNING, basis=d["status"], reason=F.concat(d["selected"], F.lit(" is selected; cost inputs are needed before pricing.")))
    return (F.when(d["sku"].isNull(), unpriced).when(c["workload_type"] == "CONTINUOUS_STREAMING", stream).when(incomplete, missing).otherwise(batch))


def _sql(s: Column, sc: Column, a: Column, cal: Column | None) -> Column:
    """Active hours x days x DBU/hour per band x bands of modeled users; history only when concurrency is validated."""
    users = F.greatest(F.lit(1), F.ceil(s["concurrent_users"] * a["sql_concurrency_factor"][sc]))
    bands = F.greatest(F.lit(1), F.ceil(users / a["sql_users_per_capacity_band"]))
    hours, days = a["sql_active_hours_per_day"][sc], s["working_days_per_month"]
    hist = F.lit(None).cast("double")
    if cal is not None:
        hist = F.when(cal["concurrency_validated"], _calibrated(cal["sql_monthly_dbu"], cal["sql_peers"], _index(sc), a["min_calibration_peers"]))
    text = F.concat(fmt_number(hours), F.lit(" h/day x "), days.cast("string"), F.lit(" days x "), fmt_number(a["sql_dbu_per_hour_per_band"]), F.lit(" DBU/h x "),
                    bands.cast("string"), F.lit(" band(s) of "), users.cast("string"), F.lit(" users"))
    return _draft(
        component_id=s["component_id"], engine=SQL, description=F.concat(s["name"], F.lit(" (SQL_PRO)")), unit="DBU", provider="PLATFORM", sku="SQL_PRO", recurrence=MONTHLY,
        quantity=F.coalesce(hist, hours * days * a["sql_dbu_per_hour_per_band"] * bands), evidence=F.when(hist.isNotNull(), CONFIRMED).otherwise(PLANNING),
        basis=F.when(hist.isNotNull(), "HISTORICALLY_CALIBRATED_CONCURRENCY_VALIDATED").otherwise("CONCURRENCY_AWARE_PLANNING_DEFAULT"),
        prefix=F.when(hist.isNotNull(), F.concat(F.lit("calibrated "), fmt_number(hist), F.lit(" DBU/month"))).otherwise(text), warning=SQL_NOTE)


def _transfer(t: Column, sc: Column) -> list[Column]:
    daily = by_scenario(sc, t["daily_gb_low"], t["daily_gb_expected"], t["daily_gb_high"])
    common = {"engine": TRANSFER, "unit": "GB", "provider": "CLOUD", "sku": "DataSync-Bytes", "evidence": CONFIRMED}
    days = t["transfer_days_per_month"]
    recurring = _draft(**common, component_id="TRANSFER-RECURRING", description="Recurring transfer", quantity=daily * days, recurrence=MONTHLY,
                       basis="TEAM_SUPPLIED_DAILY_VOLUME", prefix=F.when(daily.isNull(), "daily volume").otherwise(
                           F.concat(fmt_number(daily), F.lit(" GB/day x "), days.cast("string"), F.lit(" days"))))
    first = _draft(**common, component_id="TRANSFER-MIGRATION", description="One-time migration", quantity=t["initial_transfer_gb"], recurrence=ONE_TIME,
                   basis="TEAM_SUPPLIED_MIGRATION_VOLUME", prefix="one-time migration volume")
    return [F.when(t.isNotNull(), recurring), F.when(t["initial_transfer_gb"].isNotNull(), first)]


def _storage(s: Column) -> list[Column]:
    """Storage, write and read requests, keys, encrypt and decrypt requests. Reads stay pending until their number is known."""
    common = {"engine": STORAGE, "provider": "CLOUD", "recurrence": MONTHLY}
    evidence = F.when(s["request_assumptions_confirmed"], CONFIRMED).otherwise(PLANNING)
    files = s["files_per_day"] * s["days_per_month"]
    per_write, per_read, per_key = s["s3_write_requests_per_file"], s["s3_read_requests_per_file"], s["kms_requests_per_encrypted_file"]
    encrypted = s["encrypted_files_per_day"] * s["days_per_month"]
    days = s["days_per_month"].cast("string")

    def number(x: Column) -> Column:
        return F.coalesce(fmt_number(x), F.lit("unknown"))

    def text(base: Column, per: Column, per_name: str, group: str) -> Column:
        return F.concat(number(base), F.lit(" files/day x "), days, F.lit(" days x "), number(per), F.lit(f" {per_name}/file / {group}"))
    no_reads = per_read.isNull()
    read = F.when(no_reads, _draft(**common, component_id="S3-READ-REQUESTS", description="Read requests", unit="REQUEST_1000", evidence=PLANNING, basis="READ_PATTERN_REQUIRED", reason=NO_READS)).otherwise(
        _draft(**common, component_id="S3-READ-REQUESTS", description="Read requests", unit="REQUEST_1000", sku="Requests-Tier2", quantity=files * per_read / 1000, evidence=evidence,
               basis="FILES_X_READS_PER_FILE", prefix=text(s["files_per_day"], per_read, "reads", "1,000")))
    decrypt = F.when(no_reads, _draft(**common, component_id="KMS-DECRYPT-REQUESTS", description="Decrypt requests on read", unit="REQUEST_10000", evidence=PLANNING, basis="READ_PATTERN_REQUIRED", reason=NO_DECRYPT)).otherwise(
        _draft(**common, component_id="KMS-DECRYPT-REQUESTS", description="Decrypt requests on read", unit="REQUEST_10000", sku="KMS-Requests",
               quantity=encrypted * per_read * F.coalesce(per_key, F.lit(0.0)) / 10000, evidence=evidence, basis="ENCRYPTED_READS_X_REQUESTS", prefix="encrypted reads / 10,000"))
    has, some = s.isNotNull(), s["encrypted_files_per_day"] > 0
    return [
        F.when(has, _draft(**common, component_id="S3-STORAGE", description="Retained storage", unit="GB_MONTH", sku="TimedStorage-ByteHrs", quantity=s["retained_tb"] * 1000.0,
                           evidence=CONFIRMED, basis="TEAM_SUPPLIED_RETAINED_STORAGE", prefix=F.concat(number(s["retained_tb"]), F.lit(" TB x 1,000 GB")))),
        F.when(has, _draft(**common, component_id="S3-WRITE-REQUESTS", description="Write and list requests", unit="REQUEST_1000", sku="Requests-Tier1", quantity=files * per_write / 1000,
                           evidence=evidence, basis="FILES_X_WRITES_PER_FILE", prefix=text(s["files_per_day"], per_write, "writes", "1,000"))),
        F.when(has, read),
        F.when(s["kms_keys"] > 0, _draft(**common, component_id="KMS-KEYS", description="Customer-managed keys", unit="KEY_MONTH", sku="KMS-Keys", quantity=s["kms_keys"],
                                         evidence=CONFIRMED, basis="TEAM_SUPPLIED_KEY_COUNT", prefix="key count")),
        F.when(some, _draft(**common, component_id="KMS-ENCRYPT-REQUESTS", description="Encryption requests", unit="REQUEST_10000", sku="KMS-Requests", quantity=encrypted * per_key / 10000,
                            evidence=evidence, basis="ENCRYPTED_FILES_X_REQUESTS_PER_FILE", prefix=text(s["encrypted_files_per_day"], per_key, "requests", "10,000"))),
        F.when(some, decrypt)]


def token_value(sc: Column, low: Column, expected: Column, high: Column) -> tuple[Column, Column, Column]:
    """(tokens, evidence, basis): expected, else the midpoint of a supplied range; never invented. STRESS uses high."""
    is_expected, middle = sc == "EXPECTED", low.isNotNull() & high.isNotNull()
    value = F.when(is_expected, F.coalesce(expected, F.when(middle, (low + high) / 2.0))).when(sc == "LOW", low).otherwise(high)
    evidence = F.when(is_expected & expected.isNotNull(), CONFIRMED).when(is_expected & ~middle, PLANNING).otherwise(RANGE)
    basis = (F.when(is_expected, F.when(expected.isNotNull(), "TEAM_SUPPLIED_EXPECTED").when(middle, "MIDPOINT_OF_SUPPLIED_RANGE").otherwise("EXPECTED_TOKENS_REQUIRED"))
             .when(sc == "LOW", "SUPPLIED_LOW").otherwise("SUPPLIED_HIGH"))
    return value, evidence, basis


def _endpoint(e: Column, sc: Column, a: Column, days: Column) -> Column:
    calls = e["calls_per_day"] * F.when(sc == "STRESS", a["model_stress_call_multiplier"]).otherwise(1.0)
    it, iev, ib = token_value(sc, e["input_tokens_low"], e["input_tokens_expected"], e["input_tokens_high"])
    ot, oev, ob = token_value(sc, e["output_tokens_low"], e["output_tokens_expected"], e["output_tokens_high"])
    weakest = F.when((iev == PLANNING) | (oev == PLANNING), PLANNING).when((iev == RANGE) | (oev == RANGE), RANGE).otherwise(CONFIRMED)
    basis = F.concat(F.lit("input="), ib, F.lit("; output="), ob, F.lit("; "), fmt_number(calls), F.lit(" calls/day x "), days.cast("string"), F.lit(" days"))
    return _draft(component_id=e["component_id"], engine=MODEL, description=F.concat(e["role"], F.lit(" ("), e["model"], F.lit(")")), unit="DBU", provider="PLATFORM", recurrence=MONTHLY,
                  evidence=weakest, basis=basis, model=e["model"], serving_mode=e["serving_mode"], input_tokens=calls * days * it, output_tokens=calls * days * ot)


def _job(j: Column, sc: Column) -> Column:
    none = F.lit(None).cast("double")
    it, _, ib = token_value(sc, j["input_tokens_low"], none, j["input_tokens_high"])
    ot, _, ob = token_value(sc, j["output_tokens_low"], none, j["output_tokens_high"])
    return _draft(component_id=j["component_id"], engine=MODEL, description=F.concat(j["description"], F.lit(" ("), j["model"], F.lit(")")), unit="DBU", provider="PLATFORM", recurrence=ONE_TIME,
                  evidence=RANGE, basis=F.concat(F.lit("input="), ib, F.lit("; output="), ob), model=j["model"], serving_mode=j["serving_mode"], input_tokens=it, output_tokens=ot)


def drafts(requests: DataFrame, calibration: DataFrame | None = None, carry: tuple[str, ...] = (), keep: bool = False, filled: bool = False) -> DataFrame:
    """One row per request, scenario and line before pricing. `calibration` is a one-row table of historical reference points. With `keep` a scenario
    without lines keeps one row whose component_id is NULL. `filled`: the requests come out of parse(), so they have their defaults."""
    d = with_decisions(requests if filled else with_defaults(requests)).withColumn("a", resolved_assumptions(F.col("assumptions")))
    cal = None
    if calibration is not None:
        d = d.withColumn("cal", F.when(F.col("calibration_allowed"), calibration.select(F.struct("*")).scalar()))
        cal = F.col("cal")
    own = ["request_id", "region", "model_days_per_month", "a", "components", "sql", "transfer", "storage", "model_endpoints", "one_time_model_jobs", *carry]
    d = d.select(*own, *(["cal"] if cal is not None else []), F.explode_outer("scenarios").alias("scenario")).where("scenario IS NOT NULL")
    sc, a, days = F.col("scenario"), F.col("a"), F.col("model_days_per_month")
    s, t, st = F.col("sql"), F.col("transfer"), F.col("storage")
    single = F.array_compact(F.array(F.when(s.isNotNull(), _sql(s, sc, a, cal)), *_transfer(t, sc), *_storage(st)))
    lines = F.concat(F.transform("components", lambda x: _processing(x, sc, a, cal)), single, F.transform("model_endpoints", lambda e: _endpoint(e, sc, a, days)),
                     F.transform("one_time_model_jobs", lambda j: _job(j, sc)))
    # explode_outer: the optimizer copies the whole array expression into a filter in front of a plain explode
    d = d.select("request_id", *carry, "scenario", "region", F.explode_outer(lines).alias("l"))
    return (d if keep else d.where("l IS NOT NULL")).select("request_id", *carry, "scenario", "region", "l.*")


def price_tokens(d: DataFrame, conversions: DataFrame, as_of: str) -> DataFrame:
    """Turn tokens into DBUs for the rows with a model: tokens / 1,000,000 x DBU per million. Otherwise a pending reason."""
    d = pc.with_conversion(d, conversions, as_of)
    model = F.col("model").isNotNull()
    per_in, per_out = F.col("m_input_dbu_per_million"), F.col("m_output_dbu_per_million")
    reason = (F.when(F.col("serving_mode") != "PAY_PER_TOKEN", F.concat("serving_mode", F.lit(" is not priced by tokens.")))
              .when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), NO_TOKENS)
              .when(~F.col("m_ok"), F.col("m_reason"))
              .when(per_in.isNull() | per_out.isNull(), F.concat(F.lit("Conversion for "), "model", F.lit(" is incomplete."))))
    text = F.concat("model", F.lit(": "), fmt_number("input_tokens"), F.lit(" input tokens x "), fmt_number(per_in), F.lit(" + "), fmt_number("output_tokens"),
                    F.lit(" output tokens x "), fmt_number(per_out), F.lit(" DBU per 1M"))
    return d.withColumns({
        "reason": F.when(model, reason).otherwise(F.col("reason")), "sku": F.when(model, F.col("m_account_sku")).otherwise(F.col("sku")),
        "quantity": F.when(model, F.when(reason.isNull(), F.col("input_tokens") / 1e6 * per_in + F.col("output_tokens") / 1e6 * per_out)).otherwise(F.col("quantity")),
        "evidence": F.when(model & reason.isNotNull(), PLANNING).otherwise(F.col("evidence")),
        "prefix": F.when(model, text).otherwise(F.col("prefix"))}).drop(*[c for c in d.columns if c.startswith("m_")])


def price_lines(d: DataFrame, rate_card: DataFrame, as_of: str) -> DataFrame:
    """quantity x exact rate. A reason, a missing quantity or an unusable rate makes the line PENDING; cost is then NULL, never 0."""
    d = pc.with_quote(d, rate_card, as_of)
    why, no_quantity, no_rate = F.col("reason").isNotNull(), F.col("quantity").isNull(), F.col("quote_rate").isNull()
    asked = ~why & ~no_quantity
    priced = asked & ~no_rate
    cost = F.col("quantity") * F.col("quote_rate")
    formula = (F.when(why, F.col("reason")).when(no_quantity, F.concat("prefix", F.lit(": quantity missing"))).when(no_rate, F.concat("prefix", F.lit(": rate pending")))
               .otherwise(F.concat("prefix", F.lit(" = "), fmt_number("quantity"), F.lit(" "), "unit", F.lit(" x $"), fmt_number("quote_rate", 6), F.lit("/"), "unit", F.lit(" = $"),
                                   F.format_number(round_half_up(cost, 2), 2))))
    warnings = F.array_compact(F.when(why, F.array("reason")).when(no_quantity, F.array(F.col("warning"), F.lit(NO_QUANTITY))).otherwise(F.array("warning", F.nullif("quote_warning", F.lit("")))))
    return d.withColumns({
        "rate": F.when(priced, F.col("quote_rate")), "rate_status": F.when(asked, F.col("quote_status")).otherwise(PENDING),
        "rate_source": F.when(asked, F.col("quote_source")).otherwise(""), "cost_usd": F.when(priced, cost),
        "treatment": F.when(priced, INCLUDED).otherwise(PENDING), "formula": formula, "warnings": warnings,
        "quantity": F.when(~why, F.col("quantity"))})


LINE_COLUMNS = ("scenario", "component_id", "engine", "description", "quantity", "unit", "rate", "rate_status", "rate_source", "cost_usd", "recurrence",
                "treatment", "evidence", "basis", "formula", "warnings")


def line_items(requests: DataFrame, rate_card: DataFrame, conversions: DataFrame, as_of: str, calibration: DataFrame | None = None, carry: tuple[str, ...] = (), keep: bool = False, filled: bool = False) -> DataFrame:
    """All line items of all requests: 16 columns per line, plus request_id and the carried request columns. `keep`, `filled`: see drafts()."""
    d = price_lines(price_tokens(drafts(requests, calibration, carry, keep, filled), conversions, as_of), rate_card, as_of)
    return d.select("request_id", *carry, *LINE_COLUMNS)


def compare_models(requests: DataFrame, models: list[str], rate_card: DataFrame, conversions: DataFrame, as_of: str) -> DataFrame:
    """Each endpoint's call pattern on each alternative model: three costs and PRICED or PENDING. Alternatives are never summed."""
    d = with_defaults(requests).select("request_id", "region", "model_days_per_month", F.explode("model_endpoints").alias("e"))
    d = d.select("request_id", "region", "model_days_per_month", "e.*").drop("model").withColumn("model", F.explode(F.array(*map(F.lit, models))))
    d = pc.with_conversion(d, conversions, as_of)
    d = pc.with_quote(d.withColumns({"provider": F.lit("PLATFORM"), "unit": F.lit("DBU"), "sku": F.col("m_account_sku")}), rate_card, as_of)

    def cost(name: str) -> Column:
        sc = F.lit(name)
        it, ot = (token_value(sc, *[F.col(f"{x}_tokens_{b}") for b in ("low", "expected", "high")])[0] for x in ("input", "output"))
        calls = F.col("calls_per_day") * F.col("model_days_per_month")
        dbu = calls * it / 1e6 * F.col("m_input_dbu_per_million") + calls * ot / 1e6 * F.col("m_output_dbu_per_million")
        return F.when(F.col("serving_mode") == "PAY_PER_TOKEN", dbu * F.col("quote_rate"))
    costs = {f"{n.lower()}_usd": cost(n) for n in ("LOW", "EXPECTED", "HIGH")}
    d = d.withColumns(costs)
    every = F.col("low_usd").isNotNull() & F.col("expected_usd").isNotNull() & F.col("high_usd").isNotNull()
    return d.select("request_id", "component_id", "model", *costs, F.when(every, "PRICED").otherwise(PENDING).alias("status"))
