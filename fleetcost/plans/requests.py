"""Estimate requests: nested schema, assumptions, name resolution, what-if overrides, building from flat arguments, templates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcost.functions.columns import clean_token
from fleetcost.sources import sinks

# ---- fixed values: request sections with their fields and types, areas, and planning defaults ----------------------
_S, _D, _I, _B = "string", "double", "int", "boolean"
SECTIONS: dict[str, list[tuple[str, str]]] = {
    "processing": [("component_id", _S), ("name", _S), ("workload_type", _S), ("quantity", _I), ("pattern", _S), ("runtime_hours_low", _D),
                   ("runtime_hours_expected", _D), ("runtime_hours_high", _D), ("runs_per_month", _D), ("dbu_per_hour", "map<string,double>"),
                   ("dbu_per_hour_basis", _S), ("dbu_per_hour_evidence", _S), ("requires_gpu", _B), ("requires_custom_runtime", _B),
                   ("requires_custom_networking", _B), ("declarative_pipeline_preferred", _B), ("streaming_mode", _S), ("latency_requirement", _S), ("evidence", _S)],
    "sql": [("component_id", _S), ("name", _S), ("concurrent_users", _I), ("working_days_per_month", _I), ("total_users", _I), ("evidence", _S)],
    "transfer": [("daily_gb_low", _D), ("daily_gb_expected", _D), ("daily_gb_high", _D), ("transfer_days_per_month", _I), ("initial_transfer_gb", _D), ("evidence", _S)],
    "storage": [("retained_tb", _D), ("files_per_day", _D), ("encrypted_files_per_day", _D), ("kms_keys", _D), ("days_per_month", _I),
                ("s3_write_requests_per_file", _D), ("s3_read_requests_per_file", _D), ("kms_requests_per_encrypted_file", _D),
                ("request_assumptions_confirmed", _B), ("evidence", _S)],
    "model_endpoints": [("component_id", _S), ("model", _S), ("role", _S), ("calls_per_day", _D), ("input_tokens_low", _D), ("input_tokens_expected", _D),
                        ("input_tokens_high", _D), ("output_tokens_low", _D), ("output_tokens_expected", _D), ("output_tokens_high", _D), ("serving_mode", _S), ("evidence", _S)],
    "one_time_model_jobs": [("component_id", _S), ("model", _S), ("description", _S), ("input_tokens_low", _D), ("input_tokens_high", _D),
                            ("output_tokens_low", _D), ("output_tokens_high", _D), ("api_calls", _D), ("serving_mode", _S)]}
LIST_SECTIONS = ("processing", "model_endpoints", "one_time_model_jobs")
AREAS = tuple(SECTIONS)
AREA_STATES = ("INCLUDED", "EXCLUDED", "UNKNOWN", "NOT_APPLICABLE")
DEFAULT_SCENARIOS = ("LOW", "EXPECTED", "HIGH")
# Field defaults of a section, used where a request leaves the field out.
FIELD_DEFAULTS = {
    "processing": {"quantity": 1, "pattern": "TBD", "dbu_per_hour_basis": "", "dbu_per_hour_evidence": "PLANNING_ASSUMPTION", "requires_gpu": False,
                   "requires_custom_runtime": False, "requires_custom_networking": False, "declarative_pipeline_preferred": False,
                   "streaming_mode": "UNCONFIRMED", "latency_requirement": "UNCONFIRMED"},
    "sql": {"working_days_per_month": 22}, "transfer": {"transfer_days_per_month": 22},
    "storage": {"encrypted_files_per_day": 0.0, "kms_keys": 0.0, "days_per_month": 30, "request_assumptions_confirmed": False},
    "model_endpoints": {"serving_mode": "PAY_PER_TOKEN"}, "one_time_model_jobs": {"serving_mode": "PAY_PER_TOKEN"}}
# Storage requests per file default to 1 only when the request does not name them (an explicit null stays unknown).
ABSENT_DEFAULTS = {"storage": {"s3_write_requests_per_file": 1.0, "kms_requests_per_encrypted_file": 1.0}}
ASSUMPTION_SCALARS = {"continuous_hours_per_month": 730.0, "batch_dbu_per_hour": 1.0, "sql_dbu_per_hour_per_band": 4.0,
                      "sql_users_per_capacity_band": 10.0, "model_stress_call_multiplier": 1.25, "min_calibration_peers": 3.0}
ASSUMPTION_MAPS = {"continuous_dbu_per_hour": (0.5, 1.0, 1.5, 2.0), "unconfirmed_event_runs_per_month": (0.0, 1.0, 1.0, 4.0),
                   "sql_active_hours_per_day": (0.5, 1.0, 2.0, 4.0), "sql_concurrency_factor": (0.5, 1.0, 1.5, 2.0)}
SCENARIOS = ("LOW", "EXPECTED", "HIGH", "STRESS")


def section_ddl(name: str) -> str:
    body = f"struct<{', '.join(f'{f}: {t}' for f, t in SECTIONS[name])}>"
    return f"array<{body}>" if name in LIST_SECTIONS else body


ASSUMPTIONS_DDL = "struct<" + ", ".join([f"{n}: double" for n in ASSUMPTION_SCALARS] + [f"{n}: map<string,double>" for n in ASSUMPTION_MAPS]) + ">"
REQUEST_DDL = ("use_case_id string, use_case_name string, scenarios array<string>, region string, model_days_per_month int, calibration_allowed boolean, "
               f"assumptions {ASSUMPTIONS_DDL}, _areas map<string,string>, scope_included array<string>, scope_excluded array<string>, notes array<string>, "
               + ", ".join(f"{n} {section_ddl(n)}" for n in SECTIONS))


def section(name: str, values: dict[str, Column]) -> Column:
    """A section struct in field order; fields that are not given are NULL."""
    return F.struct(*[(values[f] if f in values else F.lit(None)).cast(t).alias(f) for f, t in SECTIONS[name]])


def _flag(c: str, value: Column) -> Column:
    return F.when(F.col(c), value)


def assemble(wide: DataFrame) -> DataFrame:
    """Nest a flat request table (derived input `request_wide`) into the request schema."""
    c = F.col
    fixed = F.when(c("p1_fix_expected").isNotNull(), F.create_map(F.lit("EXPECTED"), c("p1_fix_expected"), F.lit("HIGH"), c("p1_fix_high")))
    p1 = section("processing", {
        "component_id": c("p1_id"), "name": c("p1_name"), "workload_type": c("p1_type"), "quantity": c("p1_quantity"), "pattern": c("p1_pattern"),
        "runtime_hours_low": c("p1_low"), "runtime_hours_expected": c("p1_expected"), "runtime_hours_high": c("p1_high"), "runs_per_month": c("p1_runs"),
        "dbu_per_hour": fixed, "dbu_per_hour_basis": c("p1_fix_basis"), "dbu_per_hour_evidence": c("p1_fix_evidence"), "requires_gpu": c("p1_gpu"),
        "requires_custom_runtime": c("p1_custom_runtime"), "requires_custom_networking": c("p1_custom_network"),
        "declarative_pipeline_preferred": c("p1_declarative"), "streaming_mode": c("p1_mode"), "latency_requirement": c("p1_latency")})
    p2 = section("processing", {"component_id": c("p2_id"), "name": c("p2_name"), "workload_type": c("p2_type"), "pattern": F.lit("SCHEDULED"),
                                "runtime_hours_low": F.lit(1.0), "runtime_hours_expected": F.lit(2.0), "runtime_hours_high": F.lit(3.0), "runs_per_month": c("p2_runs")})
    sql = section("sql", {"component_id": c("s1_id"), "name": F.lit("Dashboards"), "concurrent_users": c("s1_users"), "working_days_per_month": c("s1_days")})
    transfer = section("transfer", {"daily_gb_low": c("t1_low"), "daily_gb_expected": c("t1_expected"), "daily_gb_high": c("t1_high"),
                                    "transfer_days_per_month": c("t1_days"), "initial_transfer_gb": c("t1_initial")})
    storage = section("storage", {
        "retained_tb": c("st_tb"), "files_per_day": c("st_files"), "encrypted_files_per_day": c("st_encrypted"), "kms_keys": c("st_keys"), "days_per_month": F.lit(30),
        "s3_write_requests_per_file": c("st_writes"), "s3_read_requests_per_file": c("st_reads"), "kms_requests_per_encrypted_file": c("st_kms"),
        "request_assumptions_confirmed": c("st_confirmed")})
    ep = section("model_endpoints", {
        "component_id": c("e1_id"), "model": c("e1_model"), "role": F.lit("Answering"), "calls_per_day": c("e1_calls"), "input_tokens_low": c("e1_in_low"),
        "input_tokens_expected": c("e1_in_expected"), "input_tokens_high": c("e1_in_high"), "output_tokens_low": c("e1_out_low"),
        "output_tokens_expected": c("e1_out_expected"), "output_tokens_high": c("e1_out_high"), "serving_mode": c("e1_mode")})
    job = section("one_time_model_jobs", {"component_id": c("j1_id"), "model": c("j1_model"), "description": F.lit("Initial indexing"), "input_tokens_low": c("j1_in_low"),
                                          "input_tokens_high": c("j1_in_high"), "output_tokens_low": c("j1_out_low"), "output_tokens_high": c("j1_out_high")})
    overrides = {"batch_dbu_per_hour": c("ov_batch"), "sql_users_per_capacity_band": c("ov_band").cast("double"),
                 "sql_active_hours_per_day": F.when(c("ov_sql_high").isNotNull(), F.create_map(F.lit("HIGH"), c("ov_sql_high")))}
    assumptions = F.struct(*[overrides.get(n, F.lit(None)).cast("double").alias(n) for n in ASSUMPTION_SCALARS],
                           *[overrides.get(n, F.lit(None)).cast("map<string,double>").alias(n) for n in ASSUMPTION_MAPS])
    areas = F.map_from_entries(F.array_compact(F.array(*[
        F.when(c(f"area_{a}").isNotNull(), F.struct(F.lit(a).alias("key"), c(f"area_{a}").alias("value"))) for a in ("transfer", "sql")])))
    return wide.select(
        "request_id", "use_case_id", "use_case_name", F.split("scenario_list", ",").alias("scenarios"), "region", c("model_days").alias("model_days_per_month"),
        "calibration_allowed", assumptions.alias("assumptions"), areas.alias("_areas"),
        F.array(F.lit("Compute")).alias("scope_included"), F.array(F.lit("Staging")).alias("scope_excluded"), F.array(F.lit("Planning input")).alias("notes"),
        F.array_compact(F.array(_flag("p1", p1), _flag("p2", p2))).alias("processing"), _flag("s1", sql).alias("sql"), _flag("t1", transfer).alias("transfer"),
        _flag("st", storage).alias("storage"), F.array_compact(F.array(_flag("e1", ep))).alias("model_endpoints"), F.array_compact(F.array(_flag("j1", job))).alias("one_time_model_jobs"))


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill the field defaults of every section, the scenario list, region, days and lock flag."""
    def fill(name: str, s: Column) -> Column:
        d = FIELD_DEFAULTS[name]
        return F.struct(*[(F.coalesce(s[f], F.lit(d[f]).cast(t)) if f in d else s[f]).alias(f) for f, t in SECTIONS[name]])

    def filled(name: str) -> Column:
        if name in LIST_SECTIONS:
            return F.transform(F.coalesce(F.col(name), F.array().cast(section_ddl(name))), lambda x: fill(name, x))
        return F.when(F.col(name).isNotNull(), fill(name, F.col(name)))
    out = {name: filled(name) for name in SECTIONS}
    return requests.withColumns({
        **out, "scenarios": F.coalesce("scenarios", F.array(*map(F.lit, DEFAULT_SCENARIOS))), "region": F.coalesce("region", F.lit("US_EAST_1")),
        "model_days_per_month": F.coalesce("model_days_per_month", F.lit(30)), "calibration_allowed": F.coalesce("calibration_allowed", F.lit(True))})


def parse(raw: DataFrame, text: str = "request_json") -> DataFrame:
    """Request JSON texts to the request schema, with defaults. `_areas` keys and states are normalised later."""
    d = raw.withColumn("_r", F.from_json(text, REQUEST_DDL)).select("*", "_r.*").drop("_r")
    absent = ABSENT_DEFAULTS["storage"]
    fields = [f for f, _ in SECTIONS["storage"]]

    def named(f: str) -> Column:
        return F.array_contains(F.json_object_keys(F.get_json_object(text, "$.storage")), f)
    storage = F.when(F.col("storage").isNotNull(), F.struct(*[
        (F.when(~F.coalesce(named(f), F.lit(False)), absent[f]).otherwise(F.col("storage")[f]) if f in absent else F.col("storage")[f]).alias(f) for f in fields]))
    return with_defaults(d.withColumn("storage", storage))


def resolved_assumptions(a: Column) -> Column:
    """Defaults with the request's overrides: scalars replaced, scenario maps merged."""
    def merged(n: str, values: tuple[float, ...]) -> Column:
        default = F.create_map(*[x for k, v in zip(SCENARIOS, values) for x in (F.lit(k), F.lit(v))])
        kept = F.map_filter(default, lambda k, _: ~F.map_contains_key(a[n], k))
        return F.when(a[n].isNull(), default).otherwise(F.map_concat(kept, a[n])).alias(n)
    return F.struct(*[F.coalesce(a[n], F.lit(v)).alias(n) for n, v in ASSUMPTION_SCALARS.items()],
                    *[merged(n, v) for n, v in ASSUMPTION_MAPS.items()])


def area_states(named: Column) -> Column:
    """For a request row: array of (area, state): INCLUDED with inputs, else the stated one, else NOT_APPLICABLE (named request) or UNCONFIRMED."""
    keyed = F.when(F.col("_areas").isNotNull(), F.map_from_entries(F.transform(F.map_entries("_areas"), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.upper(e["value"]).alias("value")))))
    def has(a: str) -> Column:
        return (F.coalesce(F.size(a), F.lit(0)) > 0) if a in LIST_SECTIONS else F.col(a).isNotNull()
    return F.array(*[F.struct(F.lit(a).alias("area"), F.when(has(a), "INCLUDED").otherwise(
        F.coalesce(keyed[a], F.when(named, "NOT_APPLICABLE").otherwise("UNCONFIRMED"))).alias("state")) for a in AREAS])


# ---- name resolution -----------------------------------------------------------------------------------------------
def unique_match(questions: DataFrame, asked: str, names: DataFrame, id_column: str) -> DataFrame:
    """Id of the single row that `asked` names exactly, else of the single row it is a prefix of; ambiguous gives NULL.

    Names and all their prefixes become keys with their lowest and highest id: one key has one owner exactly when both
    are equal. Questions then need two equi-joins against unique keys, and no pair of question and candidate is made.
    """
    n = names.select(F.col(id_column).alias("_id"), F.explode("names").alias("_name"))

    def owners(keys: DataFrame, p: str) -> DataFrame:
        return keys.groupBy("_key").agg(F.min("_id").alias(f"_{p}_lo"), F.max("_id").alias(f"_{p}_hi")).withColumnRenamed("_key", f"_{p}_key")
    exact = owners(n.select("_id", F.upper(F.trim("_name")).alias("_key")), "e")
    prefix = owners(n.select("_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_name"), F.lit(1))), lambda k: F.substring(F.upper("_name"), F.lit(1), k))).alias("_key")), "p")
    key = F.upper(F.trim(clean_token(asked)))
    d = questions.withColumn("_q", key).join(exact, F.col("_q") == F.col("_e_key"), "left").join(prefix, F.col("_q") == F.col("_p_key"), "left")
    found = (F.when(F.col("_e_lo").isNotNull(), F.when(F.col("_e_lo") == F.col("_e_hi"), F.col("_e_lo")))
             .otherwise(F.when(F.col("_p_lo") == F.col("_p_hi"), F.col("_p_lo"))))
    return d.withColumn(id_column, found).drop("_q", "_e_key", "_e_lo", "_e_hi", "_p_key", "_p_lo", "_p_hi")


def resolve(questions: DataFrame, named_requests: DataFrame) -> DataFrame:
    """Rows (question_id, use_case_id, named): an ad-hoc request passes through, a name must match one loaded use case."""
    names = named_requests.select("use_case_id", F.array("use_case_id", "use_case_name").alias("names"))
    adhoc = questions.where(clean_token("request_json").isNotNull()).select(
        "question_id", F.coalesce(F.get_json_object("request_json", "$.use_case_id"), F.lit("ADHOC")).alias("use_case_id"), F.lit(False).alias("named"))
    by_name = unique_match(questions.where(clean_token("request_json").isNull()), "use_case", names, "use_case_id")
    return adhoc.unionByName(by_name.where("use_case_id IS NOT NULL").select("question_id", "use_case_id", F.lit(True).alias("named")))


# ---- what-if overrides -----------------------------------------------------------------------------------------------
TOP_FIELDS = [("use_case_id", _S), ("use_case_name", _S), ("scenarios", "array<string>"), ("region", _S), ("model_days_per_month", _I), ("calibration_allowed", _B),
              ("scope_included", "array<string>"), ("scope_excluded", "array<string>"), ("notes", "array<string>")]
ASSUMPTION_FIELDS = [(n, _D) for n in ASSUMPTION_SCALARS] + [(n, "map<string,double>") for n in ASSUMPTION_MAPS]
_COMPONENT = r"^processing\[(.+)\]\.([^.]+)$"


def _paths() -> dict[str, str]:
    """Every path that names one field, with the type of its value. `processing[].field` stands for any component id."""
    out = dict(TOP_FIELDS) | {s: section_ddl(s) for s in SECTIONS} | {f"assumptions.{n}": t for n, t in ASSUMPTION_FIELDS}
    for s in SECTIONS:
        if s not in LIST_SECTIONS:
            out |= {f"{s}.{f}": t for f, t in SECTIONS[s]}
    return out | {f"processing[].{f}": t for f, t in SECTIONS["processing"]}


def _typed(value: Column, kind: str) -> Column:
    """The text of an override as a value of its type, NULL where it does not fit. Lists, maps and sections are JSON; a list may be words with commas."""
    if kind == _S:
        return value
    if kind == "array<string>":
        return F.when(value.startswith("["), F.from_json(value, kind)).otherwise(F.split(F.trim(value), r"\s*,\s*"))
    if kind.startswith("map"):
        m = F.from_json(value, kind)
        return F.when(F.forall(F.map_values(m), lambda x: x.isNotNull()), m)
    return F.from_json(value, kind) if "<" in kind else value.try_cast(kind)


def _judged(overrides: DataFrame) -> DataFrame:
    """Overrides with the component id, the field and whether the value fits (NULL: there is no such field)."""
    known = _paths()
    o = overrides.select("request_id", "path", "value").withColumns({"cid": F.regexp_extract("path", _COMPONENT, 1), "field": F.regexp_extract("path", _COMPONENT, 2)})
    path = F.when(F.col("cid") != "", F.concat(F.lit("processing[]."), "field")).otherwise(F.col("path"))
    o = o.withColumn("generic", path)
    fits = F.when(F.col("path").startswith("_areas."), True)
    for kind in dict.fromkeys(known.values()):
        fits = fits.when(F.col("generic").isin(*[p for p, t in known.items() if t == kind]), F.col("value").isNull() | _typed(F.col("value"), kind).isNotNull())
    return o.withColumn("fits", fits)


def override_maps(overrides: DataFrame) -> DataFrame:
    """One row per request: a map from path to text, the sections it names (heads), the area states, and the component overrides, longest
    id first. Only values that fit are in. Duplicates of a path are merged before the shuffle (a value before null, then the largest)."""
    one = _judged(overrides).where("fits").groupBy("request_id", "path", "cid", "field").agg(F.max("value").alias("value"))
    head, tail = F.substring_index("path", ".", 1), F.substring_index("path", ".", -1)
    area, part = head == "_areas", F.col("cid") != ""
    return one.groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.when(~area & ~part, F.struct("path", "value")))).alias("ov"), F.collect_set(head).alias("heads"),
        F.map_from_entries(F.collect_list(F.when(area, F.struct(tail, "value")))).alias("stated"),
        F.sort_array(F.collect_list(F.when(part, F.struct(F.length("cid").alias("n"), "cid", "field", "value"))), asc=False).alias("parts"))


def _set(ov: Column, path: str, kind: str, old: Column) -> Column:
    """The override of a path where there is one; null sets to null."""
    return F.when(F.map_contains_key(ov, path), _typed(ov[path], kind)).otherwise(old)


def apply_overrides(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set top-level fields, whole sections, `section.field`, `assumptions.name`, `_areas.area` and `processing[id].field` (id exact, or the
    part of the id after a hyphen; the longer one counts). Missing sections are created. What can't be applied is left as it was;
    override_errors() lists it."""
    d = requests.join(override_maps(overrides), "request_id", "left")
    ov = F.col("ov")
    d = d.withColumns({f: _set(ov, f, t, F.col(f)) for f, t in [*TOP_FIELDS, *[(s, section_ddl(s)) for s in SECTIONS]] if f in requests.columns})

    def fields(name: str, own: list[tuple[str, str]]) -> Column:
        new = F.struct(*[_set(ov, f"{name}.{f}", t, F.col(name)[f]).cast(t).alias(f) for f, t in own])
        return F.when(F.array_contains("heads", name), new).otherwise(F.col(name))
    kept = F.map_filter(F.coalesce("_areas", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key("stated", k))

    def component(c: Column) -> Column:
        def field(f: str, t: str) -> Column:
            hit = F.get(F.filter("parts", lambda p: (p["field"] == f) & F.concat(F.lit("-"), c["component_id"]).endswith(F.concat(F.lit("-"), p["cid"]))), 0)
            return F.when(hit.isNotNull(), _typed(hit["value"], t)).otherwise(c[f]).cast(t).alias(f)
        return F.struct(*[field(f, t) for f, t in SECTIONS["processing"]])
    out = {s: fields(s, SECTIONS[s]) for s in SECTIONS if s not in LIST_SECTIONS} | {"assumptions": fields("assumptions", ASSUMPTION_FIELDS)}
    d = d.withColumns(out | {"_areas": F.when(F.size("stated") > 0, F.map_concat(kept, "stated")).otherwise(F.col("_areas")),
                             "processing": F.when(F.size("parts") > 0, F.transform("processing", component)).otherwise(F.col("processing"))})
    return d.drop("ov", "heads", "stated", "parts")


def component_names(component_id: Column) -> Column:
    """A component id and its parts after each hyphen, longest first."""
    parts = F.split(component_id, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "-"))


def override_errors(requests: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows (request_id, path, error) of overrides that can't be applied: unknown field, value of the wrong type, unknown component."""
    o = _judged(overrides)
    text = F.when(F.col("fits").isNull(), F.concat(F.lit("There is no field "), "path", F.lit("."))).otherwise(
        F.concat(F.lit("The value '"), "value", F.lit("' does not fit "), "path", F.lit(".")))
    wrong = o.where(~F.coalesce("fits", F.lit(False))).select("request_id", "path", text.alias("error"))
    # outer: a plain explode would copy the whole request expression into a filter on its size
    have = requests.select("request_id", F.explode_outer("processing.component_id").alias("component_id"))
    have = have.select("request_id", F.explode_outer(component_names(F.col("component_id"))).alias("cid")).distinct()
    lost = o.where("cid <> ''").join(have, ["request_id", "cid"], "left_anti").select(
        "request_id", "path", F.concat(F.lit("No processing component "), "cid", F.lit(".")).alias("error"))
    return wrong.unionByName(lost).distinct()


# ---- a request from flat arguments -------------------------------------------------------------------------------------
def build_request(args: DataFrame) -> DataFrame:
    """Column request_json out of one row of named arguments: sections only where inputs are present, blanks left out.

    Missing argument columns count as not given.
    """
    def a(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in args.columns else F.lit(None)).cast(kind)

    def text(name: str) -> Column:
        return clean_token(a(name))

    def areas(name: str, state: str) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text(name), F.lit(""))), "[ ,;]+"), lambda x: x != "")
        return F.transform(words, lambda x: F.struct(x.alias("key"), F.lit(state).alias("value")))
    low, exp, high = (a(f"runtime_hours_{b}", "double") for b in ("low", "expected", "high"))
    dbu = a("dbu_per_hour", "double")
    processing = section("processing", {
        "component_id": F.coalesce(text("component_id"), F.lit("ADHOC-C01")), "name": F.initcap(F.replace(F.lower(a("workload_type")), F.lit("_"), F.lit(" "))),
        "workload_type": F.upper(a("workload_type")), "pattern": F.upper(text("pattern")), "quantity": a("quantity", "int"),
        "runtime_hours_low": F.coalesce(low, exp), "runtime_hours_expected": F.coalesce(exp, low, high), "runtime_hours_high": F.coalesce(high, exp),
        "runs_per_month": a("runs_per_month", "double"), "dbu_per_hour": F.when(dbu.isNotNull(), F.create_map(*[x for s in SCENARIOS for x in (F.lit(s), dbu)])),
        "dbu_per_hour_basis": F.when(dbu.isNotNull(), "TEAM_SUPPLIED_DBU_PER_HOUR"), "latency_requirement": F.upper(text("latency_requirement")),
        "streaming_mode": F.upper(text("streaming_mode")), "requires_gpu": a("requires_gpu", "boolean"),
        "requires_custom_runtime": a("requires_custom_runtime", "boolean"), "requires_custom_networking": a("requires_custom_networking", "boolean")})
    sql = section("sql", {"component_id": F.lit("ADHOC-SQL"), "name": F.lit("SQL reporting"), "concurrent_users": a("concurrent_users"),
                          "total_users": a("total_users"), "working_days_per_month": a("working_days_per_month")})
    glow, gexp, ghigh, first = (a(n, "double") for n in ("daily_gb_low", "daily_gb_expected", "daily_gb_high", "initial_transfer_gb"))
    transfer = section("transfer", {"daily_gb_low": F.coalesce(glow, gexp), "daily_gb_expected": gexp, "daily_gb_high": F.coalesce(ghigh, gexp),
                                    "transfer_days_per_month": a("transfer_days_per_month"), "initial_transfer_gb": first})
    stored = ("retained_tb", "files_per_day", "encrypted_files_per_day", "kms_keys", "s3_read_requests_per_file")
    storage = section("storage", {**{n: a(n) for n in (*stored, "s3_write_requests_per_file", "kms_requests_per_encrypted_file")}, "days_per_month": a("storage_days_per_month")})
    endpoint = section("model_endpoints", {"component_id": F.lit("ADHOC-MODEL-01"), "model": a("model"), "role": F.lit("Model API"), "calls_per_day": a("calls_per_day"),
                                           "serving_mode": F.upper(text("serving_mode")), **{f"{d}_tokens_{b}": a(f"{d}_tokens_{b}") for d in ("input", "output") for b in ("low", "expected", "high")}})
    request = F.struct(
        F.coalesce(a("use_case_id"), F.lit("ADHOC")).alias("use_case_id"), F.coalesce(a("use_case_name"), F.lit("Ad-hoc estimate")).alias("use_case_name"),
        F.transform(F.split(F.coalesce(text("scenarios"), F.lit(",".join(DEFAULT_SCENARIOS))), ","), lambda x: F.upper(F.trim(x))).alias("scenarios"),
        a("model_days_per_month", "int").alias("model_days_per_month"),
        F.map_from_entries(F.concat(areas("included_areas", "INCLUDED"), areas("excluded_areas", "EXCLUDED"), areas("unknown_areas", "UNKNOWN"),
                                    areas("not_applicable_areas", "NOT_APPLICABLE"))).alias("_areas"),
        F.upper(F.replace(text("region"), F.lit("-"), F.lit("_"))).alias("region"),
        F.when(text("workload_type").isNotNull(), F.array(processing)).alias("processing"),
        F.when(a("concurrent_users").isNotNull(), sql).alias("sql"),
        F.when(F.coalesce(glow, gexp, ghigh, first).isNotNull(), transfer).alias("transfer"),
        F.when(F.coalesce(*[a(n) for n in stored]).isNotNull(), storage).alias("storage"),
        F.when(text("model").isNotNull(), F.array(endpoint)).alias("model_endpoints"))
    return args.withColumn("request_json", F.to_json(request))


# ---- templates -----------------------------------------------------------------------------------------------------------
# Invented use cases as rows, and the request path that each named parameter of a template sets.
TEMPLATE_ROWS = [
    ("STREAM_TEMPLATE", '{"use_case_id": "STREAM_TEMPLATE", "use_case_name": "Streaming with reports", "scenarios": ["LOW","EXPECTED","HIGH","STRESS"], "calibration_allowed": false,'
     ' "processing": [{"component_id": "STREAM-C01", "name": "Stream", "workload_type": "CONTINUOUS_STREAMING", "pattern": "CONTINUOUS"},'
     ' {"component_id": "STREAM-C02", "name": "Backfill", "workload_type": "EVENT_DRIVEN_BATCH", "pattern": "AS_NEEDED", "runtime_hours_low": 1, "runtime_hours_expected": 2, "runtime_hours_high": 4}],'
     ' "sql": {"component_id": "STREAM-SQL", "name": "Reports", "concurrent_users": 12}, "transfer": {"daily_gb_low": 3, "daily_gb_expected": 4, "daily_gb_high": 6, "initial_transfer_gb": 5000},'
     ' "storage": {"retained_tb": 5, "files_per_day": 150, "encrypted_files_per_day": 30, "kms_keys": 1}}'),
    ("MODEL_TEMPLATE", '{"use_case_id": "MODEL_TEMPLATE", "use_case_name": "Model calls", "model_endpoints": [{"component_id": "MODEL-M01", "model": "pro-chat", "role": "Answer", "calls_per_day": 200,'
     ' "input_tokens_low": 500, "input_tokens_high": 3000, "output_tokens_low": 100, "output_tokens_high": 900}],'
     ' "one_time_model_jobs": [{"component_id": "MODEL-J01", "model": "embed-large", "description": "First indexing", "input_tokens_low": 10000000, "input_tokens_high": 12000000, "output_tokens_low": 0, "output_tokens_high": 0}]}')]
TEMPLATE_PARAMETERS = {"retained_storage_tb": "storage.retained_tb", "files_per_day": "storage.files_per_day", "encrypted_files_per_day": "storage.encrypted_files_per_day",
                       "kms_keys": "storage.kms_keys", "migration_gb": "transfer.initial_transfer_gb", "s3_read_requests_per_file": "storage.s3_read_requests_per_file"}


def templates(spark: SparkSession) -> DataFrame:
    """Use-case templates as rows (template, request_json)."""
    return spark.createDataFrame(TEMPLATE_ROWS, "template string, request_json string")


def from_template(asked: DataFrame, template_rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """Requests (request_id, template) out of their template, with (request_id, path, value) parameters or dotted paths applied.

    A template is parsed once, not once per request. The parsed templates are written, so their size is known and Spark need not pair tables of unknown size.
    """
    parsed = sinks.overwrite(parse(template_rows), sinks.shared_folder(asked.sparkSession))
    d = asked.join(parsed, "template")
    names = F.create_map(*[F.lit(x) for kv in TEMPLATE_PARAMETERS.items() for x in kv])
    return apply_overrides(d, parameters.withColumn("path", F.coalesce(names[F.col("path")], F.col("path"))))

