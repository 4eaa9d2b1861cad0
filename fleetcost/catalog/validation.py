"""Input check of request documents (CHK)."""
from fleetcost.catalog.registry import F, query
from fleetcost.catalog.requests import _ASKED
from fleetcost.oracle.base import CTES, derive, values
from fleetcost.plans import requests as rq, validate as vd

_SECTIONS = ("processing", "sql", "transfer", "storage", "model_endpoints", "one_time_model_jobs")
_LISTS = ("processing", "model_endpoints", "one_time_model_jobs")
CTES["doc"] = "SELECT request_id, j, json_type(j) = 'OBJECT' AS is_object FROM (SELECT request_id, CASE WHEN json_valid(request_json) THEN CAST(request_json AS JSON) END AS j FROM raw_requests)"
CTES["doc_ok"] = """SELECT request_id, j, CASE WHEN scen_ok AND len(scen) > 0 THEN scen ELSE ['LOW', 'EXPECTED', 'HIGH'] END AS scenarios, scen_ok FROM (
 SELECT request_id, j, scen, coalesce(json_type(j, '$.scenarios'), 'NULL') = 'NULL' OR len(list_filter(scen, lambda s: s NOT IN ('LOW', 'EXPECTED', 'HIGH', 'STRESS'))) = 0 AS scen_ok
 FROM (SELECT request_id, j, json_extract_string(j, '$.scenarios[*]') AS scen FROM doc WHERE is_object))"""
CTES["doc_items"] = " UNION ALL ".join(
    ["SELECT request_id, scenarios, 'request' AS section, CAST(NULL AS VARCHAR) AS label, j AS item FROM doc_ok"]
    + [f"SELECT request_id, scenarios, '{s}', '{s}', json_extract(j, '$.{s}') FROM doc_ok WHERE json_type(j, '$.{s}') = 'OBJECT'" for s in _SECTIONS if s not in _LISTS]
    + [f"SELECT request_id, scenarios, '{s}', '{s}[' || n || ']', items[n + 1] FROM (SELECT *, unnest(range(len(items))) AS n FROM (SELECT request_id, scenarios, json_extract(j, '$.{s}[*]') AS items FROM doc_ok WHERE json_type(j, '$.{s}') = 'ARRAY'))" for s in _LISTS])
CTES["doc_entry"] = """SELECT *, json_type(item) = 'OBJECT' AS ok, CASE WHEN section <> 'request' AND json_type(item, '$.component_id') = 'VARCHAR' THEN json_extract_string(item, '$.component_id') ELSE label END AS cid FROM doc_items"""
_DIC = [("request", f, k, None, None) for f, k in vd.REQUEST_FIELDS.items()] + [
    (s, f, vd._KIND[t], "|".join(vd.ENUMS[s, f]) if (s, f) in vd.ENUMS else None, 1.0 if (s, f) in vd.AT_LEAST_ONE else None) for s, fs in rq.SECTIONS.items() for f, t in fs]
CTES["field_dic"] = values([("section", "string"), ("field", "string"), ("kind", "string"), ("choices", "string"), ("floor", "double")], _DIC)
CTES["doc_fields"] = """SELECT e.request_id, e.section, e.cid, f.key AS field, CAST(f.value AS VARCHAR) AS value, f.type AS t, d.kind, d.choices, d.floor, CASE WHEN f.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(f.value AS DOUBLE) END AS val
 FROM (SELECT * FROM doc_entry WHERE ok) e, json_each(e.item) f LEFT JOIN field_dic d ON d.section = e.section AND d.field = f.key
 WHERE NOT starts_with(f.key, '_') AND NOT (e.section = 'request' AND f.key IN ('assumptions', 'processing', 'sql', 'transfer', 'storage', 'model_endpoints', 'one_time_model_jobs'))"""
_NUM = "t IN ('UBIGINT', 'BIGINT', 'DOUBLE')"
_WRONG = f"""(kind IN ('number', 'whole') AND NOT {_NUM} OR kind = 'flag' AND t <> 'BOOLEAN' OR kind = 'text' AND t <> 'VARCHAR' OR kind = 'list' AND t <> 'ARRAY' OR kind = 'whole' AND val >= 0 AND val <> floor(val)
 OR kind = 'map' AND (t <> 'OBJECT' OR regexp_matches(value, ':\\s*["tfn\\[{{]')))""".replace("{{", "{")
_COLS = "request_id, section, component_id, field, issue, blocking, received"
CTES["i_json"] = """SELECT request_id, 'request' AS section, NULL AS component_id, 'request' AS field, CASE WHEN j IS NULL THEN 'NOT_JSON' ELSE 'WRONG_TYPE' END AS issue, true AS blocking, CASE WHEN j IS NOT NULL THEN replace(CAST(j AS VARCHAR), ', ', ',') END AS received
 FROM doc WHERE j IS NULL OR NOT is_object"""
CTES["i_unknown"] = "SELECT request_id, section, cid AS component_id, field, 'UNKNOWN_FIELD' AS issue, true AS blocking, '\"' || field || '\"' AS received FROM doc_fields WHERE kind IS NULL"
_bad_section = " UNION ALL ".join(
    f"SELECT request_id, '{s}', NULL, '{s}', 'WRONG_TYPE', true, CAST(json_extract(j, '$.{s}') AS VARCHAR) FROM doc_ok WHERE coalesce(json_type(j, '$.{s}'), 'NULL') NOT IN ('NULL', '{'ARRAY' if s in _LISTS else 'OBJECT'}')" for s in _SECTIONS)
CTES["i_type"] = f"""SELECT request_id, section, cid AS component_id, field, 'WRONG_TYPE' AS issue, true AS blocking, value AS received FROM doc_fields WHERE t <> 'NULL' AND {_WRONG} AND NOT (kind = 'list' AND field = 'scenarios')
 UNION ALL SELECT request_id, section, NULL, label, 'WRONG_TYPE', true, CAST(item AS VARCHAR) FROM doc_entry WHERE NOT ok UNION ALL {_bad_section}
 UNION ALL SELECT request_id, 'request', NULL, '_areas', 'WRONG_TYPE', true, CAST(json_extract(j, '$._areas') AS VARCHAR) FROM doc_ok WHERE coalesce(json_type(j, '$._areas'), 'NULL') NOT IN ('NULL', 'OBJECT')"""
CTES["i_negative"] = f"SELECT request_id, section, cid AS component_id, field, 'INVALID_VALUE' AS issue, true AS blocking, value AS received FROM doc_fields WHERE kind IN ('number', 'whole') AND val < 0 UNION ALL SELECT request_id, section, cid, field, 'INVALID_VALUE', true, value FROM doc_fields WHERE val < floor"
CTES["i_enum"] = """SELECT request_id, section, cid AS component_id, field, 'INVALID_VALUE' AS issue, true AS blocking, value AS received FROM doc_fields WHERE t = 'VARCHAR' AND choices IS NOT NULL AND NOT list_contains(string_split(choices, '|'), json_extract_string(CAST(value AS JSON), '$'))
 UNION ALL SELECT request_id, 'request', NULL, 'scenarios', 'INVALID_VALUE', true, replace(CAST(json_extract(j, '$.scenarios') AS VARCHAR), ', ', ',') FROM doc_ok WHERE NOT scen_ok"""


def _gone(f: str) -> str:
    return f"json_extract_string(item, '$.{f}') IS NULL"


def _need(f: str, where: str) -> str:
    return f"SELECT request_id, section, cid AS component_id, '{f}' AS field, 'MISSING' AS issue, true AS blocking, CAST(NULL AS VARCHAR) AS received FROM doc_entry WHERE ok AND {_gone(f)} AND {where}"


_BATCH = "section = 'processing' AND json_extract_string(item, '$.workload_type') IN ('EVENT_DRIVEN_BATCH', 'SCHEDULED_BATCH', 'ML_TRAINING', 'BATCH_SCORING')"


def _expected(base: str, where: str) -> str:
    lo, ex, hi = (_gone(f"{base}_{b}") for b in ("low", "expected", "high"))
    middle = f"NOT ({lo}) AND NOT ({hi})" if base.endswith("tokens") else "false"
    return _need(f"{base}_expected", f"{where} AND (({lo}) AND ({hi}) OR list_contains(scenarios, 'EXPECTED') AND NOT ({middle}))")


def _bound(base: str, where: str) -> str:
    lo, ex, hi = (_gone(f"{base}_{b}") for b in ("low", "expected", "high"))
    return " UNION ALL ".join(f"SELECT request_id, section, cid AS component_id, '{base}_{b}' AS field, 'RANGE_BOUND_MISSING' AS issue, false AS blocking, CAST(NULL AS VARCHAR) AS received FROM doc_entry WHERE ok AND {where} AND NOT (({lo}) AND ({ex}) AND ({hi})) AND {gone} AND {uses}"
                              for b, gone, uses in (("low", lo, "list_contains(scenarios, 'LOW')"), ("high", hi, "(list_contains(scenarios, 'HIGH') OR list_contains(scenarios, 'STRESS'))")))


_RANGES = (("runtime_hours", _BATCH), ("daily_gb", "section = 'transfer'"), ("input_tokens", "section = 'model_endpoints'"), ("output_tokens", "section = 'model_endpoints'"))
CTES["i_missing"] = " UNION ALL ".join(
    [_need(f, f"section = '{s}'") for s, fs in vd.REQUIRED.items() for f in fs] + [_expected(b, w) for b, w in _RANGES]
    + [_need("runs_per_month", _BATCH + " AND json_extract_string(item, '$.workload_type') <> 'EVENT_DRIVEN_BATCH'"),
       _need("s3_write_requests_per_file", "section = 'storage' AND json_exists(item, '$.s3_write_requests_per_file')"),
       _need("kms_requests_per_encrypted_file", "section = 'storage' AND json_exists(item, '$.kms_requests_per_encrypted_file') AND coalesce(CAST(json_extract_string(item, '$.encrypted_files_per_day') AS DOUBLE), 0) > 0")])
CTES["i_range"] = " UNION ALL ".join(_bound(b, w) for b, w in _RANGES)
CTES["i_model"] = """SELECT request_id, section, cid AS component_id, 'serving_mode' AS field, 'INVALID_VALUE' AS issue, true AS blocking, CAST(json_extract(item, '$.serving_mode') AS VARCHAR) AS received FROM doc_entry
  WHERE ok AND section IN ('model_endpoints', 'one_time_model_jobs') AND coalesce(json_extract_string(item, '$.serving_mode'), 'PAY_PER_TOKEN') <> 'PAY_PER_TOKEN'
 UNION ALL SELECT request_id, section, cid, 'model', 'INVALID_VALUE', true, CAST(json_extract(item, '$.model') AS VARCHAR) FROM doc_entry WHERE ok AND section IN ('model_endpoints', 'one_time_model_jobs') AND json_type(item, '$.model') = 'VARCHAR'
  AND coalesce(json_extract_string(item, '$.serving_mode'), 'PAY_PER_TOKEN') = 'PAY_PER_TOKEN' AND json_extract_string(item, '$.model') NOT IN (SELECT model FROM ref_model_conversions)"""
_has = {a: (f"coalesce(json_array_length(j, '$.{a}'), 0) > 0" if a in _LISTS else f"coalesce(json_type(j, '$.{a}'), 'NULL') <> 'NULL'") for a in _SECTIONS}
CTES["doc_areas"] = " UNION ALL ".join(f"SELECT request_id, {n} AS pos, '{a}' AS area, upper(json_extract_string(j, '$._areas.{a}')) AS state, CAST(json_extract(j, '$._areas.{a}') AS VARCHAR) AS received, {h} AS has FROM doc_ok" for n, (a, h) in enumerate(_has.items()))
CTES["doc_present"] = "SELECT request_id, count(*) FILTER (WHERE ok AND section <> 'request') AS n FROM doc_entry GROUP BY 1"
_STATES = "('INCLUDED', 'EXCLUDED', 'UNKNOWN', 'NOT_APPLICABLE')"
CTES["i_areas"] = f"""SELECT request_id, CASE WHEN state NOT IN {_STATES} THEN 'request' ELSE area END AS section, NULL AS component_id, CASE WHEN state IN {_STATES} AND NOT has THEN area ELSE '_areas.' || area END AS field,
  CASE WHEN state IN {_STATES} AND NOT has THEN 'MISSING' ELSE 'INVALID_VALUE' END AS issue, true AS blocking, CASE WHEN state IN {_STATES} AND NOT has THEN NULL ELSE received END AS received
  FROM doc_areas WHERE state NOT IN {_STATES} OR has AND state IN ('EXCLUDED', 'NOT_APPLICABLE') OR NOT has AND state = 'INCLUDED'
 UNION ALL SELECT request_id, 'request', NULL, '_areas.' || k, 'UNKNOWN_FIELD', true, '"' || k || '"' FROM (SELECT request_id, unnest(json_keys(j, '$._areas')) AS k FROM doc_ok WHERE json_type(j, '$._areas') = 'OBJECT')
  WHERE k NOT IN ('processing', 'sql', 'transfer', 'storage', 'model_endpoints', 'one_time_model_jobs')
 UNION ALL SELECT request_id, 'request', NULL, '_areas', 'AREA_UNCONFIRMED', true, '"' || string_agg(area, ',' ORDER BY pos) || '"' FROM doc_areas JOIN doc_present USING (request_id) WHERE state IS NULL AND NOT has AND n > 0 GROUP BY request_id"""
CTES["i_none"] = """SELECT request_id, 'request' AS section, NULL AS component_id, 'workload' AS field, 'NO_WORKLOAD' AS issue, true AS blocking, NULL AS received FROM doc_present
 WHERE n = 0 AND request_id NOT IN (SELECT request_id FROM doc_ok WHERE upper(CAST(json_extract(j, '$._areas') AS VARCHAR)) LIKE '%"INCLUDED"%')"""
CTES["i_duplicate"] = """SELECT request_id, 'request' AS section, NULL AS component_id, 'component_id' AS field, 'INVALID_VALUE' AS issue, true AS blocking, '"' || id || '"' AS received
 FROM (SELECT request_id, json_extract_string(item, '$.component_id') AS id FROM doc_entry WHERE ok AND section IN ('processing', 'sql', 'model_endpoints', 'one_time_model_jobs')) WHERE id IS NOT NULL GROUP BY request_id, id HAVING count(*) > 1"""
_MAPS = "('continuous_dbu_per_hour', 'unconfirmed_event_runs_per_month', 'sql_active_hours_per_day', 'sql_concurrency_factor')"
_SCALARS = "('continuous_hours_per_month', 'batch_dbu_per_hour', 'sql_dbu_per_hour_per_band', 'sql_users_per_capacity_band', 'model_stress_call_multiplier', 'min_calibration_peers')"
CTES["i_assumption"] = f"""SELECT request_id, 'request' AS section, NULL AS component_id, 'assumptions.' || k AS field, 'INVALID_VALUE' AS issue, true AS blocking, replace(replace(v, ': ', ':'), ', ', ',') AS received FROM (
 SELECT d.request_id, f.key AS k, CAST(f.value AS VARCHAR) AS v, f.type AS t FROM (SELECT request_id, json_extract(j, '$.assumptions') AS a FROM doc_ok WHERE json_type(j, '$.assumptions') = 'OBJECT') d, json_each(d.a) f)
 WHERE k NOT IN {_MAPS} AND k NOT IN {_SCALARS} OR k IN {_SCALARS} AND (t IN ('OBJECT', 'ARRAY') OR v LIKE '-%' OR k = 'sql_users_per_capacity_band' AND v = '0')
  OR k IN {_MAPS} AND (t <> 'OBJECT' OR len(list_filter(json_keys(CASE WHEN t = 'OBJECT' THEN CAST(v AS JSON) ELSE CAST('{{}}' AS JSON) END), lambda s: s NOT IN ('LOW', 'EXPECTED', 'HIGH', 'STRESS'))) > 0)"""
_ALL = ("i_json", "i_unknown", "i_type", "i_negative", "i_enum", "i_missing", "i_range", "i_model", "i_areas", "i_none", "i_duplicate", "i_assumption")
CTES["i_all"] = " UNION ALL ".join(f"SELECT {_COLS} FROM {n}" for n in _ALL)


def _issues(i, *rules):
    return vd.check(i("raw_requests"), i.ref.model_conversions, *rules)


def _shown(df):
    return df.select(*_COLS.split(", "))


@query("chk_not_json", f"SELECT {_COLS} FROM i_json")
def not_json(i):
    return _shown(_issues(i, "json"))


@query("chk_unknown_field", f"SELECT {_COLS} FROM i_unknown")
def unknown_field(i):
    return _shown(_issues(i, "fields").where("issue = 'UNKNOWN_FIELD'"))


@query("chk_wrong_type", f"SELECT {_COLS} FROM i_type")
def wrong_type(i):
    return _shown(_issues(i, "fields", "shape").where("issue = 'WRONG_TYPE'"))


@query("chk_negative", f"SELECT {_COLS} FROM i_negative")
def negative(i):
    return _shown(_issues(i, "fields").where("issue = 'INVALID_VALUE' AND expected NOT LIKE 'one of%'"))


@query("chk_enum", f"SELECT {_COLS} FROM i_enum")
def enum(i):
    return _shown(_issues(i, "fields", "shape").where("issue = 'INVALID_VALUE' AND (expected LIKE 'one of%' OR expected LIKE 'a list of%')"))


@query("chk_missing", f"SELECT {_COLS} FROM i_missing")
def missing(i):
    return _shown(_issues(i, "entries").where("issue = 'MISSING'"))


@query("chk_range", f"SELECT {_COLS} FROM i_range")
def in_range(i):
    return _shown(_issues(i, "entries").where("issue = 'RANGE_BOUND_MISSING'"))


@query("chk_model", f"SELECT {_COLS} FROM i_model")
def model(i):
    return _shown(_issues(i, "entries").where("issue = 'INVALID_VALUE'"))


@query("chk_areas", f"SELECT {_COLS} FROM i_areas")
def areas(i):
    return _shown(_issues(i, "areas").where("issue <> 'NO_WORKLOAD'"))


@query("chk_no_workload", f"SELECT {_COLS} FROM i_none")
def no_workload(i):
    return _shown(_issues(i, "areas").where("issue = 'NO_WORKLOAD'"))


@query("chk_duplicates", f"SELECT {_COLS} FROM i_duplicate")
def duplicates(i):
    return _shown(_issues(i, "duplicates"))


@query("chk_assumptions", f"SELECT {_COLS} FROM i_assumption")
def assumptions(i):
    return _shown(_issues(i, "assumptions"))


CTES["doc_verdict"] = """SELECT r.request_id, CASE WHEN coalesce(b, false) THEN 'NEEDS_INPUT' ELSE 'READY' END AS status, coalesce(n, 0) AS issues, coalesce(q, '') AS questions FROM raw_requests r
 LEFT JOIN (SELECT request_id, bool_or(blocking) AS b, count(*) AS n, string_agg(DISTINCT CASE WHEN blocking THEN issue || ' ' || field END, '; ' ORDER BY CASE WHEN blocking THEN issue || ' ' || field END) AS q FROM i_all GROUP BY 1) USING (request_id)"""


@query("chk_verdict", """SELECT 'document' AS kind, request_id AS id, status, issues, questions FROM doc_verdict
 UNION ALL SELECT 'name', question_id, 'UNKNOWN_USE_CASE', 1, 'UNKNOWN_USE_CASE use_case' FROM asked WHERE request_json IS NULL AND question_id NOT IN (SELECT question_id FROM ask_key JOIN (SELECT * FROM ask_exact UNION ALL SELECT * FROM ask_prefix) USING (q) WHERE n = 1)""")
def verdict(i):
    from fleetcost.sources.inputs import read_table
    asked = i.spark.sql(_ASKED, orders=read_table(i.spark, i.sf_dir, "orders"))
    unknown = vd.unknown_use_cases(asked, rq.resolve(asked, i("request_wide").select("use_case_id", "use_case_name")))
    named = unknown.select(F.lit("name").alias("kind"), F.col("question_id").alias("id"), "status", F.lit(1).cast("long").alias("issues"), F.lit("UNKNOWN_USE_CASE use_case").alias("questions"))
    d = vd.verdicts(vd.checked(i("raw_requests"), i.ref.model_conversions))
    return d.select(F.lit("document").alias("kind"), F.col("request_id").alias("id"), "status", "issues", "questions").unionByName(named)


_NAMED = "CASE request_id % 3 WHEN 0 THEN true WHEN 1 THEN false END"
_BUILT = ", ".join(f"('{s}', '{f}')" for s, fs in vd.REQUIRED.items() if s not in vd.BUILT_WITHOUT for f in fs)
CTES["i_refused"] = f"""SELECT {_COLS} FROM i_json UNION ALL SELECT {_COLS} FROM i_unknown UNION ALL SELECT {_COLS} FROM i_duplicate UNION ALL SELECT {_COLS} FROM i_assumption
 UNION ALL SELECT {_COLS} FROM i_type t WHERE field <> '_areas' AND NOT (try_cast(received AS DOUBLE) IS NOT NULL AND EXISTS (SELECT 1 FROM field_dic d WHERE d.section = t.section AND d.field = t.field AND d.kind = 'whole'))
 UNION ALL SELECT request_id, section, cid, field, 'INVALID_VALUE', true, value FROM doc_fields WHERE kind IN ('number', 'whole') AND val < 0
 UNION ALL SELECT {_COLS} FROM i_enum WHERE field IN ('workload_type', 'dbu_per_hour_evidence', 'scenarios') UNION ALL SELECT {_COLS} FROM i_missing WHERE (section, field) IN ({_BUILT})"""
_ERROR = "issue || ' ' || field || coalesce(' (' || component_id || ')', '') || coalesce(', received ' || received, '')"
CTES["doc_mode"] = f"""SELECT request_id, named, CASE WHEN errors = '' THEN 'READY' WHEN named IS NULL THEN 'REJECTED' ELSE 'NEEDS_INPUT' END AS status, issues, errors FROM (
 SELECT r.request_id, r.named, coalesce(i.issues, 0) AS issues, coalesce(i.errors, '') AS errors FROM (SELECT request_id, {_NAMED} AS named FROM raw_requests) r
 LEFT JOIN (SELECT request_id, adhoc, count(*) AS issues, string_agg(DISTINCT CASE WHEN blocking THEN {_ERROR} END, '; ' ORDER BY CASE WHEN blocking THEN {_ERROR} END) AS errors
  FROM (SELECT true AS adhoc, {_COLS} FROM i_all UNION ALL SELECT false, {_COLS} FROM i_refused) GROUP BY 1, 2) i ON i.request_id = r.request_id AND i.adhoc = (r.named IS NOT DISTINCT FROM false))"""


@query("chk_modes", "SELECT request_id, named, status, issues, errors FROM doc_mode")
def check_modes(i):
    """The documents as loaded use cases, as new ones and without a check, a third each."""
    d = vd.judged(vd.checked(i("raw_requests"), i.ref.model_conversions), F.expr(_NAMED))
    return d.select("request_id", "named", "status", "issues", "errors")


# ---- documents with what-if overrides: as rows (path, value), or as a document of their own, also a malformed one -------------------------------------
_CHANGES = {1: [("transfer.daily_gb_high", "-1")], 4: [("processing[C01].runs_per_month", "12"), ("_areas.processing", "INCLUDED")], 5: [("sql.concurrent_users", "5"), ("region", "EU_WEST_1")],
            6: [("use_case_name", "7"), ("moon", '{"a": 1}')]}
_TEXTS = {2: "not; json", 3: "[1]"}
_IS = "coalesce(json_type(j, '$.{p}'), 'NULL') IN ('NULL', 'OBJECT')"
CTES["over_json"] = f"""SELECT request_id, k, j, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN j WHEN k = 1 THEN json_merge_patch(j, '{{"transfer": {{"daily_gb_high": -1}}}}')
  WHEN k = 4 THEN CASE WHEN {_IS.format(p='_areas')} THEN json_merge_patch(p, '{{"_areas": {{"processing": "INCLUDED"}}}}') ELSE p END WHEN k = 5 THEN CASE WHEN {_IS.format(p='sql')} THEN json_merge_patch(j, '{{"region": "EU_WEST_1", "sql": {{"concurrent_users": 5}}}}')
   ELSE json_merge_patch(j, '{{"region": "EU_WEST_1"}}') END WHEN k = 6 THEN json_merge_patch(j, '{{"use_case_name": 7, "moon": {{"a": 1}}}}') ELSE j END AS o
 FROM (SELECT *, CASE WHEN json_type(j, '$.processing') = 'ARRAY' THEN json_merge_patch(j, json_object('processing', list_transform(json_extract(j, '$.processing[*]'), lambda e:
   CASE WHEN json_extract_string(e, '$.component_id') = 'C01' THEN json_merge_patch(e, '{{"runs_per_month": 12}}') ELSE e END))) ELSE j END AS p FROM (SELECT request_id, request_id % 7 AS k, CASE WHEN json_valid(request_json) THEN CAST(request_json AS JSON) END AS j FROM raw_requests))"""
CTES["over_docs"] = "SELECT request_id, CASE WHEN o IS NULL THEN 'none' ELSE CAST(o AS VARCHAR) END AS request_json FROM over_json WHERE k <> 2"
derive("o_", {"raw_requests": "over_docs"}, "i_all")
CTES["i_over"] = f"""SELECT {_COLS} FROM o_i_all UNION ALL SELECT request_id, 'overrides', NULL, 'overrides', 'NOT_JSON', true, NULL FROM over_json WHERE k = 2 UNION ALL SELECT request_id, 'overrides', NULL, 'overrides', 'INVALID_VALUE', true, '[1]' FROM over_json WHERE k = 3
 UNION ALL SELECT request_id, 'overrides', 'C01', 'processing[C01].runs_per_month', 'INVALID_VALUE', true, '12' FROM over_json WHERE k = 4 AND json_type(j) = 'OBJECT' AND NOT coalesce(list_contains(json_extract_string(j, '$.processing[*].component_id'), 'C01'), false)
 UNION ALL SELECT request_id, 'overrides', NULL, '_areas.processing', 'INVALID_VALUE', true, '"INCLUDED"' FROM over_json WHERE k = 4 AND json_type(j) = 'OBJECT' AND NOT {_IS.format(p='_areas')}
 UNION ALL SELECT request_id, 'overrides', NULL, 'sql.concurrent_users', 'INVALID_VALUE', true, '5' FROM over_json WHERE k = 5 AND json_type(j) = 'OBJECT' AND NOT {_IS.format(p='sql')}"""


@query("chk_overrides", f"SELECT {_COLS} FROM i_over")
def check_overrides(i):
    """The documents as changed by what-if overrides, and what is wrong with these."""
    raw, k = i("raw_requests"), F.col("request_id") % 7
    given = F.coalesce(*[F.when(k == n, F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in rows])) for n, rows in _CHANGES.items()])
    rows = raw.select("request_id", F.explode_outer(given).alias("x")).where("x IS NOT NULL").select("request_id", "x.*")
    text = F.coalesce("overrides_json", *[F.when(k == n, t) for n, t in _TEXTS.items()])
    asked = raw.join(vd.override_texts(rows), "request_id", "left").withColumn("overrides_json", text)
    return _shown(vd.check(asked, i.ref.model_conversions))


CTES["intake"] = values([(c, "string") for c in vd.INTAKE_COLUMNS], vd.intake_rows())


@query("chk_intake_catalog", "SELECT m.request_id, d.* FROM i_missing m JOIN intake d ON d.area = m.section AND d.field = m.field")
def intake_catalog(i):
    """Questions still open per request: the catalogue joined to the issues of each document."""
    missing = _issues(i, "entries").where("issue = 'MISSING'").select("request_id", F.col("section").alias("area"), "field")
    return missing.join(vd.intake_catalog(i.spark), ["area", "field"]).select("request_id", "area", "field", "type", "requirement", "default_value", "question")
