"""Input check of request documents: issue rows for a table of JSON texts.

Documents are parsed once to VARIANT, changed there by their what-if overrides, and judged within their row: each rule gives an array of issues, out of the
document, its entries or their fields. Nothing is joined or shuffled; issues become rows only where a caller asks for rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcost.plans.compute import WORKLOAD_TYPES
from fleetcost.plans.requests import (
    ABSENT_DEFAULTS, AREA_STATES, AREAS, ASSUMPTION_MAPS, ASSUMPTION_SCALARS, DEFAULT_SCENARIOS, FIELD_DEFAULTS, LIST_SECTIONS, SCENARIOS, SECTIONS,
)

# ---- fixed values: allowed texts, required fields, areas that need inputs ---------------------------------------------
ENUMS = {("processing", "workload_type"): WORKLOAD_TYPES,
         ("processing", "streaming_mode"): ("TRUE_CONTINUOUS_LOW_LATENCY", "INCREMENTAL_AVAILABLE_NOW", "UNCONFIRMED"),
         ("processing", "latency_requirement"): ("SECONDS", "MINUTES_OR_MORE", "UNCONFIRMED"),
         ("processing", "dbu_per_hour_evidence"): ("CONFIRMED", "RANGE_DERIVED", "PLANNING_ASSUMPTION")}
AT_LEAST_ONE = {("processing", "quantity"), ("sql", "concurrent_users")}
REQUIRED = {"request": ("use_case_id", "use_case_name"), "processing": ("component_id", "name", "workload_type"), "sql": ("component_id", "name", "concurrent_users"),
            "transfer": (), "storage": ("retained_tb", "files_per_day", "s3_read_requests_per_file"), "model_endpoints": ("component_id", "model", "role", "calls_per_day"),
            "one_time_model_jobs": ("component_id", "model", "description", "input_tokens_low", "input_tokens_high", "output_tokens_low", "output_tokens_high")}
REQUEST_FIELDS = {"use_case_id": "text", "use_case_name": "text", "scenarios": "list", "region": "text", "model_days_per_month": "whole", "calibration_allowed": "flag",
                  "scope_included": "list", "scope_excluded": "list", "notes": "list", "metadata": "any"}
_KIND = {"string": "text", "double": "number", "int": "whole", "boolean": "flag", "map<string,double>": "map"}
EXPECTED = {"text": "text", "number": "a number", "whole": "a whole number", "flag": "true or false", "map": "a map from scenario to number", "list": "a list", "any": ""}
INTAKE_REQUIRED = {"processing": ("workload_type", "runtime_hours_expected", "runs_per_month"), "sql": ("concurrent_users",), "transfer": ("daily_gb_expected",),
                   "storage": ("retained_tb", "files_per_day", "s3_read_requests_per_file"),
                   "model_endpoints": ("model", "calls_per_day", "input_tokens_expected", "output_tokens_expected"),
                   "one_time_model_jobs": ("model", "input_tokens_low", "input_tokens_high", "output_tokens_low", "output_tokens_high")}
INTAKE_SKIP = ("component_id", "name", "evidence", "dbu_per_hour_basis", "dbu_per_hour_evidence", "role", "description")
ISSUE_COLUMNS = ("section", "component_id", "field", "issue", "blocking", "expected", "received", "question")


def _issue(section: Column, cid: Column, field, issue: str, expected, received=None, blocking: bool = True, question=None) -> Column:
    field = field if isinstance(field, Column) else F.lit(field)
    received = F.lit(None) if received is None else received
    ask = question if question is not None else F.concat(F.lit("Please give "), field, F.lit(" of "), F.coalesce(cid, section), F.lit("."))
    return F.struct(section.alias("section"), cid.cast("string").alias("component_id"), field.alias("field"), F.lit(issue).alias("issue"), F.lit(blocking).alias("blocking"),
                    (expected if isinstance(expected, Column) else F.lit(expected)).alias("expected"), received.cast("string").alias("received"), ask.alias("question"))


def _kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def _part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _object(v: Column) -> Column:
    """The fields of an object as a map; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


_BARE = {"OBJECT": "struct<>", "ARRAY": "array<struct<>>"}


def _is(v: Column, shape: str, path: str = "$") -> Column:
    """Whether a value, or its part at a path, is an OBJECT or an ARRAY; what is in it is neither copied nor described."""
    return F.try_variant_get(v, path, _BARE[shape]).isNotNull()


def _no_issues() -> Column:
    return F.array().cast(f"array<struct<{', '.join(f'{c}: ' + ('boolean' if c == 'blocking' else 'string') for c in ISSUE_COLUMNS)}>>")


def _found(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


# ---- what-if overrides on the document itself --------------------------------------------------------------------------------
_HEAD, _LAST = r"^(.*)\.[^.]*$", r"([^.]*)$"
_COMPONENT = r"^processing\[(.*)\]$"


def override_texts(overrides: DataFrame) -> DataFrame:
    """Rows (request_id, path, value) as one override document per request: request_id, overrides_json. A value that is JSON is taken as such, any other as a text."""
    value = F.coalesce(F.try_parse_json("value"), F.try_parse_json(F.to_json(F.array("value"))))
    text = F.try_parse_json("value").isNull() & F.col("value").isNotNull()
    given = F.when(text, F.try_variant_get(value, "$[0]", "variant")).when(F.col("value").isNull(), F.parse_json(F.lit("null"))).otherwise(value)
    one = overrides.groupBy("request_id", "path").agg(F.max("value").alias("value"))
    return one.groupBy("request_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", given.alias("value"))))).alias("overrides_json"))


def _patches() -> Column:
    """The entries of an override document: path, the part before its last point (`head`), the rest (`field`), the component id if there is one, the value."""
    def of(e: Column) -> Column:
        head = F.when(e.key.contains("."), F.regexp_extract(e.key, _HEAD, 1))
        return F.struct(e.key.alias("path"), head.alias("head"), F.regexp_extract(e.key, _LAST, 1).alias("field"), F.when(head.rlike(_COMPONENT), F.regexp_extract(head, _COMPONENT, 1)).alias("cid"), e.value.alias("value"))
    return F.transform(F.map_entries(_object(F.col("o"))), of)


def _names(component: Column, cid: Column) -> Column:
    """Whether an override's component id means this component: its whole id, or the end of it after a hyphen."""
    own = F.coalesce(F.try_variant_get(component, "$.component_id", "string"), F.lit(""))
    return (own == cid) | own.endswith(F.concat(F.lit("-"), cid))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _with(fields: Column, new: Column) -> Column:
    """An object: the fields of a map, replaced or joined by entries (field, value), of which the last of a field counts."""
    def joined(n: Column) -> Column:
        kept = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,variant>")), lambda k, _: ~F.exists(n, lambda p: p.field == k))
        last = F.filter(n, lambda p, at: ~F.exists(F.slice(n, at + 2, F.size(n)), lambda q: q.field == p.field))
        return F.to_variant_object(F.map_concat(kept, F.map_from_entries(F.transform(last, lambda p: F.struct(p.field, p.value)))))
    return _let(new, joined)


def patched(d: DataFrame) -> DataFrame:
    """Documents (v) with their override document (o) applied: top-level fields, whole sections, `section.field` (a missing section is created), `_areas.area` and
    `processing[id].field`. A whole section is set before its fields. What can't be applied leaves the document as it was; override_issues() says so."""
    d = d.withColumn("patches", _patches())
    part = lambda keep: F.filter("patches", keep)
    d = d.withColumns({"p_top": part(lambda p: p.head.isNull()), "p_section": part(lambda p: p.head.isNotNull() & p.cid.isNull()), "p_component": part(lambda p: p.cid.isNotNull())})
    some = lambda c: F.col("is_object") & F.coalesce(F.size(c) > 0, F.lit(False))
    fields = _object(F.col("v"))
    d = d.withColumn("v", F.when(some("p_top"), _with(fields, F.col("p_top"))).otherwise(F.col("v")))

    def section(head: Column) -> Column:
        def filled(old: Column) -> Column:
            free = old.isNull() | F.is_variant_null(old) | _is(old, "OBJECT")
            return F.when(free, _with(_object(old), F.filter("p_section", lambda p: p.head == head))).otherwise(old)
        return F.struct(head.alias("field"), _let(F.try_element_at(fields, head), filled).alias("value"))
    heads = F.array_distinct(F.transform("p_section", lambda p: p.head))
    d = d.withColumn("v", F.when(some("p_section"), _with(fields, F.transform(heads, section))).otherwise(F.col("v")))

    def component(c: Column) -> Column:
        own = lambda mine: F.when(_is(c, "OBJECT") & (F.size(mine) > 0), _with(_object(c), mine)).otherwise(c)
        return _let(F.filter("p_component", lambda p: _names(c, p.cid)), own)
    listed = F.transform(F.try_variant_get("v", "$.processing", "array<variant>"), component)
    whole = F.array(F.struct(F.lit("processing").alias("field"), F.to_variant_object(listed).alias("value")))
    d = d.withColumn("v", F.when(some("p_component") & _is(_part(F.col("v"), "processing"), "ARRAY"), _with(fields, whole)).otherwise(F.col("v")))
    return d.drop("p_top", "p_section", "p_component")


def _override_issues() -> Column:
    """Of an override document: no JSON object, a component the request does not have, a field of something that is not an object."""
    none, sec = F.lit(None).cast("string"), F.lit("overrides")
    want = "an object of field: value pairs"
    bad = F.when(F.col("overrides_json").isNotNull() & F.col("o").isNull(), _issue(sec, none, "overrides", "NOT_JSON", "valid JSON", question=F.lit("The changes are not valid JSON. Please send them as field: value pairs."))).when(
        F.col("o").isNotNull() & ~_is(F.col("o"), "OBJECT"), _issue(sec, none, "overrides", "INVALID_VALUE", want, F.to_json("o"), question=F.lit("Please send the changes as field: value pairs.")))
    have = F.coalesce(F.try_variant_get("v", "$.processing", "array<variant>"), F.array().cast("array<variant>"))

    def lost(p: Column) -> Column:
        unknown = p.cid.isNotNull() & ~F.exists(have, lambda c: _names(c, p.cid))
        part = F.when(p.cid.isNull() & p.head.isNotNull(), F.try_element_at(_object(F.col("v")), p.head))
        closed = _let(part, lambda x: x.isNotNull() & ~F.is_variant_null(x) & ~_is(x, "OBJECT"))
        return F.when(unknown, _issue(sec, p.cid, p.path, "INVALID_VALUE", "a processing component of the request", F.to_json(p.value))).when(
            closed, _issue(sec, none, p.path, "INVALID_VALUE", "a field of an object", F.to_json(p.value)))
    return F.concat(_found(bad), F.coalesce(F.when(F.col("is_object"), F.array_compact(F.transform("patches", lost))), _no_issues()))


# ---- documents, parsed once ----------------------------------------------------------------------------------------------------
def parsed(raw: DataFrame) -> DataFrame:
    """Add `v`, the document as VARIANT (NULL when it is not JSON) with its override document applied, `is_object`, `o` and `patches` (NULL without overrides_json)."""
    d = raw.withColumn("v", F.try_parse_json("request_json"))
    d = d.withColumn("is_object", _is(F.col("v"), "OBJECT"))
    if "overrides_json" not in raw.columns:
        return d
    text = F.nullif(F.trim("overrides_json"), F.lit(""))
    return patched(d.withColumn("overrides_json", text).withColumn("o", F.try_parse_json("overrides_json")))


def scenario_list(d: DataFrame) -> DataFrame:
    """Add `scenarios`: the stated list when it is valid, else the default one, and `scenarios_ok`."""
    s = F.try_variant_get(F.col("v"), "$.scenarios", "array<string>")
    stated = _part(F.col("v"), "scenarios")
    missing = stated.isNull() | F.is_variant_null(stated)
    known = F.array(*map(F.lit, SCENARIOS))
    good = s.isNotNull() & (F.size(F.array_except(s, known)) == 0)
    default = F.array(*map(F.lit, DEFAULT_SCENARIOS))
    return d.withColumns({"scenarios_ok": missing | F.coalesce(good, F.lit(False)), "scenarios": F.when(~missing & F.coalesce(good, F.lit(False)) & (F.size(s) > 0), s).otherwise(default)})


def _items() -> Column:
    """The entries of all sections of a document: section, label, item, whether it is an object (`ok`), and the id to report (`cid`); the document itself first, as section `request`."""
    def entry(section: str, label: Column, item: Column, ok: Column, own_id: Column | None) -> Column:
        cid = label if own_id is None else F.when(F.coalesce(_kind_of(own_id) == "STRING", F.lit(False)), F.try_variant_get(own_id, "$", "string")).otherwise(label)
        return F.struct(F.lit(section).alias("section"), label.alias("label"), item.alias("item"), ok.alias("ok"), cid.alias("cid"))

    def entries(name: str) -> Column:
        if name in LIST_SECTIONS:
            return F.transform(F.try_variant_get(F.col("v"), f"$.{name}", "array<variant>"),
                               lambda x, n: entry(name, F.concat(F.lit(f"{name}["), n.cast("string"), F.lit("]")), x, _is(x, "OBJECT"), _part(x, "component_id")))
        whole = entry(name, F.lit(name), _part(F.col("v"), name), F.lit(True), _part(F.col("v"), f"{name}.component_id"))
        return F.when(_is(F.col("v"), "OBJECT", f"$.{name}"), F.array(whole))
    own = F.array(entry("request", F.lit(None).cast("string"), F.col("v"), F.lit(True), None))
    none = F.array().cast("array<struct<section: string, label: string, item: variant, ok: boolean, cid: string>>")
    return F.when(F.col("is_object"), F.concat(own, *[F.coalesce(entries(n), none) for n in SECTIONS]))


def documents(raw: DataFrame, conversions: DataFrame) -> DataFrame:
    """The documents with all that the rules look at: v, is_object, scenarios, items, and the priced models as one small array (bounded by the conversion table)."""
    known = conversions.agg(F.sort_array(F.collect_set(F.concat("serving_mode", F.lit("/"), "model")))).scalar()
    return scenario_list(parsed(raw)).withColumn("items", _items()).withColumn("priced_models", known)


# ---- rules: each gives an array of the issues of one document ------------------------------------------------------------------
def _json_issues() -> Column:
    """Documents that are not JSON, or not an object."""
    none, sec = F.lit(None).cast("string"), F.lit("request")
    return _found(F.when(F.col("v").isNull(), _issue(sec, none, "request", "NOT_JSON", "valid JSON", question=F.lit("This text is no JSON; please mend it."))).when(
        ~F.col("is_object"), _issue(sec, none, "request", "WRONG_TYPE", "a JSON object", F.to_json("v"), question=F.lit("A request has to be one JSON object."))))


def _shape_issues() -> Column:
    """Sections that are not a list or object, entries that are not an object, an invalid scenario list, areas that are not an object."""
    v, none = F.col("v"), F.lit(None).cast("string")

    def check(name: str) -> Column:
        part = _part(v, name)
        want, text = ("ARRAY", "a list of objects") if name in LIST_SECTIONS else ("OBJECT", "a JSON object")
        bad = ~_is(v, want, f"$.{name}") & part.isNotNull() & ~F.is_variant_null(part)
        return F.when(bad, _issue(F.lit(name), none, name, "WRONG_TYPE", text, F.to_json(part)))
    areas = _part(v, "_areas")
    bad_areas = ~_is(v, "OBJECT", "$._areas") & areas.isNotNull() & ~F.is_variant_null(areas)
    entries = F.transform(F.filter("items", lambda x: ~x.ok), lambda x: _issue(x.section, none, x.label, "WRONG_TYPE", "a JSON object", F.to_json(x.item)))
    return F.concat(_found(*[check(n) for n in SECTIONS], F.when(~F.col("scenarios_ok"), _issue(F.lit("request"), none, "scenarios", "INVALID_VALUE", "a list of " + ", ".join(SCENARIOS), F.to_json(_part(v, "scenarios")))),
                           F.when(bad_areas, _issue(F.lit("request"), none, "_areas", "WRONG_TYPE", "an object from area to state", F.to_json(areas)))), entries)


def _known_fields() -> tuple[Column, Column]:
    """Maps from section to its fields: to a map from name to (kind, choices, floor), and to the names in order."""
    rows = [("request", f, k, None, None) for f, k in REQUEST_FIELDS.items()]
    rows += [(s, f, _KIND[t], ENUMS.get((s, f)), 1.0 if (s, f) in AT_LEAST_ONE else None) for s, fs in SECTIONS.items() for f, t in fs]
    choices = lambda c: F.array(*map(F.lit, c)) if c else F.lit(None).cast("array<string>")
    field = lambda k, c, m: F.struct(F.lit(k).alias("kind"), choices(c).alias("choices"), F.lit(m).cast("double").alias("floor"))
    sections = ("request", *SECTIONS)
    fields = F.create_map(*[x for s in sections for x in (F.lit(s), F.create_map(*[y for o, f, *d in rows if o == s for y in (F.lit(f), field(*d))]))])
    names = F.create_map(*[x for s in sections for x in (F.lit(s), F.array(*map(F.lit, sorted(f for o, f, *_ in rows if o == s))))])
    return fields, names


def _field_issues() -> Column:
    """Unknown fields (with the nearest known name), wrong types, negative numbers, unknown choices, values below their floor. The type of a field and what is known of it are
    looked up once; only a field that does not plainly fit is judged rule by rule."""
    known, names = _known_fields()
    expected = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    is_number = lambda t: t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")

    def looked_up(x: Column, e: Column) -> Column:
        return F.struct(e.key.alias("name"), e.value.alias("value"), _kind_of(e.value).alias("t"), F.try_element_at(known[x.section], e.key).alias("d"))

    def fits(f: Column) -> Column:
        """True of most fields that nothing is wrong with, and of no other."""
        kind, val = f.d["kind"], F.try_variant_get(f.value, "$", "double")
        chosen = f.d["choices"].isNull() | F.array_contains(f.d["choices"], F.try_variant_get(f.value, "$", "string"))
        plain = (F.when(f.t == "VOID", True).when(kind == "text", (f.t == "STRING") & chosen).when(kind == "number", is_number(f.t) & (val >= 0))
                 .when(kind == "whole", is_number(f.t) & (val >= 0) & (val == F.floor(val))).when(kind == "flag", f.t == "BOOLEAN").when(kind == "list", f.t.startswith("ARRAY")))
        return F.coalesce(kind.isNotNull() & plain & (f.d["floor"].isNull() | (val >= f.d["floor"])), F.lit(False))

    def judge(x: Column, f: Column) -> Column:
        sec, cid, name, value, d, t, near_names = x.section, x.cid, f["name"], f.value, f.d, f.t, names[x.section]
        kind, got, number = d["kind"], F.to_json(value), is_number(t)
        val = F.when(number, F.try_variant_get(value, "$", "double"))
        near = F.array_min(F.transform(near_names, lambda k: F.struct(F.levenshtein(k, name).alias("distance"), k.alias("name"))))
        close = near["distance"] <= F.greatest(F.lit(1), F.floor(F.length(name) * 0.4))
        unknown_question = F.concat(name, F.lit(" is not a field of "), sec, F.when(close, F.concat(F.lit(": is "), near["name"], F.lit(" meant?"))).otherwise(": please remove or rename it."))
        numeric = kind.isin("number", "whole")
        bad_map = ~t.startswith("OBJECT") | t.rlike(": (STRING|BOOLEAN|VOID|ARRAY|OBJECT)")
        wrong = ((numeric & ~number) | ((kind == "flag") & (t != "BOOLEAN")) | ((kind == "text") & (t != "STRING")) | ((kind == "map") & bad_map) | ((kind == "list") & ~t.startswith("ARRAY"))
                 | ((kind == "whole") & (val >= 0) & (val != F.floor(val))))
        first = (F.when(kind.isNull(), _issue(sec, cid, name, "UNKNOWN_FIELD", F.array_join(near_names, ", "), F.concat(F.lit('"'), name, F.lit('"')), question=unknown_question))
                 .when(t == "VOID", None)
                 .when((kind == "list") & (name == "scenarios"), None)      # reported with the scenario list
                 .when(wrong, _issue(sec, cid, name, "WRONG_TYPE", expected[kind], got))
                 .when(numeric & (val < 0), _issue(sec, cid, name, "INVALID_VALUE", "a number of 0 or more", got)))
        enum = F.when((t == "STRING") & d["choices"].isNotNull() & ~F.array_contains(d["choices"], F.try_variant_get(value, "$", "string")),
                      _issue(sec, cid, name, "INVALID_VALUE", F.concat(F.lit("one of "), F.array_join(d["choices"], ", ")), got))
        return _found(first, enum, F.when(val < d["floor"], _issue(sec, cid, name, "INVALID_VALUE", "1 or more", got)))

    def entry(x: Column) -> Column:
        outer = (x.section == "request") & F.lit(True)
        stated = F.filter(F.map_entries(_object(x.item)), lambda e: ~e.key.startswith("_") & ~(outer & e.key.isin("assumptions", *SECTIONS)))
        doubtful = F.filter(F.transform(stated, lambda e: looked_up(x, e)), lambda f: ~fits(f))
        return F.flatten(F.transform(doubtful, lambda f: judge(x, f)))
    return F.flatten(F.transform(F.filter("items", lambda x: x.ok), entry))


def _entry_issues() -> Column:
    """Missing required fields, range rules, unknown models: rules over several fields of one entry."""
    return F.flatten(F.transform(F.filter("items", lambda x: x.ok), _one_entry))


def _one_entry(x: Column) -> Column:
    """The rules of the entry's own section."""
    sec, cid, item, scen = x.section, x.cid, x.item, F.col("scenarios")

    def text(f: str) -> Column:
        return F.try_variant_get(item, f"$.{f}", "string")

    def absent(f: str) -> Column:
        return text(f).isNull()

    def stated(f: str) -> Column:      # named in the document, also with null
        return F.map_contains_key(_object(item), f)

    def missing(f: str, condition: Column = F.lit(True)) -> Column:
        return F.when(condition & absent(f), _issue(sec, cid, f, "MISSING", "required"))

    def ranged(base: str) -> Column:
        def judge(gone: Column) -> Column:
            lo, ex, hi = gone.low, gone.expected, gone.high
            none = lo & ex & hi
            middle = (~lo & ~hi) if base.endswith("tokens") else F.lit(False)
            out = [F.when(none | (ex & F.array_contains(scen, "EXPECTED") & ~middle), _issue(sec, cid, f"{base}_expected", "MISSING", "required"))]
            for b, uses in (("low", F.array_contains(scen, "LOW")), ("high", F.arrays_overlap(scen, F.array(F.lit("HIGH"), F.lit("STRESS"))))):
                out.append(F.when(~none & gone[b] & uses, _issue(sec, cid, f"{base}_{b}", "RANGE_BOUND_MISSING", "optional: without it a scenario stays pending", blocking=False)))
            return _found(*out)
        return _let(F.struct(*[absent(f"{base}_{b}").alias(b) for b in ("low", "expected", "high")]), judge)
    required = {s: _found(*[missing(f) for f in fs]) if fs else _no_issues() for s, fs in REQUIRED.items()}
    kind = text("workload_type")
    batch = kind.isin(*[w for w in WORKLOAD_TYPES if w != "CONTINUOUS_STREAMING"])
    runs = _found(missing("runs_per_month", kind != "EVENT_DRIVEN_BATCH"))
    encrypted = F.coalesce(F.try_variant_get(item, "$.encrypted_files_per_day", "double"), F.lit(0.0)) > 0
    requests = _found(F.when(absent("s3_write_requests_per_file"), missing("s3_write_requests_per_file", stated("s3_write_requests_per_file"))),
                      F.when(encrypted & absent("kms_requests_per_encrypted_file"), missing("kms_requests_per_encrypted_file", stated("kms_requests_per_encrypted_file"))))
    mode = F.coalesce(text("serving_mode"), F.lit("PAY_PER_TOKEN"))
    other = mode != "PAY_PER_TOKEN"
    is_text = F.coalesce(_kind_of(_part(item, "model")) == "STRING", F.lit(False))
    models = _found(F.when(other, _issue(sec, cid, "serving_mode", "INVALID_VALUE", "PAY_PER_TOKEN", F.concat(F.lit('"'), mode, F.lit('"')))),
                    F.when(~other & is_text & ~F.array_contains(F.col("priced_models"), F.concat(mode, F.lit("/"), text("model"))),
                           _issue(sec, cid, "model", "INVALID_VALUE", "a model with a conversion", F.concat(F.lit('"'), text("model"), F.lit('"')))))
    more = {"processing": [F.when(batch, F.concat(ranged("runtime_hours"), runs)).otherwise(_no_issues())], "transfer": [ranged("daily_gb")], "storage": [requests],
            "model_endpoints": [ranged("input_tokens"), ranged("output_tokens"), models], "one_time_model_jobs": [models]}
    found = _no_issues()
    for s, own in required.items():
        found = F.when(sec == s, F.concat(own, *more.get(s, []))).otherwise(found)
    return found


def _area_issues() -> Column:
    """Unknown areas, bad states, contradictions between states and inputs, unconfirmed areas, nothing to estimate."""
    v, none, sec = F.col("v"), F.lit(None).cast("string"), F.lit("request")

    def given(name: str) -> Column:
        if name in LIST_SECTIONS:
            return _part(v, f"{name}[0]").isNotNull()
        part = _part(v, name)
        return _is(v, "OBJECT", f"$.{name}") | (part.isNotNull() & ~F.is_variant_null(part))
    present = F.exists("items", lambda x: x.ok & (x.section != "request"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def judge(of: Column) -> Column:
        raw = of["raw"]
        unknown = F.transform(F.array_except(F.map_keys(raw), F.array(*map(F.lit, AREAS))), lambda k: _issue(sec, none, F.concat(F.lit("_areas."), k), "UNKNOWN_FIELD", ", ".join(AREAS), F.concat(F.lit('"'), k, F.lit('"'))))
        found, open_areas = [], []
        for a in AREAS:
            state, value = F.upper(raw[a]), raw[a]
            good = state.isin(*AREA_STATES)
            found.append(F.when(state.isNotNull() & ~good, _issue(sec, none, f"_areas.{a}", "INVALID_VALUE", ", ".join(AREA_STATES), quoted(value)))
                         .when(of[a] & state.isin("EXCLUDED", "NOT_APPLICABLE"), _issue(F.lit(a), none, f"_areas.{a}", "INVALID_VALUE", "INCLUDED (inputs are given)", quoted(value)))
                         .when(~of[a] & (state == "INCLUDED"), _issue(F.lit(a), none, a, "MISSING", "required: the area is included but has no inputs")))
            open_areas.append(F.when(state.isNull() & ~of[a], F.lit(a)))
        unconfirmed = F.array_join(F.array_compact(F.array(*open_areas)), ",")
        found.append(_let(unconfirmed, lambda u: F.when((u != "") & of["present"], _issue(sec, none, "_areas", "AREA_UNCONFIRMED", "a state for each area", quoted(u)))))
        included = F.coalesce(F.exists(F.map_values(raw), lambda s: F.upper(s) == "INCLUDED"), F.lit(False))
        found.append(F.when(~of["present"] & ~included, _issue(sec, none, "workload", "NO_WORKLOAD", "at least one section", question=F.lit("Which workload is it about?"))))
        return F.concat(_found(*found), F.coalesce(unknown, _no_issues()))
    return _let(F.struct(F.try_variant_get(v, "$._areas", "map<string,string>").alias("raw"), present.alias("present"), *[given(a).alias(a) for a in AREAS]), judge)


def _duplicate_issues() -> Column:
    """Component ids that occur more than once in a request."""
    named = F.filter("items", lambda x: x.ok & x.section.isin("processing", "sql", "model_endpoints", "one_time_model_jobs"))
    ids = F.array_compact(F.transform(named, lambda x: F.try_variant_get(x.item, "$.component_id", "string")))
    again = F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)
    return F.transform(again, lambda i: _issue(F.lit("request"), F.lit(None), "component_id", "INVALID_VALUE", "unique component ids", F.concat(F.lit('"'), i, F.lit('"'))))


def _assumption_issues() -> Column:
    """Unknown assumptions, wrong shapes, negative values, unknown scenarios, no users per band."""
    def judge(e: Column) -> Column:
        name, value = e.key, e.value
        t, val = _kind_of(value), F.try_variant_get(value, "$", "double")
        scalar, mapped = name.isin(*ASSUMPTION_SCALARS), name.isin(*ASSUMPTION_MAPS)
        entries = F.try_variant_get(value, "$", "map<string,double>")
        foreign = F.size(F.array_except(F.map_keys(entries), F.array(*map(F.lit, SCENARIOS)))) > 0
        reason = (F.when(~scalar & ~mapped, "unknown assumption").when(scalar & t.rlike("^(OBJECT|ARRAY)"), "must be a single number").when(mapped & ~t.startswith("OBJECT"), "must be a scenario map")
                  .when(scalar & (val < 0), "must not be negative").when((name == "sql_users_per_capacity_band") & (val <= 0), "must be greater than zero")
                  .when(mapped & foreign, "unknown scenario").when(mapped & F.exists(F.map_values(entries), lambda z: z < 0), "must not be negative"))
        return F.when(reason.isNotNull(), _issue(F.lit("request"), F.lit(None), F.concat(F.lit("assumptions."), name), "INVALID_VALUE", reason, F.to_json(value)))
    given = F.filter(F.map_entries(_object(_part(F.col("v"), "assumptions"))), lambda e: ~e.key.startswith("_"))
    return F.coalesce(F.array_compact(F.transform(given, judge)), _no_issues())


RULES = {"json": _json_issues, "shape": _shape_issues, "fields": _field_issues, "entries": _entry_issues, "areas": _area_issues, "duplicates": _duplicate_issues, "assumptions": _assumption_issues}


def checked(raw: DataFrame, conversions: DataFrame, *rules: str) -> DataFrame:
    """The rows of `raw` (request_id, request_json, perhaps overrides_json) with v, is_object and `issues`, an array of all that the named rules (all without a
    name) find. A document is parsed once and judged within its row: nothing is shuffled.

    With overrides_json the document is judged as changed by it. An override text that is no JSON is the only issue of its request.
    """
    d = documents(raw, conversions)
    found = [F.when(F.col("is_object"), RULES[r]()).otherwise(_no_issues()) if r != "json" else RULES[r]() for r in rules or RULES]
    issues = F.concat(*found)
    if "overrides_json" in raw.columns and not rules:
        own = _override_issues()
        issues = F.when(F.col("overrides_json").isNotNull() & F.col("o").isNull(), own).otherwise(F.concat(own, issues))
    return d.select(*[F.col(c) for c in raw.columns], "v", "is_object", issues.alias("issues"))


def check(raw: DataFrame, conversions: DataFrame, *rules: str) -> DataFrame:
    """The issues as rows: request_id and the eight issue columns."""
    # explode_outer: the optimizer copies the whole array expression into a filter in front of a plain explode
    return checked(raw, conversions, *rules).select("request_id", F.explode_outer("issues").alias("x")).where("x IS NOT NULL").select("request_id", "x.*")


def verdicts(checked_: DataFrame) -> DataFrame:
    """READY or NEEDS_INPUT per checked document, with the number of issues and the blocking ones as text."""
    stops = F.filter("issues", lambda x: x.blocking)
    text = F.array_join(F.array_sort(F.array_distinct(F.transform(stops, lambda x: F.concat(x.issue, F.lit(" "), x.field)))), "; ")
    return checked_.select("request_id", F.when(F.size(stops) > 0, "NEEDS_INPUT").otherwise("READY").alias("status"), F.size("issues").cast("long").alias("issues"), text.alias("questions"))


# Checked fields whose content the calculator takes as it is, and sections it builds without asking for a field.
TAKEN_AS_GIVEN = ("streaming_mode", "latency_requirement", "serving_mode", "model")
BUILT_WITHOUT = ("storage", "transfer")


def refused(x: Column) -> Column:
    """True for issues that the calculator itself refuses: no JSON, wrong types and names, negative numbers, unknown workload types and
    scenarios, duplicates, bad assumptions and overrides, and missing constructor fields. The other rules ask for what only the input check wants."""
    field, issue = x.field, x.issue
    area = field.startswith("_areas")
    fraction = (x.expected == EXPECTED["whole"]) & x.received.try_cast("double").isNotNull()
    built = F.lit(False)
    for s, fs in REQUIRED.items():
        if s not in BUILT_WITHOUT:
            built = built | ((x.section == s) & field.isin(*fs))
    return (F.when(issue == "NOT_JSON", True).when(issue == "UNKNOWN_FIELD", ~area).when(issue == "WRONG_TYPE", ~area & ~F.coalesce(fraction, F.lit(False)))
            .when(issue == "INVALID_VALUE", (~area | (x.section == "overrides")) & ~field.isin(*TAKEN_AS_GIVEN) & (x.expected != "1 or more")).when(issue == "MISSING", built).otherwise(False))


def judged(checked_: DataFrame, named: Column) -> DataFrame:
    """Checked documents with named, status, issues (their number), texts and errors (the texts joined).

    `named` false: a new document, every blocking issue counts and leads to NEEDS_INPUT. True: a loaded use case, whose completeness was
    settled when it was loaded, so only what the calculator refuses counts. Null: no check was asked for; what the calculator refuses is
    REJECTED. Without such an issue the request is READY.
    """
    def text(x: Column) -> Column:
        return F.concat(x.issue, F.lit(" "), x.field, F.coalesce(F.concat(F.lit(" ("), x.component_id, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(", received "), x.received), F.lit("")))
    adhoc = F.col("named").eqNullSafe(F.lit(False))
    d = checked_.withColumn("named", named)
    d = d.withColumn("counted", F.when(adhoc, F.col("issues")).otherwise(F.filter("issues", lambda x: refused(x))))
    stops = F.filter("counted", lambda x: x.blocking | ~adhoc)
    d = d.withColumns({"texts": F.array_sort(F.array_distinct(F.transform(stops, text))), "issues": F.size("counted").cast("long")})
    status = F.when(F.size("texts") == 0, "READY").when(F.col("named").isNull(), "REJECTED").otherwise("NEEDS_INPUT")
    return d.withColumns({"status": status, "errors": F.array_join("texts", "; ")}).drop("counted")


def unknown_use_cases(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Questions by name that no single loaded use case answers."""
    return questions.join(resolved.select("question_id"), "question_id", "left_anti").select("question_id", F.lit("UNKNOWN_USE_CASE").alias("status"))


INTAKE_COLUMNS = ("area", "field", "type", "requirement", "default_value", "question")


def intake_rows(area: str | None = None) -> list[tuple]:
    """Every input a request takes, out of the section schema and its defaults."""
    rows = []
    for a, fs in SECTIONS.items():
        defaults = {**FIELD_DEFAULTS[a], **ABSENT_DEFAULTS.get(a, {})}
        for f, t in fs:
            if f in INTAKE_SKIP or (area and a != area):
                continue
            default = defaults.get(f)
            need = "REQUIRED" if f in INTAKE_REQUIRED[a] else ("DEFAULT" if default is not None else "OPTIONAL")
            if a == "processing" and f in ("runs_per_month", "runtime_hours_expected"):
                need = "REQUIRED for batch types"
            text = None if default is None else str(default).lower() if isinstance(default, bool) else str(default)
            rows.append((a, f, _KIND[t], need, text, f"What is the {f.replace('_', ' ')}?"))
    return rows


def intake_catalog(spark: SparkSession, area: str | None = None) -> DataFrame:
    """The intake catalogue as a table, for all areas or one."""
    return spark.createDataFrame(intake_rows(area), ", ".join(f"{c} string" for c in INTAKE_COLUMNS))
