"""Cluster sizing for described workloads: volume, frequency and window to node type, workers, runtimes and price.

The node choice needs no row per candidate and no window: the allowed nodes of a cloud, category and region are one small
array (bounded by the instance table), joined to the request, and the best node is the minimum of that array.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.functions.columns import clean_token, fmt_number, normalise_key, round_half_up
from fleetcost.operators import lookups as lk
from fleetcost.operators import merges as mg
from fleetcost.operators.joins import alias_map
from fleetcost.refdata import RefData

# The worker limit without a policy, and the source that names it.
DEFAULT_LIMIT = 100
DEFAULT_SOURCE = "default guardrail"


def normalise(requests: DataFrame) -> DataFrame:
    """Clean the request: placeholder texts to NULL, key form of the workload name, defaults; no row without a positive volume."""
    d = requests.withColumns({
        "name": normalise_key(clean_token("workload")), "runs": F.greatest(F.coalesce("runs_per_day", F.lit(1)), F.lit(1)),
        "cl": F.coalesce(F.upper(F.trim(clean_token("cloud"))), F.lit("AWS")), "node": F.trim(clean_token("node_type")),
        "rg": F.lower(F.trim(clean_token("region")))})
    return d.where("data_gb > 0")


def with_profile(requests: DataFrame, ref: RefData) -> DataFrame:
    """Attach profile (by key or alias) and policy: sizing volume, window, usable hours, worker limit and its source."""
    d = normalise(requests).join(alias_map(ref.profiles), "name")
    pol = ref.policy.select(F.col("cloud").alias("cl"), F.col("max_workers").alias("pol_max"), F.col("source").alias("pol_source"))
    d = d.join(pol, "cl", "left")
    window = F.greatest(F.coalesce("window_minutes", "default_window_minutes"), F.col("startup_minutes") + 1)
    d = d.withColumns({
        "sgb": F.when(F.col("volume_basis") == "PEAK_HOUR", F.col("data_gb") / 24.0 * F.col("peak_factor")).otherwise(F.col("data_gb") / F.col("runs")),
        "win": F.when(F.col("always_on"), 60).otherwise(window),
        "pmax": F.greatest(F.coalesce("max_workers", "pol_max", F.lit(DEFAULT_LIMIT)), F.lit(1)),
        "pmax_source": F.when(F.col("max_workers").isNotNull(), "set in the request").otherwise(F.coalesce("pol_source", F.lit(DEFAULT_SOURCE)))})
    return d.withColumns({"eff_h": F.greatest(F.col("win") - F.col("startup_minutes"), F.lit(1)) / 60.0, "req_mem": F.col("sgb") * F.col("working_set_factor")})


def _node_struct() -> Column:
    return F.struct("instance_type", "vcpus", "memory_gb", "dbu_rate")


def allowed_nodes(ref: RefData) -> DataFrame:
    """(cloud, category, region) to the array of nodes its family and policy allow; region '*' is any region."""
    def build():
        n = ref.instance_rates.where("is_active").select(F.upper("cloud").alias("cl"), "instance_type", "vcpus", "memory_gb", "dbu_rate")
        f = ref.node_families.select(F.col("cloud").alias("cl"), "node_category", "instance_pattern", "min_vcpus")
        n = n.join(f, "cl").where("instance_type RLIKE instance_pattern AND vcpus >= min_vcpus")
        p = ref.policy.select(F.col("cloud").alias("cl"), "allowed_node_pattern")
        n = n.join(p, "cl", "left").where("allowed_node_pattern IS NULL OR instance_type RLIKE allowed_node_pattern")
        v = (ref.vm_costs.where(F.lower("pricing_tier") == "on_demand")
             .select(F.upper("cloud").alias("cl"), F.lower("region").alias("region_key"), "instance_type").distinct())
        cols = ["cl", "node_category", "region_key", "instance_type", "vcpus", "memory_gb", "dbu_rate"]
        both = n.withColumn("region_key", F.lit("*")).select(*cols).unionByName(n.join(v, ["cl", "instance_type"]).select(*cols))
        return both.groupBy("cl", "node_category", "region_key").agg(F.collect_set(_node_struct()).alias("family_nodes"))
    return ref.keep("allowed_nodes", build)


def named_nodes(ref: RefData) -> DataFrame:
    """(cloud, lower-cased node name) to the active nodes of that name."""
    def build():
        n = ref.instance_rates.where("is_active")
        return n.groupBy(F.upper("cloud").alias("cl"), F.lower("instance_type").alias("node_key")).agg(F.collect_set(_node_struct()).alias("given_nodes"))
    return ref.keep("named_nodes", build)


def with_candidates(requests: DataFrame, ref: RefData) -> DataFrame:
    """Array `nodes` of the candidate nodes with the workers each needs; requests without a candidate are dropped."""
    d = with_profile(requests, ref).withColumns({
        "region_key": F.when(F.col("node").isNull(), F.coalesce("rg", F.lit("*"))), "node_key": F.lower("node")})
    d = d.join(allowed_nodes(ref), ["cl", "node_category", "region_key"], "left").join(named_nodes(ref), ["cl", "node_key"], "left")
    d = d.withColumn("nodes", F.when(F.col("node").isNotNull(), F.col("given_nodes")).otherwise(F.col("family_nodes"))).where("nodes IS NOT NULL")
    cores = F.col("sgb") / (F.col("gb_per_core_hour_expected") * F.col("eff_h"))

    def size(n: Column) -> Column:
        cpu = F.ceil(F.col("req_cores") / n["vcpus"]).cast("int")
        mem = F.ceil(F.col("req_mem") / n["memory_gb"]).cast("int")
        need = F.greatest(F.col("min_workers"), cpu, mem)
        fits = need <= F.col("pmax")
        rank = F.when(need <= F.least("preferred_max_workers", "pmax"), 0).when(fits, 1).otherwise(2)
        # order: fit class, smallest fitting (or largest capped) node, rate, name
        return F.struct(rank.alias("rank"), F.when(fits, n["vcpus"]).otherwise(-n["vcpus"]).alias("size"), n["dbu_rate"].alias("dbu_rate"),
                        n["instance_type"].alias("instance_type"), n["vcpus"].alias("vcpus"), n["memory_gb"].alias("memory_gb"),
                        cpu.alias("n_cpu"), mem.alias("n_mem"), need.alias("need"))
    d = d.withColumn("req_cores", cores)
    return d.withColumn("nodes", F.transform("nodes", size)).drop("family_nodes", "given_nodes", "region_key", "node_key")


def candidates(requests: DataFrame, ref: RefData) -> DataFrame:
    """One row per request and candidate node."""
    return with_candidates(requests, ref).withColumn("c", F.explode("nodes")).drop("nodes").select("*", "c.*").drop("c")


def best_node(requests: DataFrame, ref: RefData) -> DataFrame:
    """The chosen node of every request: `need` workers wanted, `wk` within the limit."""
    d = with_candidates(requests, ref).withColumn("best", F.array_min("nodes")).drop("nodes").select("*", "best.*").drop("best")
    return d.withColumn("wk", F.least("need", "pmax"))


def _minutes(rate: str, workers: Column, startup: bool) -> Column:
    run = F.greatest(F.col("min_runtime_minutes").cast("double"), F.lit(60.0) * F.col("sgb") / (F.col(rate) * workers * F.col("vcpus")))
    run = F.col("startup_minutes") + run if startup else run
    return F.when(F.col("always_on"), 1440).otherwise(F.ceil(run).cast("int"))


def runtimes(requests: DataFrame, ref: RefData) -> DataFrame:
    """Runtimes and worker ranges. LOW uses the high throughput, HIGH the low one."""
    d = best_node(requests, ref)
    low, expected, high = ("gb_per_core_hour_high", "gb_per_core_hour_expected", "gb_per_core_hour_low")

    def stream(rate: str, other: str) -> Column:
        return F.when(F.col("always_on"), F.greatest("min_workers", F.ceil(F.col("sgb") / F.col(rate) / F.col("vcpus")).cast("int"), "n_mem")).otherwise(F.col(other))
    d = d.withColumns({f"rt_{n}": _minutes(r, F.col("wk"), True) for n, r in (("l", low), ("e", expected), ("h", high))})
    d = d.withColumns({"sw_l": stream(low, "need"), "sw_h": stream(high, "need")})
    d = d.withColumns({n: F.when(F.col("always_on"), F.least("pmax", s)).otherwise(F.col("wk")) for n, s in (("wk_l", "sw_l"), ("wk_h", "sw_h"))})
    return d.withColumns({"srt_l": _minutes(low, F.col("sw_l"), False), "srt_e": _minutes(expected, F.col("need"), False), "srt_h": _minutes(high, F.col("sw_h"), False)})


def limiting_factor() -> Column:
    floor = (F.col("need") == F.col("min_workers")) & (F.col("n_cpu") < F.col("min_workers")) & (F.col("n_mem") < F.col("min_workers"))
    return (F.when(F.col("need") > F.col("pmax"), "POLICY_CAP").when(floor, "MIN_WORKERS").when(F.col("n_mem") > F.col("n_cpu"), "MEMORY").otherwise("CORES"))


def status() -> Column:
    over = F.col("need") > F.col("pmax")
    return (F.when(over & F.col("always_on"), "EXCEEDS_POLICY").when(over, "EXCEEDS_WINDOW")
            .when(~F.col("always_on") & (F.col("rt_e") > F.col("win")), "EXCEEDS_WINDOW").otherwise("FITS_WINDOW"))


def _int(c: str) -> Column:
    return F.col(c).cast("string")


def options_text() -> Column:
    """What can be done when the recommendation does not fit; NULL when it fits."""
    over = F.col("need") > F.col("pmax")
    batch = F.concat(F.lit("Finishing in "), _int("win"), F.lit(" min takes "), _int("need"), F.lit(" workers of "), F.col("instance_type"),
                     F.lit("; the limit is "), _int("pmax"), F.lit(" ("), F.col("pmax_source"), F.lit("). (1) accept about "), _int("rt_e"),
                     F.lit(" min per run on "), _int("wk"), F.lit(" workers; (2) run "), F.ceil(F.col("need") / F.col("pmax")).cast("int").cast("string"),
                     F.lit(" jobs in parallel; (3) use serverless jobs"), F.when(F.col("serverless_ok"), "").otherwise(" (not suited to this workload)"),
                     F.lit("; (4) raise the limit."))
    stream = F.concat(F.lit("Keeping up takes "), _int("need"), F.lit(" workers; the limit is "), _int("pmax"), F.lit(" ("), F.col("pmax_source"),
                      F.lit("): split the stream or raise the limit."))
    late = F.concat(F.lit("The shortest run of "), _int("rt_e"), F.lit(" min, with "), _int("startup_minutes"), F.lit(" min to start, is longer than the window of "),
                    _int("win"), F.lit(" min."))
    return F.when(over & ~F.col("always_on"), batch).when(over, stream).when(~F.col("always_on") & (F.col("rt_e") > F.col("win")), late)


def basis_text() -> Column:
    """How the recommendation came about, in one text."""
    def triple() -> Column:
        return F.concat(fmt_number("gb_per_core_hour_low"), F.lit(" / "), fmt_number("gb_per_core_hour_expected"), F.lit(" / "), fmt_number("gb_per_core_hour_high"))
    return F.concat(
        F.lit("Planning estimate, to be checked by a test run: "), fmt_number("sgb", 2),
        F.when(F.col("volume_basis") == "PEAK_HOUR", F.concat(F.lit(" GB in the peak hour (factor "), fmt_number("peak_factor"), F.lit(")"))).otherwise(" GB per run"),
        F.when(F.col("always_on"), F.lit(", always on")).otherwise(F.concat(F.lit(", within "), _int("win"), F.lit(" min"))),
        F.lit("; throughput "), triple(), F.lit(" GB per core-hour; "),
        F.when(F.col("working_set_factor") > 0, F.concat(F.lit("memory factor "), fmt_number("working_set_factor"))).otherwise("memory does not bind"),
        F.when(F.col("always_on"), F.lit("")).otherwise(F.concat(F.lit("; start "), _int("startup_minutes"), F.lit(" min, run at least "), _int("min_runtime_minutes"), F.lit(" min"))),
        F.lit("; limit "), _int("pmax"), F.lit(" ("), F.col("pmax_source"), F.lit("); "),
        F.when(F.col("node").isNotNull(), F.concat(F.lit("node "), F.col("instance_type"), F.lit(" as given"))).otherwise(F.concat(F.lit("smallest fitting "), F.lower("node_category"), F.lit(" node"))),
        F.lit("; values "), F.when(F.col("calibration_status") == "CALIBRATED", F.concat(F.lit("calibrated from "), _int("calibration_runs"), F.lit(" runs."))).otherwise("assumed."))


def throughput_basis(calibrated_at: Column) -> Column:
    """What the throughput rests on; with the day of the calibration where the profile knows it."""
    day = F.coalesce(F.concat(F.lit(" ("), F.substring(calibrated_at.cast("string"), 1, 10), F.lit(")")), F.lit(""))
    return F.when(F.col("calibration_status") == "CALIBRATED", F.concat(F.lit("CALIBRATED from "), _int("calibration_runs"), F.lit(" job runs"), day)).otherwise(
        "ASSUMED planning values")


def recommend(requests: DataFrame, ref: RefData, carry: tuple[str, ...] = ()) -> DataFrame:
    """The full recommendation: 47 columns per request, plus request_id and the carried columns."""
    d = runtimes(requests, ref)
    c = F.col
    return d.select(
        "request_id", *carry, c("profile").alias("workload_profile"), "description", c("data_gb").alias("data_gb_per_day"), c("runs").alias("runs_per_day"),
        round_half_up("sgb", 3).alias("sizing_gb"), F.when(~c("always_on"), c("win")).alias("window_minutes"), c("instance_type").alias("node_type"),
        c("instance_type").alias("driver_node_type"), c("wk").alias("num_workers"), F.least("min_workers", "wk").alias("autoscale_min_workers"),
        F.least("pmax", F.greatest("wk", "wk_h")).alias("autoscale_max_workers"), c("vcpus").alias("vcpus_per_node"), c("memory_gb").alias("memory_gb_per_node"),
        (c("wk") * c("vcpus")).alias("total_worker_vcpus"), (c("wk") * c("memory_gb")).alias("total_worker_memory_gb"),
        round_half_up(c("dbu_rate") * (c("wk") + 1), 4).alias("dbu_per_hour"), round_half_up("req_cores", 2).alias("required_cores"),
        round_half_up("req_mem", 2).alias("required_memory_gb"), c("need").alias("workers_needed"), c("pmax").alias("max_workers_allowed"),
        c("pmax_source").alias("max_workers_source"), limiting_factor().alias("limiting_factor"), status().alias("status"),
        c("rt_l").alias("runtime_minutes_low"), c("rt_e").alias("runtime_minutes_expected"), c("rt_h").alias("runtime_minutes_high"),
        c("wk_l").alias("workers_low"), c("wk_h").alias("workers_high"), F.ceil(c("need") / c("pmax")).cast("int").alias("parallel_jobs_needed"),
        c("sw_l").alias("serverless_workers_low"), c("need").alias("serverless_workers_expected"), c("sw_h").alias("serverless_workers_high"),
        c("srt_l").alias("serverless_runtime_minutes_low"), c("srt_e").alias("serverless_runtime_minutes_expected"), c("srt_h").alias("serverless_runtime_minutes_high"),
        "startup_minutes", "always_on", c("photon_default").alias("photon_recommended"), "serverless_ok",
        F.greatest(c("wk") * c("vcpus") * 2, F.lit(200.0)).cast("int").alias("shuffle_partitions"),
        "gb_per_core_hour_low", "gb_per_core_hour_expected", "gb_per_core_hour_high", throughput_basis(c("calibrated_at") if "calibrated_at" in d.columns else F.lit(None)).alias("throughput_basis"),
        options_text().alias("options"), basis_text().alias("assumptions"), "tips")


def priced(requests: DataFrame, ref: RefData) -> DataFrame:
    """Two compute options in three scenarios per request, priced in one pass (serverless only where suited).

    Here the region (default us-east-1) and tier (default ENTERPRISE) are always set; tier, photon and days_per_month are columns.
    """
    d = requests.withColumns({
        "cloud": F.coalesce(F.upper(F.trim(clean_token("cloud"))), F.lit("AWS")), "region": F.coalesce(F.lower(F.trim(clean_token("region"))), F.lit("us-east-1")),
        "tier": F.coalesce(F.upper(F.trim(clean_token("tier"))), F.lit("ENTERPRISE")), "days": F.coalesce("days_per_month", F.lit(30))})
    s = recommend(d, ref, ("cloud", "region", "tier", "days", "photon"))

    def row(option: str, scenario: str, workers: str, minutes: str) -> Column:
        return F.struct(F.lit(option).alias("compute_option"), F.lit(scenario).alias("scenario"), F.col(workers).alias("num_workers"), F.col(minutes).alias("runtime_minutes"))
    classic = F.array(row("JOBS_CLASSIC", "LOW", "workers_low", "runtime_minutes_low"), row("JOBS_CLASSIC", "EXPECTED", "num_workers", "runtime_minutes_expected"),
                      row("JOBS_CLASSIC", "HIGH", "workers_high", "runtime_minutes_high"))
    other = F.array(*[row("JOBS_SERVERLESS", n.upper(), f"serverless_workers_{n}", f"serverless_runtime_minutes_{n}") for n in ("low", "expected", "high")])
    s = s.withColumn("k", F.explode(F.when(F.col("serverless_ok"), F.concat(classic, other)).otherwise(classic)))
    s = s.select("request_id", "workload_profile", "cloud", "region", "tier", F.col("node_type").alias("node"), "days", "status", "window_minutes", "always_on",
                 F.when(F.col("always_on"), 1).otherwise(F.col("runs_per_day")).alias("runs_per_day"), F.coalesce("photon", "photon_recommended").alias("photon"),
                 "throughput_basis", "options", "assumptions", "k.*")
    srv = F.col("compute_option") == "JOBS_SERVERLESS"
    s = s.withColumn("photon", srv | F.col("photon"))
    none = F.lit(None)
    s = lk.classic_dbu(s, ref, "cloud", "node", "node", "num_workers", "photon", F.lit("JOBS"), none.cast("string"), "dbu_per_hour")
    s = s.withColumns({"hours_per_month": lk.hours_per_month(F.lit("JOBS"), "runs_per_day", "runtime_minutes", "days", none.cast("double")),
                       "product": lk.product_type(F.lit("JOBS"), srv, "photon", none.cast("string"), none.cast("string"))})
    s = lk.governed_price(s, ref.price_card, "cloud", "region", "tier", "product", "dbu_price")
    s = lk.price_status_text(s, ref.price_card, "cloud", "region", "tier", "product", "price_basis")
    s = lk.vm_cost(s, ref, "cloud", "region", "node", F.lit("on_demand"), F.lit("NA"), "_vm")
    month = F.col("dbu_per_hour") * F.col("hours_per_month")
    vm = F.when(srv, 0.0).otherwise((F.col("_vm") + F.col("_vm") * F.col("num_workers")) * F.col("hours_per_month"))
    fits = F.when(F.col("runtime_minutes") <= F.col("window_minutes"), "FITS_WINDOW").otherwise("EXCEEDS_WINDOW")
    return s.select(
        "request_id", "compute_option", "scenario", "workload_profile",
        F.when(srv, F.concat(F.lit("serverless (sized as "), _int("num_workers"), F.lit(" x "), "node", F.lit(")"))).otherwise(F.col("node")).alias("node_type"),
        "num_workers", F.col("photon").alias("photon_enabled"), F.col("runtime_minutes").alias("runtime_minutes_per_run"), "runs_per_day",
        F.col("days").alias("days_per_month"), "hours_per_month", "dbu_per_hour", month.alias("dbu_per_month"), "dbu_price",
        round_half_up(month * F.col("dbu_price"), 2).alias("dbu_cost_per_month"), round_half_up(vm, 2).alias("vm_cost_per_month"),
        round_half_up(month * F.col("dbu_price") + vm, 2).alias("total_cost_per_month"),
        F.when(F.col("always_on"), F.when(srv, "FITS_WINDOW").otherwise(F.col("status"))).otherwise(fits).alias("status"), "window_minutes", "throughput_basis",
        F.when(~srv, F.col("options")).alias("options"),
        F.concat(F.lit("DBU price: "), "price_basis", F.when(srv, "").otherwise("; VM: on-demand list price")).alias("price_basis"),
        F.concat("assumptions", F.when(srv, " Serverless: no worker limit, no start time.").otherwise("")).alias("sizing_basis"))


_POLICY = "map<string, struct<type: string, value: string, maxValue: int, values: array<string>>>"


def update_policy(policy: DataFrame, documents: DataFrame) -> DataFrame:
    """The policy table with what cluster policy documents say (cloud, policy_id, policy_name, definition): of each cloud the document with the largest id counts. A limit that the
    document does not set stays, or is the default for a new cloud; the allowed nodes are those of the document, none named allows all."""
    d = parse_policy(documents).groupBy("cloud").agg(F.max_by(F.struct("max_workers", "allowed_node_pattern", "policy_name", F.col("policy_id").cast("string").alias("policy_id")), "policy_id").alias("p")).select("cloud", "p.*")
    own = {c: F.col(f"s_{c}") for c in ("allowed_node_pattern", "policy_name", "policy_id")} | {"source": F.concat(F.lit("cluster policy "), F.col("s_policy_name"))}
    return mg.conditional_upsert(policy, d, "cloud", F.lit(True), own | {"max_workers": F.coalesce("s_max_workers", "max_workers")}, own | {"max_workers": F.coalesce("s_max_workers", F.lit(DEFAULT_LIMIT))})


def parse_policy(documents: DataFrame, definition: str = "definition") -> DataFrame:
    """Worker limit (smallest numeric limit) and allowed-node pattern of cluster policy documents."""
    d = documents.withColumn("_d", F.from_json(definition, _POLICY))
    limits = F.filter(F.array(*[F.coalesce(F.col("_d")[k]["maxValue"], F.col("_d")[k]["value"].cast("int")) for k in ("num_workers", "autoscale.max_workers")]),
                      lambda x: x.isNotNull())
    node = F.col("_d")["node_type_id"]
    names = F.coalesce(node["values"], F.when(node["value"].isNotNull(), F.array(node["value"])))
    escaped = F.transform(names, lambda x: F.regexp_replace(x, r"([.^$*+?()\[\]{}|\\-])", r"\\$1"))
    pattern = F.when(node["type"].isin("allowlist", "fixed") & (F.size(names) > 0), F.concat(F.lit("^("), F.array_join(escaped, "|"), F.lit(")$")))
    return d.withColumns({"max_workers": F.array_min(limits), "allowed_node_pattern": pattern}).drop("_d")


