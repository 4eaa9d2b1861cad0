"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fleetcost.catalog import REGISTRY

HEADLINES = ("est_jobs_classic", "est_warehouse", "est_compare_options", "price_card", "rate_quote", "siz_recommend", "siz_priced", "dcp_line_items",
             "dcp_totals", "chk_verdict", "out_totals", "cal_evidence", "cal_summary", "cal_billing_peers", "jn_interval_overlap", "jn_effective_price",
             "ag_quartiles_exact", "wn_time_split", "wn_peak_concurrency", "rec_figures")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())      # no call-site capture per Column
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()      # start the executor threads
    seconds: dict[str, float] = {}
    for key in HEADLINES:
        if key in REGISTRY:
            start = time.perf_counter()
            REGISTRY[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
