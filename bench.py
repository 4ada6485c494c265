"""Times the headline queries and prints one JSON line: median of three runs after a warm-up, in seconds."""

from __future__ import annotations

import json
import os
import statistics
import time

import pyspark

from tallyflow.plans.queries import REGISTERED
from tallyflow.session import session

HEADLINE = (
    "daily_facts", "daily_band_facts", "flow_windows", "monthly_flows", "hourly_gapfill", "repeat_entities",
    "top_recipients", "top_sources", "category_totals", "top_earners", "fine_table", "earn_loop",
    "asof_rates", "exact_rates", "market_deviation", "daily_close", "implied_day_rates", "quote_validation",
    "event_gaps", "cadence", "cadence_flags", "reconciliation", "backward_balance", "trend_state", "burn_runway",
    "consumption", "funding_split", "archive_rollup", "sweep_summary", "contract_audit", "lagged_share",
    "event_days", "active_users", "settled_tier", "ratio_weeks", "asof_stats", "runway_alerts",
    "short_collisions", "ingest_dedupe", "normalised_transfers", "asset_treasury", "settled_days_stream",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    memory = os.environ.get("BENCH_MEMORY", "8g")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": memory, "spark.ui.enabled": "false",
           "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH", os.path.abspath("spark-warehouse"))},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "spark": pyspark.__version__, "cpus": int(cpus), "driver_memory": memory, "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
