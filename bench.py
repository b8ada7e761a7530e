"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs once to warm
up and then ``BENCH_RUNS`` times; the median counts. A query's time covers building it, any
intermediate tables it stores, and producing every result row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clickloom import catalog  # noqa: E402
from clickloom.session import build_session  # noqa: E402

HEADLINE = [
    "distinct_sessions_by_type",
    "distinct_sessions_all_days",
    "session_features",
    "activity_outlier_filter",
    "click_intervals",
    "session_interval_stats",
    "percentile_unpivot",
    "running_session_score",
    "batch_session_lifecycle",
    "bot_rate_5min",
    "failure_reason",
    "validation_metrics",
    "out_of_order_flag",
    "roc_curve",
    "roc_auc",
    "dash_bot_rate_ma12",
]
ONCE = ["score_sessions_stream", "validation_stream"]


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "clickloom-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed = {}
    for name in HEADLINE:
        seconds(spark, sf_dir, name)
        timed[name] = round(statistics.median(seconds(spark, sf_dir, name) for _ in range(runs)), 4)
    for name in ONCE:
        timed[name] = round(seconds(spark, sf_dir, name), 4)
    result = {
        "metric": "sum of median query times",
        "value": round(sum(timed.values()), 4),
        "unit": "sec",
        "queries": timed,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
