"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from aerostrata import build_session
from aerostrata.plans.registry import all_queries

HEADLINE = [
    "scan_with_metrics", "assign_microbatches", "closed_batches_only", "sensor_status",
    "batch_features", "batch_features_system", "rolling_features", "chrono_index",
    "health_labels", "inject_anomalies", "scaled_features", "classification_metrics", "cv_summary",
    "mcnemar_pairs", "data_gaps", "cumulative_energy", "stream_microbatches",
    "score_logreg", "score_tree", "score_forest", "score_iforest", "score_lof", "score_ocsvm",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
         "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = all_queries(), {}
    # One untimed run, so that JVM start-up is not booked on the first query.
    queries["batch_features"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
