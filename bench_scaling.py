"""Scaling run of the synthetic source through the metrics.

    SCALING_N=1000000,4000000,16000000 BENCH_CPUS=8 python bench_scaling.py

For each N, ``spark.range(N)`` feeds the synthetic generator (S4); arrival is
one event per 7 ms. Status counts, both changelogs and the 30 s windows are
evaluated in full through the ``noop`` sink. Prints one JSON line with
seconds and events per second per metric. The fixture tables are single
parquet row groups, so this is the run that shows the multi-partition plans.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ledgerlane.operators import metrics  # noqa: E402
from ledgerlane.session import build_session  # noqa: E402
from ledgerlane.sources.synthetic import synthetic_order_events  # noqa: E402

START_MS = 1_704_067_200_000
STEP_MS = 7


def events(spark, n: int, parts: int):
    ids = spark.range(0, n, numPartitions=parts)
    ev = synthetic_order_events(ids, "id")
    return ev.select(F.col("id").alias("event_id"), "order_number", "order_email",
                     "order_status", "total_order_value",
                     F.timestamp_millis(F.lit(START_MS) + F.col("id") * STEP_MS).alias("arrival"))


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sizes = [int(x) for x in os.environ.get("SCALING_N", "1000000,4000000").split(",")]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app="ledgerlane-scaling",
                          extra={"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="ledgerlane-bench-")})
    runs = {
        "status_counts": metrics.status_counts,
        "status_running_counts": metrics.status_running_counts,
        "revenue_running": metrics.revenue_running,
        "revenue_tumbling_30s": metrics.revenue_tumbling,
    }
    # JVM, code generation and Python workers start before timing.
    for fn in runs.values():
        fn(events(spark, 1000, cpus)).write.format("noop").mode("overwrite").save()
    result = {}
    for n in sizes:
        row = {}
        for name, fn in runs.items():
            t0 = time.perf_counter()
            fn(events(spark, n, cpus)).write.format("noop").mode("overwrite").save()
            sec = time.perf_counter() - t0
            row[name] = {"sec": round(sec, 3), "events_per_sec": int(n / sec)}
        result[str(n)] = row
    print(json.dumps({"metric": "synthetic_scaling", "cpus": cpus, "runs": result}))
    spark.stop()


if __name__ == "__main__":
    main()
