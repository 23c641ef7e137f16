"""Job entry points for spark-submit.

    spark-submit ledgerlane/cli.py place --requests s3://…/requests/ \\
        --inventory s3://…/inventory/ --out s3://…/placement/
    spark-submit ledgerlane/cli.py metrics --events s3://…/events/ --out s3://…/metrics/
    spark-submit ledgerlane/cli.py dashboard --kafka host:9092 --out s3://…/dashboard/

``place`` decides nested order requests (JSON lines) against an inventory
(parquet): confirmed order and line tables, one published record per decision
and topic, and the quarantined requests. ``metrics`` computes the batch
metrics over order-event JSON files. ``dashboard`` starts the streaming job.
The session comes from spark-submit; its ``spark.checkpoint.dir`` is used. The package sends
itself to the executors.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

if not __package__:  # run as a script: the package's parent folder is not on the path yet
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _stored(df, path: str):
    """Write once, read back: what follows doesn't compute it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, args) -> None:
    from ledgerlane.operators import placement
    from ledgerlane.operators.sinks import published_events, store_confirmed
    from ledgerlane.sources.requests import read_inventory, read_order_requests

    requests = _stored(read_order_requests(spark, args.requests, fmt="json"), f"{args.out}/requests")
    lines = _stored(placement.explode_request_lines(requests), f"{args.out}/lines")
    headers = requests.select("order_key", F.lit(None).cast("string").alias("order_number"),
                              "order_email")
    inventory = read_inventory(spark, args.inventory)
    bad = _stored(placement.raising_requests(requests, lines, inventory), f"{args.out}/quarantine")
    decisions = placement.placement_decisions(headers, lines, inventory, exclude=bad)
    decided = _stored(decisions, f"{args.out}/decisions")
    # by default a batch is known by its requests: the same ones again add nothing
    batch = args.batch if args.batch is not None else requests.agg(
        F.coalesce(F.bit_xor(F.xxhash64("order_key", "order_email")), F.lit(0)).bitwiseAND(F.lit((1 << 62) - 1))).first()[0]
    store_confirmed(decided, lines, args.out, batch)
    published_events(decided).write.mode("overwrite").parquet(f"{args.out}/published")


def metrics_job(spark: SparkSession, args) -> None:
    from ledgerlane.functions.codec import decode_order_events, unrepresentable_events
    from ledgerlane.operators import metrics
    from ledgerlane.sources.events import file_records

    raw = file_records(spark.read.text(args.events))
    keep = ("event_id", "arrival")
    events = _stored(decode_order_events(raw, keep=keep), f"{args.out}/events")
    (metrics.event_problems(events).select("event_id", "arrival", "order_number", "value_text", "reason")
     .unionByName(unrepresentable_events(raw, keep=keep).select(
         "event_id", "arrival", "order_number", "value_text", "reason"))
     .write.mode("overwrite").parquet(f"{args.out}/quarantine"))
    ok = metrics.valid_events(events)
    metrics.status_counts(ok).write.mode("overwrite").parquet(f"{args.out}/status_counts")
    metrics.revenue_total(ok).write.mode("overwrite").parquet(f"{args.out}/revenue_total")
    metrics.revenue_tumbling(ok).write.mode("overwrite").parquet(f"{args.out}/revenue_30s")
    metrics.revenue_running(ok).write.mode("overwrite").parquet(f"{args.out}/revenue_running")
    metrics.status_running_counts(ok).write.mode("overwrite").parquet(f"{args.out}/status_running")


def dashboard(spark: SparkSession, args) -> None:
    from ledgerlane.sources.events import read_event_stream
    from ledgerlane.streaming.dashboard import await_all, start_dashboard

    def source():
        if args.kafka:
            return read_event_stream(spark, kafka_servers=args.kafka)
        return read_event_stream(spark, path=args.events, fmt="json")

    trigger = {"availableNow": True} if args.available_now else {"processingTime": args.trigger}
    # One-shot runs window on arrival time: wall-clock timers never finish.
    window_mode = "arrival" if args.available_now else args.window_mode
    queries = start_dashboard(spark, source, args.out, trigger=trigger,
                              window_mode=window_mode, kafka_servers=args.kafka,
                              console=args.console)
    if args.available_now:
        await_all(queries)
        return
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for q in queries.values():
            q.stop()


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="ledgerlane")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("place")
    a.add_argument("--requests", required=True)
    a.add_argument("--inventory", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--batch", type=int, help="the batch's id; by default it follows from the requests")
    b = sub.add_parser("metrics")
    b.add_argument("--events", required=True)
    b.add_argument("--out", required=True)
    c = sub.add_parser("dashboard")
    c.add_argument("--kafka")
    c.add_argument("--events")
    c.add_argument("--out", required=True)
    c.add_argument("--trigger", default="5 seconds")
    c.add_argument("--window-mode", dest="window_mode", default="processing",
                   choices=["processing", "arrival"])
    c.add_argument("--available-now", dest="available_now", action="store_true",
                   help="process the input present at start, then stop")
    c.add_argument("--console", action="store_true",
                   help="also print processing text, total and window revenue")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"ledgerlane-{args.cmd}").getOrCreate()
    {"place": place, "metrics": metrics_job, "dashboard": dashboard}[args.cmd](spark, args)


if __name__ == "__main__":
    main()
