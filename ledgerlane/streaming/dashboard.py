"""T4: the main stream job — one order-event source feeding all branches.

Branches: processing text (E8), running count per status (A1), running total
revenue (A2), revenue per 30 s window (A3), processed messages to the output
topic (E9 + K1). Events the source system's job would crash on (null number,
status or value) go to a quarantine branch instead of the metrics (R6).

One streaming query reads and decodes the source once; each micro-batch is kept while
every branch writes its own folder under the batch's id, so a replayed batch replaces what it
wrote. Windows follow the arrival column; ``window_mode="processing"`` adds the wall-clock
processor (live behaviour of the source system) as a second query, because its timers need
a stateful operator of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlane.functions.text import console_line
from ledgerlane.operators.metrics import event_problems, revenue_tumbling, valid_events
from ledgerlane.session import rocksdb_state, shared_path
from ledgerlane.streaming import jobs
from ledgerlane.streaming.processors import WINDOW_MS, apply_processing_time_windows

# The console prefixes of the source system's job.
PROCESSING_PREFIX = "\n"
REVENUE_PREFIX = "Total Revenue ="
WINDOW_PREFIX = "Total Revenue in the last 30 seconds ="


def write_branches(batch: DataFrame, batch_id: int, out_dir: str, kafka_servers: str | None = None,
                   console: bool = False, windows: bool = True) -> None:
    """All branches of one micro-batch, from one pass over the source."""
    batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        clean = valid_events(batch)
        jobs.write_batch(event_problems(batch), f"{out_dir}/quarantine", batch_id)
        jobs.write_batch(jobs.processing_lines(batch), f"{out_dir}/processing", batch_id)
        jobs.write_running_totals(clean, batch_id, f"{out_dir}/status_running", **jobs.STATUS_CHANGELOG)
        jobs.write_running_totals(clean, batch_id, f"{out_dir}/revenue_running", **jobs.REVENUE_CHANGELOG)
        if windows:
            jobs.write_batch(revenue_tumbling(clean), f"{out_dir}/revenue_30s", batch_id)
        processed = jobs.processed_lines(batch)
        if kafka_servers:
            from ledgerlane.sources.events import OUTPUT_TOPIC
            (processed.select(F.col("value").cast("string")).write.format("kafka")
             .option("kafka.bootstrap.servers", kafka_servers).option("topic", OUTPUT_TOPIC).save())
        else:
            jobs.write_batch(processed, f"{out_dir}/processed", batch_id)
        if console:
            print_lines(batch, clean)
    finally:
        batch.unpersist()


def print_lines(batch: DataFrame, clean: DataFrame) -> None:
    """K2: the branches' console lines of one micro-batch."""
    text = lambda c: F.col(c).cast("string")
    for prefix, rows in (
            (PROCESSING_PREFIX, jobs.processing_lines(batch)),
            (REVENUE_PREFIX, clean.agg(F.sum("total_order_value").alias("v")).select(text("v").alias("value"))),
            (WINDOW_PREFIX, revenue_tumbling(clean).select(text("window_revenue").alias("value")))):
        lines = rows.select(console_line(prefix, F.col("value")).alias("value"))
        lines.write.format("console").mode("append").option("truncate", "false").save()


def start_dashboard(spark: SparkSession, events: Callable[[], DataFrame], out_dir: str | None = None,
                    trigger: dict | None = None, window_mode: str = "arrival",
                    kafka_servers: str | None = None, console: bool = False,
                    window_ms: int = WINDOW_MS) -> dict[str, StreamingQuery]:
    """Start the job; ``events()`` builds the source: once, or once more for the wall-clock
    windows. ``console=True`` also prints the source job's console lines (K2)."""
    out_dir = out_dir or shared_path(spark, "dashboard")
    trigger = trigger or {"processingTime": "5 seconds"}
    if window_mode == "processing" and trigger.get("availableNow"):
        # Wall-clock timers keep such a query alive: it would never finish.
        raise ValueError("processing-time windows need a processingTime trigger; "
                         "use window_mode='arrival' for availableNow runs")
    live = window_mode == "processing"
    writers = {"branches": (
        events().writeStream.outputMode("append").option("checkpointLocation", f"{out_dir}/_checkpoints/branches")
        .foreachBatch(lambda batch, batch_id: write_branches(
            batch, batch_id, out_dir, kafka_servers, console, windows=not live)))}
    if live:
        writers["revenue_30s"] = (
            apply_processing_time_windows(valid_events(events()), window_ms).writeStream.format("parquet")
            .option("path", f"{out_dir}/revenue_30s")
            .option("checkpointLocation", f"{out_dir}/_checkpoints/revenue_30s"))
    with rocksdb_state(spark):
        return {name: w.queryName(f"dashboard_{name}").trigger(**trigger).start()
                for name, w in writers.items()}


def read_dashboard(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The branches' outputs of a run on arrival windows."""
    names = ("quarantine", "processing", "status_running", "revenue_running", "processed")
    out = {n: spark.read.parquet(f"{out_dir}/{n}").drop(jobs.BATCH_COL) for n in names}
    out["revenue_30s"] = jobs.read_partials(spark, f"{out_dir}/revenue_30s", jobs.WINDOW_KEYS, jobs.WINDOW_SUMS)
    return out


def await_all(queries: dict[str, StreamingQuery], timeout_s: float | None = None) -> None:
    """Wait for ``availableNow`` branches to finish; stop everything on error."""
    try:
        for q in queries.values():
            done = q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
            if timeout_s is not None and not done:
                raise TimeoutError(f"{q.name} still running after {timeout_s}s")
            if q.exception():
                raise q.exception()
    finally:
        for q in queries.values():
            if q.isActive:
                q.stop()
