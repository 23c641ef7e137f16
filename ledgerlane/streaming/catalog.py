"""Streaming entries of the query catalogue. Each runs a Structured Streaming
query over the events table as a file stream (``availableNow``), lets it
finish, and returns its sink's contents as a batch DataFrame; the check is
the SQL of the batch twin."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions.codec import decode_order_events
from ledgerlane.functions.text import notification_line, processing_line
from ledgerlane.operators.commits import read_committed
from ledgerlane.plans.catalog import TS_FORMAT, portable, timed_projection
from ledgerlane.session import read_table, rocksdb_state, shared_path
from ledgerlane.sources import fixtures as fx
from ledgerlane.sources.events import render_event_json
from ledgerlane.sources.requests import parse_order_requests, render_order_requests
from ledgerlane.streaming import closing, jobs
from ledgerlane.streaming.dashboard import await_all, read_dashboard, start_dashboard
from ledgerlane.streaming.placement import placement_sink
from ledgerlane.streaming.processors import WINDOW_OUT, apply_processing_time_windows


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    return shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-ckpt")


def s_order_events(spark: SparkSession, sf: str) -> DataFrame:
    out, ckpt = _paths(spark, "stream-order-events")
    ev = jobs.fixture_event_stream(spark, sf).drop("arrival")
    jobs.run_available(ev.writeStream.format("parquet").option("path", out)
                       .option("checkpointLocation", ckpt))
    return portable(spark.read.parquet(out))


def s_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    out, ckpt = _paths(spark, "stream-status-counts")
    jobs.run_available(jobs.status_counts_sink(jobs.fixture_event_stream(spark, sf), out, ckpt))
    return jobs.read_partials(spark, out, ["order_status"], ["event_count"])


def s_revenue_running(spark: SparkSession, sf: str) -> DataFrame:
    out, ckpt = _paths(spark, "stream-revenue-running")
    jobs.run_available(jobs.running_revenue_sink(jobs.fixture_event_stream(spark, sf), out, ckpt))
    return portable(spark.read.parquet(out).select("order_number", "event_id", "running_revenue"))


def s_status_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    out, ckpt = _paths(spark, "stream-status-running")
    jobs.run_available(jobs.status_running_sink(jobs.fixture_event_stream(spark, sf), out, ckpt))
    return spark.read.parquet(out).select("order_number", "order_status", "event_id",
                                          "running_count")


def s_revenue_tumbling_30s(spark: SparkSession, sf: str) -> DataFrame:
    out, ckpt = _paths(spark, "stream-revenue-30s")
    jobs.run_available(jobs.window_revenue_sink(jobs.fixture_event_stream(spark, sf), out, ckpt))
    return portable(jobs.read_partials(spark, out, jobs.WINDOW_KEYS, jobs.WINDOW_SUMS))


def s_timed_order_events(spark: SparkSession, sf: str) -> DataFrame:
    out, ckpt = _paths(spark, "stream-timed")
    stamped = timed_projection(jobs.fixture_event_stream(spark, sf))
    jobs.run_available(stamped.writeStream.format("parquet").option("path", out)
                       .option("checkpointLocation", ckpt))
    return spark.read.parquet(out)


def _text_lines(spark: SparkSession, sf: str, name: str, line) -> DataFrame:
    out, ckpt = _paths(spark, name)
    lines = jobs.fixture_event_stream(spark, sf).select("event_id", line.alias("line"))
    jobs.run_available(lines.writeStream.format("parquet").option("path", out)
                       .option("checkpointLocation", ckpt))
    return spark.read.parquet(out)


def s_processing_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _text_lines(spark, sf, "stream-processing", processing_line())


def s_notification_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _text_lines(spark, sf, "stream-notification", notification_line())


def _processed_to(spark: SparkSession, sf: str, name: str) -> str:
    out, ckpt = _paths(spark, name)
    lines = jobs.processed_lines(jobs.fixture_event_stream(spark, sf))
    jobs.run_available(jobs.text_file_sink(lines, out, ckpt))
    return out


def s_processed_messages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.text(_processed_to(spark, sf, "stream-processed"))


def s_processed_readback(spark: SparkSession, sf: str) -> DataFrame:
    topic = _processed_to(spark, sf, "stream-processed-topic")
    out, ckpt = _paths(spark, "stream-readback")
    jobs.run_available(jobs.text_file_sink(jobs.readback_stream(spark, topic), out, ckpt))
    return spark.read.text(out)


def s_decode_order_events(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + D1: the event stream in its JSON wire form, decoded on the stream."""
    out, ckpt = _paths(spark, "stream-decode")
    decoded = decode_order_events(render_event_json(jobs.fixture_event_stream(spark, sf)), keep=("event_id",))
    jobs.run_available(decoded.writeStream.format("parquet").option("path", out)
                       .option("checkpointLocation", ckpt))
    return portable(spark.read.parquet(out))


def s_order_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the main job on one read of the stream; per branch its rows and a sum of 32-bit text hashes."""
    out = shared_path(spark, "dashboard")
    await_all(start_dashboard(spark, lambda: jobs.fixture_event_stream(spark, sf), out,
                              trigger={"availableNow": True}))
    cents = lambda c: F.col(c).cast("decimal(38,2)").cast("string")
    texts = {"quarantine": F.col("order_number"), "processing": F.col("value"), "processed": F.col("value"),
             "status_running": F.concat_ws("|", "order_number", "order_status", F.col("running_count").cast("string")),
             "revenue_running": F.concat_ws("|", F.col("order_number"), cents("running_revenue")),
             "revenue_30s": F.concat_ws("|", F.date_format("window_start", TS_FORMAT), cents("window_revenue"),
                                        F.col("event_count").cast("string"))}
    rows = None
    for name, df in read_dashboard(spark, out).items():
        head = F.conv(F.substring(F.md5(texts[name].cast("binary")), 1, 8), 16, 10).cast("long")
        part = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(head), F.lit(0)).alias("checksum"))
        part = part.select(F.lit(name).alias("branch"), "row_count", "checksum")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _in_turn(spark: SparkSession, rows: DataFrame, parts: int, schema, run: Callable[[DataFrame, int], None]) -> None:
    """Feed a stream with ``rows`` (column ``part``) in as many files as parts; a query on the same checkpoint
    is started again for each: ``run(stream, part)``."""
    src = shared_path(spark, "stream-in")
    for part in range(parts):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(src)
        run(spark.readStream.schema(schema).parquet(src), part)


def _placed(spark: SparkSession, sf: str, part, parts: int, inventory: Callable[[SparkSession, int], DataFrame]) -> DataFrame:
    """All requests in their wire form, streamed in parts with a restart after each, and decided."""
    out, ckpt = _paths(spark, "stream-placement")
    wire = render_order_requests(fx.placed_requests(spark, sf)).withColumn("part", part)

    def run(stream: DataFrame, k: int) -> None:
        requests = parse_order_requests(stream, key=F.col("order_key"))
        jobs.run_available(placement_sink(requests, lambda s: inventory(s, k), out, ckpt))

    _in_turn(spark, wire, parts, wire.drop("part").schema, run)
    return portable(read_committed(spark, out, "decisions"))


def s_placement_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + J1 + E4 + K4: placement of nested requests on a stream."""
    return _placed(spark, sf, F.pmod(F.xxhash64("order_key"), F.lit(3)), 3, lambda s, _: fx.inventory(s, sf))


def s_placement_restocked(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + J1: the stock changes while requests stream; each is decided on the stock of its time."""
    return _placed(spark, sf, F.col("order_key") % 2, 2,
                   lambda s, k: fx.restocked(s, sf) if k else fx.inventory(s, sf))


def _event_parts(spark: SparkSession, sf: str, parts: int) -> DataFrame:
    """The events table in parts by id, which follows arrival, but for every fiftieth event: one part late."""
    events = read_table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * parts / (last + 1)) + (F.col("event_id") % 50 == 0).cast("int")
    return events.withColumn("part", F.least(part, F.lit(parts - 1)).cast("int"))


def s_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A3: windows emitted once when they close, corrected when events come later than that."""
    out, ckpt = _paths(spark, "stream-closed-windows")
    rows = _event_parts(spark, sf, 4)
    _in_turn(spark, rows, 4, rows.drop("part").schema, lambda stream, _: jobs.run_available(
        closing.closed_windows_sink(jobs.as_order_events(stream), out, ckpt)))
    return portable(closing.window_totals(spark, out))


def s_status_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A1 in update mode, started again between files."""
    out, ckpt = _paths(spark, "stream-status-updates")
    rows = _event_parts(spark, sf, 3)
    _in_turn(spark, rows, 3, rows.drop("part").schema, lambda stream, _: jobs.run_available(
        jobs.status_updates_sink(jobs.as_order_events(stream), out, ckpt)))
    return jobs.read_upserts(spark, out, ["order_status"])


#: How long the live query may go without giving out another event before it counts as stuck.
LIVE_PATIENCE_S = 180


def s_live_window_revenue(spark: SparkSession, sf: str) -> DataFrame:
    """The wall-clock windows run live, two seconds long, until they have given out every event;
    their sums and counts add up to the total. A query that gives out nothing more for
    ``LIVE_PATIENCE_S`` seconds is an error."""
    out, ckpt = _paths(spark, "stream-live-windows")
    expected = read_table(spark, sf, "events").count()
    windows = apply_processing_time_windows(jobs.fixture_event_stream(spark, sf), window_ms=2000)
    with rocksdb_state(spark):
        q = (windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .trigger(processingTime="500 milliseconds").start())
    try:
        seen, since = 0, time.monotonic()
        while seen < expected:
            if q.awaitTermination(1):
                raise q.exception() or RuntimeError("the live query ended early")
            was = seen
            if q.lastProgress and q.lastProgress["batchId"] > 0:
                seen = spark.read.schema(WINDOW_OUT).parquet(out).agg(F.sum("event_count")).first()[0] or 0
            if seen != was:
                since = time.monotonic()
            elif time.monotonic() - since > LIVE_PATIENCE_S:
                raise TimeoutError(f"the live query gave out {seen} of {expected} events")
    finally:
        q.stop()
    return portable(spark.read.parquet(out).agg(F.sum("window_revenue").alias("total_revenue"),
                                                F.sum("event_count").alias("event_count")))


STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_order_events": s_order_events,
    "stream_status_counts": s_status_counts,
    "stream_status_running_counts": s_status_running_counts,
    "stream_revenue_running": s_revenue_running,
    "stream_revenue_tumbling_30s": s_revenue_tumbling_30s,
    "stream_timed_order_events": s_timed_order_events,
    "stream_processing_lines": s_processing_lines,
    "stream_notification_lines": s_notification_lines,
    "stream_processed_messages": s_processed_messages,
    "stream_processed_readback": s_processed_readback,
    "stream_decode_order_events": s_decode_order_events,
    "order_dashboard": s_order_dashboard,
    "live_window_revenue": s_live_window_revenue,
    "stream_placement_decisions": s_placement_decisions,
    "stream_placement_restocked": s_placement_restocked,
    "stream_closed_windows": s_closed_windows,
    "stream_status_updates": s_status_updates,
}

# Stream query → oracle SQL key (in plans.oracle.ORACLE_SQL) of its batch twin.
STREAM_ORACLE_TWINS = {
    "stream_order_events": "order_events",
    "stream_status_counts": "status_counts",
    "stream_status_running_counts": "status_running_counts",
    "stream_revenue_running": "revenue_running",
    "stream_revenue_tumbling_30s": "revenue_tumbling_30s",
    "stream_timed_order_events": "timed_order_events",
    "stream_processing_lines": "processing_lines",
    "stream_notification_lines": "notification_lines",
    "stream_processed_messages": "processed_values",
    "stream_processed_readback": "processed_values",
    "stream_decode_order_events": "decode_order_events",
    "order_dashboard": "order_dashboard",
    "live_window_revenue": "revenue_total",
    "stream_placement_decisions": "placement_decisions",
    "stream_placement_restocked": "placement_restocked",
    "stream_closed_windows": "revenue_tumbling_30s",
    "stream_status_updates": "status_counts",
}
