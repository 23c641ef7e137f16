"""Stream = batch: multi-batch input, restart from the
checkpoint, the stateful processors and the dashboard job."""

import os
import time

from pyspark.sql import functions as F

from conftest import SF_TINY
from ledgerlane.operators import metrics
from ledgerlane.sources import fixtures as fx
from ledgerlane.streaming import jobs
from ledgerlane.streaming.dashboard import await_all, start_dashboard
from ledgerlane.streaming.processors import apply_processing_time_windows


def _event_parts(spark, parts=4):
    """The events cut into ``parts`` id ranges; ids follow arrival order in the
    fixture, so writing the parts in turn keeps arrival order across files."""
    ev = spark.read.parquet(f"{SF_TINY}/events.parquet")
    bounds = ev.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.0)
    edges = [None] + bounds + [None]
    out = []
    for i in range(parts):
        part = ev
        if edges[i] is not None:
            part = part.filter(F.col("event_id") > edges[i])
        if edges[i + 1] is not None:
            part = part.filter(F.col("event_id") <= edges[i + 1])
        out.append(part)
    return out


def _write_parts(parts, folder, indexes):
    for i in indexes:
        parts[i].toPandas().to_parquet(os.path.join(folder, f"events-{i}.parquet"),
                                       coerce_timestamps="us", allow_truncated_timestamps=True)
        time.sleep(1.1)


def _batch_running(spark):
    r = metrics.revenue_running(fx.order_events(spark, SF_TINY))
    return {row.order_number: row.running_revenue for row in r.collect()}


def test_multi_batch_stream_with_restart_equals_batch(spark, scratch):
    src = os.path.join(scratch, "src")
    os.makedirs(src)
    parts = _event_parts(spark)
    out, ckpt = os.path.join(scratch, "rev"), os.path.join(scratch, "ckpt")
    s_out, s_ckpt = os.path.join(scratch, "st"), os.path.join(scratch, "st_ckpt")
    w_out, w_ckpt = os.path.join(scratch, "w"), os.path.join(scratch, "w_ckpt")
    c_out, c_ckpt = os.path.join(scratch, "c"), os.path.join(scratch, "c_ckpt")
    stream = lambda: jobs.fixture_event_stream(spark, src, max_files_per_trigger=1,
                                               glob="events-*.parquet")

    def run_all():
        jobs.run_available(jobs.running_revenue_sink(stream(), out, ckpt))
        jobs.run_available(jobs.status_running_sink(stream(), c_out, c_ckpt))
        jobs.run_available(jobs.status_counts_sink(stream(), s_out, s_ckpt))
        jobs.run_available(jobs.window_revenue_sink(stream(), w_out, w_ckpt))

    # the first run sees two files; the restart from the checkpoints picks up the rest
    _write_parts(parts, src, [0, 1])
    run_all()
    _write_parts(parts, src, [2, 3])
    run_all()

    batches = spark.read.parquet(out).select("batch_id").distinct().count()
    assert batches == 4
    got = {r.order_number: r.running_revenue for r in spark.read.parquet(out).collect()}
    assert got == _batch_running(spark)

    ev = fx.order_events(spark, SF_TINY)
    want_run = {(r.order_number, r.order_status, r.running_count)
                for r in metrics.status_running_counts(ev).collect()}
    got_run = {(r.order_number, r.order_status, r.running_count)
               for r in spark.read.parquet(c_out).collect()}
    assert got_run == want_run

    want_status = {r.order_status: r.event_count for r in metrics.status_counts(ev).collect()}
    got_status = {r.order_status: r.event_count
                  for r in jobs.read_partials(spark, s_out, ["order_status"], ["event_count"]).collect()}
    assert got_status == want_status

    fmt = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("s")
    want_w = {(r.s, r.window_revenue)
              for r in metrics.revenue_tumbling(ev).select(fmt, "window_revenue").collect()}
    got_w = {(r.s, r.window_revenue)
             for r in jobs.read_partials(spark, w_out, jobs.WINDOW_KEYS, jobs.WINDOW_SUMS)
             .select(fmt, "window_revenue").collect()}
    assert got_w == want_w


def test_windows_lose_nothing_when_arrivals_go_back(spark, scratch):
    """One file per micro-batch, each earlier than the one before by more than any watermark."""
    from decimal import Decimal
    src, out, ckpt = (os.path.join(scratch, n) for n in ("late", "late_out", "late_ckpt"))
    os.makedirs(src)
    schema = spark.read.parquet(f"{SF_TINY}/events.parquet").schema
    for k, (ts, value) in enumerate([("2024-01-01 12:00:05", 1.5), ("2024-01-01 11:00:05", 2.25),
                                     ("2023-12-31 12:00:05", 4.0)]):
        row = spark.read.parquet(f"{SF_TINY}/events.parquet").limit(1).withColumns({
            "event_id": F.lit(k).cast(schema["event_id"].dataType), "ts": F.lit(ts).cast(schema["ts"].dataType),
            "event_type": F.lit("view"), "value": F.lit(value).cast(schema["value"].dataType)})
        row.toPandas().to_parquet(os.path.join(src, f"events-{k}.parquet"), coerce_timestamps="us",
                                  allow_truncated_timestamps=True)
        time.sleep(1.1)
    stream = jobs.fixture_event_stream(spark, src, max_files_per_trigger=1, glob="events-*.parquet")
    jobs.run_available(jobs.window_revenue_sink(stream, out, ckpt), timeout_s=120)
    got = jobs.read_partials(spark, out, jobs.WINDOW_KEYS, jobs.WINDOW_SUMS).collect()
    assert sorted(r.window_revenue for r in got) == [Decimal("1.5"), Decimal("2.25"), Decimal("4")]


def test_processing_time_windows_fire_on_idle_source(spark, scratch):
    out, ckpt = os.path.join(scratch, "t1"), os.path.join(scratch, "t1_ckpt")
    windows = apply_processing_time_windows(jobs.fixture_event_stream(spark, SF_TINY))
    q = (windows.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(processingTime="2 seconds").start())
    total = metrics.revenue_total(fx.order_events(spark, SF_TINY)).first().total_revenue
    deadline, got = time.time() + 100, None
    try:
        while time.time() < deadline:
            time.sleep(3)
            try:
                got = spark.read.parquet(out).agg(F.sum("window_revenue")).first()[0]
            except Exception:
                got = None
            if got is not None and got == total:
                break
    finally:
        q.stop()
    assert got == total
    rows = spark.read.parquet(out).collect()
    assert all(r.window_end_ms - r.window_start_ms == 30_000 for r in rows)
    assert all(r.window_start_ms % 30_000 == 0 for r in rows)


def test_dashboard_branches(spark, scratch):
    out = os.path.join(scratch, "dash")
    qs = start_dashboard(spark, lambda: jobs.fixture_event_stream(spark, SF_TINY), out,
                         trigger={"availableNow": True}, console=True)
    assert set(qs) == {"branches"}                     # one query, one read of the source
    await_all(qs, timeout_s=300)
    ev = fx.order_events(spark, SF_TINY)
    n = ev.count()
    assert spark.read.parquet(f"{out}/processing").count() == n
    assert spark.read.parquet(f"{out}/processed").count() == n
    assert spark.read.parquet(f"{out}/quarantine").count() == 0
    assert spark.read.parquet(f"{out}/revenue_running").count() == n
    status = {r.order_status: r.m for r in spark.read.parquet(f"{out}/status_running")
              .groupBy("order_status").agg(F.max("running_count").alias("m")).collect()}
    assert status == {r.order_status: r.event_count
                      for r in metrics.status_counts(ev).collect()}
    assert jobs.read_partials(spark, f"{out}/revenue_30s", jobs.WINDOW_KEYS, jobs.WINDOW_SUMS).count() == \
        metrics.revenue_tumbling(ev).count()


def test_json_lines_stream_source_decodes_strictly(spark, scratch):
    """S1 file form: JSON lines decoded like topic values (bad records dropped)."""
    from ledgerlane.functions.codec import decode_order_events
    from ledgerlane.sources.events import read_event_stream, render_event_json
    src = os.path.join(scratch, "json")
    raw = render_event_json(fx.order_events(spark, SF_TINY))
    raw.select("value").write.text(src)
    out, ckpt = os.path.join(scratch, "json_out"), os.path.join(scratch, "json_ckpt")
    stream = read_event_stream(spark, path=src, fmt="json")
    jobs.run_available(stream.writeStream.format("parquet").option("path", out)
                       .option("checkpointLocation", ckpt))
    got = spark.read.parquet(out)
    assert got.count() == decode_order_events(raw).count() > 0
    assert set(got.columns) >= {"order_number", "order_status", "total_order_value", "value_text"}


def test_live_arrival_stamp_uses_clock(spark):
    from ledgerlane.functions.text import stamp_arrival
    ts, instant = stamp_arrival()
    r = spark.range(1).select(ts, instant, F.unix_millis(F.current_timestamp()).alias("now")).first()
    assert abs(r.now - r.timestamp) < 60_000
    shift = spark.createDataFrame([(r.instant,)], "i timestamp_ntz").select(
        F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', i)").alias("ms")
    ).first().ms - r.timestamp
    assert shift == (5 * 60 + 30) * 60 * 1000


def test_console_sink_with_prefix(spark, scratch):
    from ledgerlane.functions.text import console_line
    ev = fx.order_events(spark, SF_TINY).limit(3)
    lines = [r.v for r in ev.select(console_line("Total Revenue =", F.col("order_number")).alias("v")).collect()]
    assert all(v.startswith("Total Revenue => ") for v in lines)
    stream = jobs.processing_lines(jobs.fixture_event_stream(spark, SF_TINY))
    q = (jobs.console_sink(stream, prefix="\n")
         .option("checkpointLocation", os.path.join(scratch, "console_ckpt")))
    done = jobs.run_available(q)   # prints from the JVM's stdout
    assert sum(p["numInputRows"] for p in done.recentProgress) == \
        fx.order_events(spark, SF_TINY).count()


def test_shared_folder_is_never_machine_local(spark):
    """Without a named folder the session's warehouse is used, not a temporary one."""
    import inspect

    from ledgerlane import session

    class Bare:
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})()
        conf = type("F", (), {"get": staticmethod(
            lambda k, d=None: {"spark.sql.warehouse.dir": "hdfs://n/w"}.get(k, d))})()

    class Nothing(Bare):
        conf = type("F", (), {"get": staticmethod(lambda k, d=None: d)})()

    assert session.shared_path(Bare(), "x").startswith("hdfs://n/w/_ledgerlane/x-")
    try:
        session.shared_path(Nothing(), "x")
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("no error without a shared folder")
    assert "tempfile" not in inspect.getsource(session.shared_root)


def test_synthetic_stream_feeds_changelog(spark, scratch):
    from ledgerlane.sources.synthetic import synthetic_event_stream
    out, ckpt = os.path.join(scratch, "syn"), os.path.join(scratch, "syn_ckpt")
    q = (jobs.running_revenue_sink(synthetic_event_stream(spark, rows_per_batch=500), out, ckpt)
         .trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and len(q.recentProgress) < 4:
            time.sleep(1)
    finally:
        q.stop()
    got = spark.read.parquet(out)
    n = got.count()
    assert n >= 1000 and n % 500 == 0
    # the changelog is monotone in (arrival, event_id) and ends at the total
    rows = sorted(got.collect(), key=lambda r: (r.arrival, r.event_id))
    assert all(a.running_revenue <= b.running_revenue for a, b in zip(rows, rows[1:]))


def test_text_feeds_print_value_as_received(spark, scratch):
    from ledgerlane.sources.events import read_event_stream
    src = os.path.join(scratch, "j")
    spark.createDataFrame([('{"orderNumber":"n1","orderEmail":"e","orderStatus":"CONFIRMED",'
                            '"totalOrderValue":41000}',)], "value string").write.text(src)
    out, ckpt = os.path.join(scratch, "t"), os.path.join(scratch, "t_ckpt")
    lines = jobs.notification_lines(read_event_stream(spark, path=src, fmt="json"))
    jobs.run_available(jobs.text_file_sink(lines, out, ckpt))
    assert [r.value for r in spark.read.text(out).collect()] == [
        "Received Notification for Order - OrderEvent(orderNumber=n1, orderEmail=e, "
        "orderStatus=CONFIRMED, totalOrderValue=41000)"]


def test_dashboard_rejects_processing_windows_with_available_now(spark, scratch):
    import pytest
    with pytest.raises(ValueError, match="processingTime trigger"):
        start_dashboard(spark, lambda: jobs.fixture_event_stream(spark, SF_TINY),
                        os.path.join(scratch, "d"), trigger={"availableNow": True},
                        window_mode="processing")
    assert not spark.streams.active


def test_dashboard_live_processing_windows(spark, scratch):
    out = os.path.join(scratch, "live")
    qs = start_dashboard(spark, lambda: jobs.fixture_event_stream(spark, SF_TINY), out,
                         trigger={"processingTime": "2 seconds"}, window_mode="processing")
    total = metrics.revenue_total(fx.order_events(spark, SF_TINY)).first().total_revenue
    got, deadline = None, time.time() + 100
    try:
        while time.time() < deadline and got != total:
            time.sleep(3)
            try:
                got = spark.read.parquet(f"{out}/revenue_30s").agg(F.sum("window_revenue")).first()[0]
            except Exception:
                got = None
    finally:
        for q in qs.values():
            q.stop()
    assert got == total
