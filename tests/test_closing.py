"""Windows that are emitted once when they close, and counts in update mode."""

import os
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlane.operators.metrics import revenue_tumbling
from ledgerlane.streaming import closing, jobs

START = datetime(2024, 1, 1)


def _events(spark, *rows):
    """(second, value) as events."""
    return spark.createDataFrame([(i, str(i), "CONFIRMED", Decimal(v), START + timedelta(seconds=s)) for i, (s, v) in enumerate(rows)],
                                 "event_id long, order_number string, order_status string, "
                                 "total_order_value decimal(38,6), arrival timestamp")


def _emissions(spark, out):
    rows = closing.read_emissions(spark, out).withColumn("at", F.unix_timestamp("window_start") - F.unix_timestamp(F.lit(START)))
    return sorted((r.batch_id, r["at"], r.emission, int(r.window_revenue), r.event_count) for r in rows.collect())


def test_each_window_is_emitted_once_and_corrected_when_late(spark, scratch):
    out = os.path.join(scratch, "w")
    batches = [[(1, 1), (29, 2), (31, 4)],     # the clock is at 31: the first window closes
               [(40, 8), (59, 16)],            # nothing closes
               [(95, 32), (2, 64), (61, 128)], # the second and third close; the first gets a late event
               [(3, 256), (500, 1), (150, 2)], # another late one; 90 s closes, 150 s opens and closes
               [(200, 5), (65, 6)]]            # a window first seen after its end; one more correction
    for k, rows in enumerate(batches):
        closing.close_windows(_events(spark, *rows), k, out)
    expected = [(0, 0, "closed", 3, 2), (2, 0, "correction", 67, 3), (2, 30, "closed", 28, 3), (2, 60, "closed", 128, 1),
                (3, 0, "correction", 323, 4), (3, 90, "closed", 32, 1), (3, 150, "closed", 2, 1),
                (4, 60, "correction", 134, 2), (4, 180, "closed", 5, 1)]
    assert _emissions(spark, out) == expected
    assert [(r.event_count, int(r.window_revenue)) for r in closing.open_windows(spark, out).collect()] == [(1, 1)]
    every = revenue_tumbling(_events(spark, *sum(batches, [])))
    columns = ["window_start", "window_revenue", "event_count"]
    assert sorted(map(tuple, closing.window_totals(spark, out).select(*columns).collect())) == sorted(
        map(tuple, every.select(*columns).collect()))

    closing.close_windows(_events(spark, *batches[4]), 4, out)   # played again
    assert _emissions(spark, out) == expected


def test_empty_batches_change_nothing(spark, scratch):
    out = os.path.join(scratch, "w")
    closing.close_windows(_events(spark, (1, 1)).limit(0), 0, out)
    closing.close_windows(_events(spark, (1, 1), (31, 2)), 1, out)
    closing.close_windows(_events(spark, (1, 1)).limit(0), 2, out)
    closing.close_windows(_events(spark, (70, 1)), 3, out)
    assert _emissions(spark, out) == [(1, 0, "closed", 1, 1), (3, 30, "closed", 2, 1)]


def test_update_mode_state_survives_a_restart(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, x) for x in ("src", "out", "ckpt"))
    events = _events(spark, *[(i, i) for i in range(60)]).withColumn(
        "order_status", F.when(F.col("event_id") % 3 == 0, "FAILED").otherwise("CONFIRMED"))
    for part in range(3):
        rows = events.filter(F.floor(F.col("event_id") / 20) == part)
        if part == 2:
            rows = rows.filter("order_status = 'FAILED'")
        rows.write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        jobs.run_available(jobs.status_updates_sink(stream, out, ckpt))
    assert dict(map(tuple, jobs.read_upserts(spark, out, ["order_status"]).collect())) == {"FAILED": 20, "CONFIRMED": 26}
    # the last trigger gave out what changed, nothing else
    last = spark.read.parquet(out).filter("batch_id = 2").collect()
    assert [(r.order_status, r.event_count) for r in last] == [("FAILED", 20)]
