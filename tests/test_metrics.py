"""Properties of the metrics on the driver's events."""

from pyspark.sql import functions as F

from conftest import SF_TINY
from ledgerlane.operators import metrics
from ledgerlane.sources import fixtures as fx
from ledgerlane.sources.synthetic import synthetic_order_events


def test_last_running_value_is_total(spark):
    ev = fx.order_events(spark, SF_TINY)
    total = metrics.revenue_total(ev).first().total_revenue
    run = metrics.revenue_running(ev)
    last = run.orderBy(F.col("arrival").desc(), F.col("event_id").desc()).first()
    assert last.running_revenue == total


def test_windows_sum_to_total(spark):
    ev = fx.order_events(spark, SF_TINY)
    total = metrics.revenue_total(ev).first().total_revenue
    w = metrics.revenue_tumbling(ev).agg(F.sum("window_revenue").alias("s"),
                                         F.sum("event_count").alias("n")).first()
    assert w.s == total and w.n == ev.count()


def test_status_counts_sum_to_rows(spark):
    ev = fx.order_events(spark, SF_TINY)
    counts = {r.order_status: r.event_count for r in metrics.status_counts(ev).collect()}
    assert sum(counts.values()) == ev.count()
    maxima = {r.order_status: r.m for r in metrics.status_running_counts(ev)
              .groupBy("order_status").agg(F.max("running_count").alias("m")).collect()}
    assert maxima == counts


def test_failed_events_carry_zero(spark):
    ev = fx.order_events(spark, SF_TINY)
    assert ev.filter((F.col("order_status") == "FAILED") & (F.col("total_order_value") != 0)
                     ).count() == 0


def test_synthetic_generator_shape(spark):
    ev = synthetic_order_events(spark.range(4000))
    stats = {r.order_status: r.n for r in ev.groupBy("order_status")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 800 < stats["FAILED"] < 1200          # price 0 drawn with p = 1/4
    assert ev.filter((F.col("total_order_value") > 0) != (F.col("order_status") == "CONFIRMED")
                     ).count() == 0
    assert ev.select("order_email").distinct().count() == 4
    random_mode = synthetic_order_events(spark.range(10), random_ids=True)
    assert random_mode.select("order_number").distinct().count() == 10


def test_event_quarantine_split(spark):
    from decimal import Decimal
    ev = spark.createDataFrame(
        [("1", "CONFIRMED", Decimal("1")), (None, "FAILED", Decimal("0")),
         ("3", None, Decimal("1")), ("4", "CONFIRMED", None)],
        "order_number string, order_status string, total_order_value decimal(18,2)")
    reasons = sorted(r.reason for r in metrics.event_problems(ev).collect())
    assert reasons == ["null order number", "null status", "null value"]
    assert [r.order_number for r in metrics.valid_events(ev).collect()] == ["1"]
