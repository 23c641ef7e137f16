"""Batch metrics over order events (A1–A3).

Finals use plain aggregates (partial aggregation before the shuffle, so a hot
status or window costs one row per map task). Changelogs — one output row per
event, as the streaming source system emits — use the distributed prefix sum
in ``operators.prefix`` in the total order (arrival, event_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators.prefix import running_totals

ARRIVAL_ORDER = ["arrival", "event_id"]
WINDOW_LENGTH = "30 seconds"  # fixed value: the source system's tumbling window


def status_counts(events: DataFrame) -> DataFrame:
    """A1 final: events per status."""
    return events.groupBy("order_status").agg(F.count(F.lit(1)).alias("event_count"))


def status_running_counts(events: DataFrame, order_by: list[str] = ARRIVAL_ORDER) -> DataFrame:
    """A1 changelog: for every event, (status, count of its status so far)."""
    narrow = events.select("order_number", "order_status", *order_by)
    return running_totals(narrow, order_by=order_by, keys=["order_status"],
                          count_as="running_count")


def revenue_total(events: DataFrame) -> DataFrame:
    """A2 final: total revenue over all events (FAILED events carry 0)."""
    return events.agg(F.sum("total_order_value").alias("total_revenue"),
                      F.count(F.lit(1)).alias("event_count"))


def revenue_running(events: DataFrame, order_by: list[str] = ARRIVAL_ORDER) -> DataFrame:
    """A2 changelog: for every event, the total revenue so far (the first event
    emits its own value)."""
    narrow = events.select("order_number", "total_order_value", *order_by)
    return running_totals(narrow, order_by=order_by, keys=[],
                          sums={"running_revenue": "total_order_value"}, count_as=None)


def revenue_tumbling(events: DataFrame, time_col: str = "arrival",
                     length: str = WINDOW_LENGTH) -> DataFrame:
    """A3: revenue per tumbling window aligned to the epoch, only windows with
    data. The source system emits the bare sum; the bounds are kept here."""
    return (events.groupBy(F.window(time_col, length).alias("w"))
                  .agg(F.sum("total_order_value").alias("window_revenue"),
                       F.count(F.lit(1)).alias("event_count"))
                  .select(F.col("w.start").alias("window_start"),
                          F.col("w.end").alias("window_end"),
                          "window_revenue", "event_count"))


def event_problems(events: DataFrame) -> DataFrame:
    """Events the source system's job cannot process (a null order number
    or status breaks its key selectors, a null value its running sum), with a
    reason; ``valid_events`` is the complement."""
    reason = (F.when(F.col("order_number").isNull(), F.lit("null order number"))
               .when(F.col("order_status").isNull(), F.lit("null status"))
               .when(F.col("total_order_value").isNull(), F.lit("null value")))
    return events.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("order_number").isNotNull() & F.col("order_status").isNotNull()
                         & F.col("total_order_value").isNotNull())
