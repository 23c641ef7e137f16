"""A3 as the source system emits it: one row per window, once, when the window closes.

Time is that of the events: a window is closed by the first micro-batch after which some event is as late as the
window's end. Each micro-batch adds its partial sums to the open windows (a table kept under the batch's id),
emits those that closed, and keeps the rest. There is no watermark: events that come after their
window closed are not dropped, but emitted as a correction with the window's new total, or as its first row
where the window had no event before. A batch played again reads the state of the batch before it and
replaces its own rows.

Only windows meet here, 30 s each by default: one row per window whatever the number of events.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.operators.commits import exists
from ledgerlane.operators.metrics import WINDOW_LENGTH, revenue_tumbling
from ledgerlane.streaming.jobs import BATCH_COL, WINDOW_KEYS

CLOSED, CORRECTION = "closed", "correction"
MONEY = "decimal(38,6)"


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*WINDOW_KEYS).agg(F.sum("window_revenue").cast(MONEY).alias("window_revenue"),
                                           F.sum("event_count").alias("event_count"))


def _state(spark: SparkSession, out_path: str, batch_id: int) -> DataFrame | None:
    path = f"{out_path}/_open/{BATCH_COL}={batch_id}"
    return spark.read.parquet(path) if batch_id >= 0 and exists(spark, path) else None


def _clock(spark: SparkSession, out_path: str, batch_id: int) -> datetime | None:
    path = f"{out_path}/_clock/{BATCH_COL}={batch_id}"
    return spark.read.parquet(path).first()["clock"] if batch_id >= 0 and exists(spark, path) else None


def close_windows(batch: DataFrame, batch_id: int, out_path: str, length: str = WINDOW_LENGTH) -> None:
    """One micro-batch: rows (window_start, window_end, emission, window_revenue, event_count, added_revenue,
    added_count) of the windows that it closes or corrects."""
    spark = batch.sparkSession
    was = _clock(spark, out_path, batch_id - 1)
    parts = revenue_tumbling(batch, length=length).select(
        *WINDOW_KEYS, F.col("window_revenue").cast(MONEY).alias("window_revenue"), "event_count")
    parts.write.mode("overwrite").parquet(f"{out_path}/_parts")
    parts = spark.read.schema(parts.schema).parquet(f"{out_path}/_parts")
    latest = batch.agg(F.max("arrival").alias("clock")).first()["clock"]
    now = max((x for x in (was, latest) if x is not None), default=None)

    past = F.col("window_end") <= F.lit(was) if was is not None else F.lit(False)
    done = F.col("window_end") <= F.lit(now) if now is not None else F.lit(False)
    before = _state(spark, out_path, batch_id - 1)
    on_time = parts.filter(~past)
    running = _summed(on_time if before is None else before.unionByName(on_time))
    added = (F.col("window_revenue").alias("added_revenue"), F.col("event_count").alias("added_count"))
    emitted = running.filter(done).select(*WINDOW_KEYS, F.lit(CLOSED).alias("emission"), "window_revenue",
                                          "event_count", *added)
    late = parts.filter(past)
    if was is not None and late.take(1):
        earlier = (spark.read.option("basePath", out_path).parquet(f"{out_path}/{BATCH_COL}=*")
                   .filter(F.col(BATCH_COL) < batch_id).groupBy(*WINDOW_KEYS)
                   .agg(F.sum("added_revenue").alias("r"), F.sum("added_count").alias("n")))
        corrected = late.join(earlier, WINDOW_KEYS, "left").select(
            *WINDOW_KEYS, F.when(F.col("n").isNull(), CLOSED).otherwise(CORRECTION).alias("emission"),
            (F.col("window_revenue") + F.coalesce("r", F.lit(0))).cast(MONEY).alias("window_revenue"),
            (F.col("event_count") + F.coalesce("n", F.lit(0))).alias("event_count"), *added)
        emitted = emitted.unionByName(corrected)
    emitted.write.mode("overwrite").parquet(f"{out_path}/{BATCH_COL}={batch_id}")
    running.filter(~done).write.mode("overwrite").parquet(f"{out_path}/_open/{BATCH_COL}={batch_id}")
    (spark.range(1).select(F.lit(now).cast("timestamp").alias("clock"))
     .write.mode("overwrite").parquet(f"{out_path}/_clock/{BATCH_COL}={batch_id}"))


def closed_windows_sink(events: DataFrame, out_path: str, checkpoint: str, length: str = WINDOW_LENGTH,
                        name: str | None = None):
    w = (events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: close_windows(batch, batch_id, out_path, length)))
    return w.queryName(name) if name else w


def read_emissions(spark: SparkSession, out_path: str) -> DataFrame:
    """Every emission so far, with the batch that made it."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path}/{BATCH_COL}=*")


def open_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """The windows that no event has closed yet, after the last batch."""
    last = spark.read.parquet(f"{out_path}/_clock").agg(F.max(BATCH_COL)).first()[0]
    return _state(spark, out_path, last)


def window_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """Each window's total: what was emitted for it, or what it holds while open."""
    emitted = read_emissions(spark, out_path).select(
        *WINDOW_KEYS, F.col("added_revenue").alias("window_revenue"), F.col("added_count").alias("event_count"))
    return _summed(emitted.unionByName(open_windows(spark, out_path).select(*emitted.columns)))
