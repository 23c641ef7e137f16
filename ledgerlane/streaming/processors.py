"""The processing-time window of the live job (T1) as a ``StatefulProcessor``.

``ProcessingTimeWindowProcessor``: tumbling windows on the processing clock, aligned to the epoch.
Values are added to a map state under their window start and a timer at the window end emits
the window's sum and count once, also when the source has gone idle. The clock is read per
micro-batch, so an event can land one window late by up to one trigger interval (R4). Input
is pre-aggregated per partition, so the single key receives one row per partition and
micro-batch. (The per-event running revenue of the source system's single-key state is
``jobs.running_revenue_sink``: the same changelog, spread over all tasks.)

The key must be a real column (``withColumn`` first).

Spark starts one Python worker on the driver for such an operator, which sees neither the
package archive sent to executors nor the program's own path. So everything of this module that
runs in workers travels by value: it may use only what is installed there (pandas, pyarrow, pyspark).
"""

from __future__ import annotations

import sys
from decimal import Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DecimalType, LongType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REVENUE_KEY = "totalRevenue"  # fixed value: the source system's constant key
WINDOW_MS = 30_000            # fixed value: the source system's window

WINDOW_OUT = StructType([
    StructField("window_start_ms", LongType()),
    StructField("window_end_ms", LongType()),
    StructField("window_revenue", DecimalType(38, 6)),
    StructField("event_count", LongType()),
])


class ProcessingTimeWindowProcessor(StatefulProcessor):
    def __init__(self, window_ms: int = WINDOW_MS):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState(
            "sums", StructType([StructField("start", LongType())]),
            StructType([StructField("v", DecimalType(38, 6)), StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        start = now - now % self.window_ms
        add, count = Decimal(0), 0
        for pdf in rows:
            add += sum((Decimal(v) for v in pdf["total_order_value"] if v is not None), Decimal(0))
            count += int(pdf["event_count"].sum())
        if self.sums.containsKey((start,)):
            was, n = self.sums.getValue((start,))
            self.sums.updateValue((start,), (was + add, n + count))
        else:
            self.sums.updateValue((start,), (add, count))
            self.handle.registerTimer(start + self.window_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs()
        start = end - self.window_ms
        if self.sums.containsKey((start,)):
            total, n = self.sums.getValue((start,))
            self.sums.removeKey((start,))
            yield pd.DataFrame({"window_start_ms": [start], "window_end_ms": [end],
                                "window_revenue": [total], "event_count": [n]})

    def close(self) -> None:
        pass


def _partial_sums(batches):
    """One (key, partial sum, count) row per input partition and micro-batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    total, count = None, 0
    for b in batches:
        if b.num_rows:
            count += b.num_rows
            part = pc.sum(b.column("total_order_value")).as_py()
            if part is not None:
                total = part if total is None else total + part
    if count:
        yield pa.RecordBatch.from_arrays(
            [pa.array([REVENUE_KEY]), pa.array([total], pa.decimal128(38, 6)), pa.array([count], pa.int64())],
            names=["k", "total_order_value", "event_count"])


def apply_processing_time_windows(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """T1 live processing-time windows of ``window_ms``: sum, count and bounds.
    Run it with a ``processingTime`` trigger: under ``availableNow`` its
    wall-clock timers keep the query from ever finishing. Start it in ``session.rocksdb_state``:
    Spark's default state store has no room for both a map state and timers.

    The processing clock is read once per micro-batch, so the processor only
    needs each micro-batch's sum: a stateless Arrow pass pre-aggregates every
    input partition first, and only one row per partition reaches the single
    key's task."""
    values = events.select(F.col("total_order_value").cast(DecimalType(38, 6))
                           .alias("total_order_value"))
    partials = values.mapInArrow(_partial_sums,
                                 "k string, total_order_value decimal(38,6), event_count long")
    return partials.groupBy("k").transformWithStateInPandas(
        statefulProcessor=ProcessingTimeWindowProcessor(window_ms), outputStructType=WINDOW_OUT,
        outputMode="Append", timeMode="ProcessingTime")
