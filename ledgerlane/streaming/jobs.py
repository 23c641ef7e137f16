"""Structured Streaming jobs over order events.

Sinks are exactly-once and scale out:

* append results (text, events) → file sinks;
* aggregates → ``partials_sink``: each micro-batch's own partial result is written
  under ``batch_id=<n>`` (overwrite, so a replayed batch replaces itself) and
  readers add the parts up: no watermark, no late events, no growing state;
* per-event changelogs (revenue, count per status) → ``running_totals_sink``:
  each micro-batch runs the distributed prefix sum of ``operators.prefix`` and
  adds the per-key carry of all earlier batches, which is stored per batch id
  next to the output, so a replayed batch reads the same carry and writes the
  same rows; the prefix pass stages its rows in one folder that every batch
  overwrites.

Every query owns its checkpoint in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlane.functions.text import (console_line, notification_line, processed_message,
                                       processing_line)
from ledgerlane.operators.metrics import (ARRIVAL_ORDER, WINDOW_LENGTH, revenue_tumbling,
                                          status_counts)
from ledgerlane.operators.prefix import running_totals
from ledgerlane.sources.fixtures import to_order_events

BATCH_COL = "batch_id"


# ---------------------------------------------------------------- sources

def fixture_event_stream(spark: SparkSession, sf_dir: str,
                         max_files_per_trigger: int | None = None,
                         glob: str = "events.parquet") -> DataFrame:
    """S1 over the driver's events table: a parquet file stream, adapted to order
    events. ``arrival`` becomes TIMESTAMP (UTC).
    ``glob`` selects the files of ``sf_dir`` (a folder of event files works too)."""
    reader = spark.readStream.schema(_events_schema(spark, sf_dir, glob)).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return as_order_events(reader.parquet(sf_dir))


def as_order_events(events: DataFrame) -> DataFrame:
    """A stream of rows of the events table as order events."""
    return to_order_events(events).withColumn("arrival", F.col("arrival").cast("timestamp"))


def _events_schema(spark: SparkSession, folder: str, glob: str):
    return spark.read.option("pathGlobFilter", glob).parquet(folder).schema


# ---------------------------------------------------------------- running queries

def run_available(writer, timeout_s: float | None = None) -> StreamingQuery:
    """Start with the ``availableNow`` trigger and wait until every input
    present at start is processed, however long that takes. Tests may name a limit."""
    q = writer.trigger(availableNow=True).start()
    try:
        done = q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
        if timeout_s is not None and not done:
            raise TimeoutError(f"stream {q.name or q.id} did not finish in {timeout_s}s")
        if q.exception():
            raise q.exception()
    finally:
        if q.isActive:
            q.stop()
    return q


# ---------------------------------------------------------------- sinks

def write_batch(rows: DataFrame, out_path: str, batch_id: int) -> None:
    """One micro-batch's rows in a folder of its own; a replayed batch replaces it."""
    (rows.withColumn(BATCH_COL, F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out_path}/{BATCH_COL}={batch_id}"))


def partials_sink(events: DataFrame, partial: Callable[[DataFrame], DataFrame], out_path: str,
                  checkpoint: str, name: str | None = None):
    """Aggregates on a stream without engine state: each micro-batch writes its own partial
    result, readers add the parts up. No event is ever late and nothing but the output grows."""
    w = (events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: write_batch(partial(batch), out_path, batch_id)))
    return w.queryName(name) if name else w


def read_partials(spark: SparkSession, out_path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The parts of ``partials_sink`` added up per key."""
    parts = spark.read.parquet(out_path)
    kinds = dict(parts.dtypes)
    return parts.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in sums])


def write_running_totals(batch: DataFrame, batch_id: int, out_path: str,
                         order_by: list[str] = ARRIVAL_ORDER, keys: list[str] | None = None,
                         sums: dict[str, str] | None = None, count_as: str | None = None,
                         carry_columns: list[str] | None = None) -> None:
    """One micro-batch of a per-event changelog: ``operators.prefix.running_totals`` in
    ``order_by`` order plus the carry per key of all earlier batches. The carry table (one row
    per key seen so far) is written per batch id beside the output."""
    spark = batch.sparkSession
    user_keys = list(keys or [])
    keys = user_keys or ["_all"]   # one constant key: the carry join stays an equi-join
    sums = dict(sums or {})
    keep = [c for c in (carry_columns or []) if c not in keys and c not in order_by]
    carry_root = f"{out_path}/_carry"
    ck = [f"_ck{i}" for i in range(len(keys))]
    if not user_keys:
        batch = batch.withColumn("_all", F.lit(0))
    narrow = batch.select(*keep, *keys, *order_by,
                          *[c for c in dict.fromkeys(sums.values()) if c not in keys])
    local = running_totals(narrow, order_by=order_by, keys=keys, sums=sums,
                           count_as=count_as or "_cnt", stage_path=f"{out_path}/_stage")
    totals = batch.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_c_cnt"),
        *[F.sum(F.col(src)).cast("decimal(38,6)").alias(f"_c_{out}") for out, src in sums.items()])
    carry = (spark.read.parquet(f"{carry_root}/{BATCH_COL}={batch_id - 1}") if batch_id > 0
             else totals.limit(0))
    before = carry.select(*[F.col(k).alias(c) for k, c in zip(keys, ck)],
                          *[F.col(c).alias(f"{c}_prev") for c in carry.columns if c.startswith("_c_")])
    cond = None
    for k, c in zip(keys, ck):
        eq = F.col(k).eqNullSafe(F.col(c))
        cond = eq if cond is None else cond & eq
    # The carry is a stored table: the planner knows its size and picks the join.
    joined = local.join(before, cond, "left")
    outs = []
    if count_as:
        outs.append((F.col(count_as) + F.coalesce(F.col("_c_cnt_prev"), F.lit(0))).alias(count_as))
    for out in sums:
        prev = F.col(f"_c_{out}_prev")
        outs.append(F.when(F.col(out).isNull() & prev.isNull(), F.lit(None))
                    .otherwise(F.coalesce(F.col(out), F.lit(0)) + F.coalesce(prev, F.lit(0)))
                    .cast("decimal(38,6)").alias(out))
    (joined.select(*keep, *user_keys, *order_by, *outs)
           .write.mode("overwrite").parquet(f"{out_path}/{BATCH_COL}={batch_id}"))
    merged = carry.unionByName(totals).groupBy(*keys).agg(
        F.sum("_c_cnt").alias("_c_cnt"),
        *[F.sum(f"_c_{out}").cast("decimal(38,6)").alias(f"_c_{out}") for out in sums])
    merged.write.mode("overwrite").parquet(f"{carry_root}/{BATCH_COL}={batch_id}")


def running_totals_sink(events: DataFrame, out_path: str, checkpoint: str, name: str | None = None,
                        **changelog):
    """Per-event changelog on a stream, exactly once (A1/A2 as the source system emits them):
    ``write_running_totals`` per micro-batch, with its options."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_running_totals(batch, batch_id, out_path, **changelog)
        finally:
            batch.unpersist()

    w = (events.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    return w.queryName(name) if name else w


#: Options of the two changelogs.
REVENUE_CHANGELOG = {"sums": {"running_revenue": "total_order_value"}, "carry_columns": ["order_number"]}
STATUS_CHANGELOG = {"keys": ["order_status"], "count_as": "running_count", "carry_columns": ["order_number"]}


def running_revenue_sink(events: DataFrame, out_path: str, checkpoint: str,
                         order_by: list[str] = ARRIVAL_ORDER, name: str | None = None):
    """A2 changelog on a stream: total revenue so far, per event."""
    return running_totals_sink(events, out_path, checkpoint, name, order_by=order_by, **REVENUE_CHANGELOG)


def status_running_sink(events: DataFrame, out_path: str, checkpoint: str,
                        order_by: list[str] = ARRIVAL_ORDER, name: str | None = None):
    """A1 changelog on a stream: (status, count of the status so far), per event."""
    return running_totals_sink(events, out_path, checkpoint, name, order_by=order_by, **STATUS_CHANGELOG)


def text_file_sink(lines: DataFrame, out_path: str, checkpoint: str, name: str | None = None):
    """K1 in its exactly-once form: value-only string records as text files."""
    w = (lines.select("value").writeStream.format("text").outputMode("append")
         .option("path", out_path).option("checkpointLocation", checkpoint))
    return w.queryName(name) if name else w


def kafka_sink(records: DataFrame, bootstrap_servers: str, topic: str, checkpoint: str):
    """K1 to a topic (at-least-once); needs the Kafka connector on the classpath."""
    return (records.select(F.col("value").cast("string")).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic)
            .option("checkpointLocation", checkpoint))


def console_sink(df: DataFrame, prefix: str | None = None, mode: str = "append"):
    """K2: print records, optionally as ``<prefix>> <record>`` lines; a single
    ``value`` column prints as its text, other rows as JSON."""
    out = df
    if prefix is not None:
        record = (F.col("value").cast("string") if df.columns == ["value"]
                  else F.to_json(F.struct(*df.columns)))
        out = df.select(console_line(prefix, record).alias("value"))
    return out.writeStream.format("console").outputMode(mode).option("truncate", "false")


# ---------------------------------------------------------------- stream twins

WINDOW_KEYS, WINDOW_SUMS = ["window_start", "window_end"], ["window_revenue", "event_count"]


def status_counts_sink(events: DataFrame, out_path: str, checkpoint: str, name: str | None = None):
    """A1 on a stream: counts per status; read with ``read_partials(…, ["order_status"], ["event_count"])``."""
    return partials_sink(events, status_counts, out_path, checkpoint, name)


def status_updates_sink(events: DataFrame, out_path: str, checkpoint: str, name: str | None = None):
    """A1 in update mode: the engine keeps the count of each status, every trigger gives out those that
    changed. State is recovered from the checkpoint. Read with ``read_upserts(…, ["order_status"])``."""
    w = (status_counts(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: write_batch(batch, out_path, batch_id)))
    return w.queryName(name) if name else w


def read_upserts(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key among what the triggers gave out."""
    rows = spark.read.parquet(out_path)
    rest = [c for c in rows.columns if c not in (*keys, BATCH_COL)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH_COL).alias("latest"))
    return latest.select(*keys, "latest.*")


def window_revenue_sink(events: DataFrame, out_path: str, checkpoint: str, length: str = WINDOW_LENGTH,
                        name: str | None = None):
    """A3 replayed on arrival time: tumbling windows; read with ``read_partials(…, WINDOW_KEYS,
    WINDOW_SUMS)``. Arrivals may go back any distance, as in the source system, which has no
    watermark: a window's parts come from any batch."""
    return partials_sink(events, lambda batch: revenue_tumbling(batch, length=length), out_path, checkpoint, name)


def processed_lines(events: DataFrame) -> DataFrame:
    """E9 + D4 for the output topic."""
    return events.select(processed_message().alias("value"))


def _value_text(events: DataFrame):
    """The value as received when the events were decoded from JSON."""
    return F.col("value_text") if "value_text" in events.columns else None


def processing_lines(events: DataFrame) -> DataFrame:
    """E8 for the console branch."""
    return events.select(processing_line(_value_text(events)).alias("value"))


def notification_lines(events: DataFrame) -> DataFrame:
    """K5: the event logger's lines."""
    return events.select(notification_line(_value_text(events)).alias("value"))


def readback_stream(spark: SparkSession, path: str) -> DataFrame:
    """K6: the output topic's records read back as a stream of strings."""
    return spark.readStream.format("text").load(path)
