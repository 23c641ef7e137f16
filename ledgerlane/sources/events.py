"""Order-event sources (S1) and the JSON wire rendering used to test decoding.

``read_event_stream`` is the one entry point for live input: Kafka topic in
production, a file stream (JSON lines or parquet) in tests; both yield the
decoded columnar order events of ``functions.codec``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ledgerlane.functions.codec import decode_order_events
from ledgerlane.schemas import ORDER_EVENT

# The source system's topics.
EVENT_TOPIC = "notificationId"
SECOND_TOPIC = "flinkTopic"
OUTPUT_TOPIC = "flinkOutput"

# Stored (parquet) order events: the columnar event plus arrival and tie-break.
STORED_EVENT = StructType(ORDER_EVENT.fields + [StructField("arrival", TimestampType()),
                                                StructField("event_id", LongType())])

# Wire renderings: every event is rendered; its event_id picks one of sixteen
# forms (event_id % 16). Forms 7–11 are dropped by the decoder, 15 is unrepresentable.
RENDER_FORMS = 16
NO_EMAIL_FORM = 6
EMPTY_VALUE_FORM = 12
DROPPED_FORMS = (7, 8, 9, 10, 11, 15)
HUGE_FORM = 15
HUGE_NUMBER = "1" + "0" * 39   # 40 digits: more than DECIMAL(38, 6) holds


def _q(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def render_event_json(events: DataFrame) -> DataFrame:
    """(event_id, value): order events as JSON text with deterministic damage.

    0–3 well-formed · 4 quoted number · 5 trailing text after the object ·
    6 no orderEmail field · 7 truncated · 8 unknown field · 9 wrong-case
    field name · 10 non-numeric value · 11 literal ``null`` · 12 empty quoted value ·
    13 quoted number with blanks · 14 trailing text that looks like a nested field ·
    15 a number of 40 digits.
    """
    num = F.col("total_order_value").cast("string")
    head = F.concat(F.lit('{"orderNumber":'), _q(F.col("order_number")))
    email = F.concat(F.lit(',"orderEmail":'), _q(F.col("order_email")))
    status = F.concat(F.lit(',"orderStatus":'), _q(F.col("order_status")))
    value = F.concat(F.lit(',"totalOrderValue":'), num)
    good = F.concat(head, email, status, value, F.lit("}"))
    form = F.col("event_id") % RENDER_FORMS
    rendered = (
        F.when(form == 4, F.concat(head, email, status, F.lit(',"totalOrderValue":'), _q(num),
                                   F.lit("}")))
         .when(form == 5, F.concat(good, F.lit(" trailing")))
         .when(form == NO_EMAIL_FORM, F.concat(head, status, value, F.lit("}")))
         .when(form == 7, F.concat(head, email, status, value))
         .when(form == 8, F.concat(head, email, status, value, F.lit(',"channel":"web"}')))
         .when(form == 9, F.concat(head, email, F.lit(',"OrderStatus":'), _q(F.col("order_status")),
                                   value, F.lit("}")))
         .when(form == 10, F.concat(head, email, status, F.lit(',"totalOrderValue":"n/a"}')))
         .when(form == 11, F.lit("null"))
         .when(form == EMPTY_VALUE_FORM, F.concat(head, email, status, F.lit(',"totalOrderValue":""}')))
         .when(form == 13, F.concat(head, email, status, F.lit(',"totalOrderValue":" '), num, F.lit(' "}')))
         .when(form == 14, F.concat(good, F.lit(' "orderEmail":{"a":1}')))
         .when(form == HUGE_FORM, F.concat(head, email, status, F.lit(f',"totalOrderValue":{HUGE_NUMBER}}}')))
         .otherwise(good))
    return events.select("event_id", rendered.alias("value"))


def file_records(text: DataFrame) -> DataFrame:
    """(value, arrival, event_id) of text lines, for batch and stream alike: arrival is the file's
    modification time, the tie-break a hash of file and record. Both are stable on a replay. A
    text file tells no order of its own: within a file, changelogs follow the hash; sources that know
    an arrival keep it in ``STORED_EVENT`` files."""
    return text.select(
        "value", F.col("_metadata.file_modification_time").cast("timestamp").alias("arrival"),
        F.xxhash64(F.col("_metadata.file_path"), F.col("value")).alias("event_id"))


def read_event_stream(spark: SparkSession, *, kafka_servers: str | None = None,
                      topic: str = EVENT_TOPIC, path: str | None = None,
                      fmt: str = "json", starting_offsets: str = "latest",
                      max_files_per_trigger: int | None = None,
                      max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Unbounded order events. Kafka: value only, key ignored, resume from
    the checkpoint, else ``starting_offsets``. Files: ``json`` lines are
    decoded strictly like Kafka values; ``parquet`` files must already hold
    the columnar event schema. Every form carries ``arrival`` and a tie-break
    ``event_id`` for the changelogs."""
    if kafka_servers:
        raw = (spark.readStream.format("kafka")
               .option("kafka.bootstrap.servers", kafka_servers)
               .option("subscribe", topic)
               .option("startingOffsets", starting_offsets))
        if max_offsets_per_trigger:
            raw = raw.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        raw = raw.load()
        # Arrival is the broker timestamp; (partition, offset) is a unique,
        # replay-stable tie-break within it.
        decoded = decode_order_events(raw, "value", keep=("timestamp", "partition", "offset"))
        return (decoded
                .withColumn("event_id", F.shiftleft(F.col("partition").cast("long"), 40)
                            + F.col("offset"))
                .withColumnRenamed("timestamp", "arrival")
                .drop("partition", "offset"))
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "json":
        return decode_order_events(file_records(reader.format("text").load(path)), "value",
                                   keep=("arrival", "event_id"))
    return reader.schema(STORED_EVENT).format(fmt).load(path)
