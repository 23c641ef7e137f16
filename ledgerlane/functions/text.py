"""Text projections of order events (E8, E9, K5) and arrival stamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.functions.codec import json_quote

# Suffixes, prefixes and the instant shift of the source system.
PROCESSING_SUFFIX = " PROCESSING"
PROCESSED_SUFFIX = " PROCESSED"
NOTIFICATION_PREFIX = "Received Notification for Order - "
INSTANT_SHIFT = "INTERVAL '05:30' HOUR TO MINUTE"


def _txt(c: Column) -> Column:
    """Java string concatenation prints null as ``null``."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def event_text(value_text: Column | None = None) -> Column:
    """Data-class text of an order event:
    ``OrderEvent(orderNumber=…, orderEmail=…, orderStatus=…, totalOrderValue=…)``.

    ``value_text`` is the value as received (the raw JSON token, see
    ``decode_order_events``); without it the decimal column is printed.
    """
    value = value_text if value_text is not None else F.col("total_order_value")
    return F.concat(
        F.lit("OrderEvent(orderNumber="), _txt(F.col("order_number")),
        F.lit(", orderEmail="), _txt(F.col("order_email")),
        F.lit(", orderStatus="), _txt(F.col("order_status")),
        F.lit(", totalOrderValue="), _txt(value), F.lit(")"))


def processing_line(value_text: Column | None = None) -> Column:
    """``<event text> PROCESSING``."""
    return F.concat(event_text(value_text), F.lit(PROCESSING_SUFFIX))


def processed_message() -> Column:
    """E9 + D4: ``"OrderEvent(<orderNumber>) PROCESSED"`` as a JSON string literal."""
    return json_quote(F.concat(F.lit("OrderEvent("), _txt(F.col("order_number")), F.lit(")"),
                               F.lit(PROCESSED_SUFFIX)))


def notification_line(value_text: Column | None = None) -> Column:
    """K5: the event logger's line per received event."""
    return F.concat(F.lit(NOTIFICATION_PREFIX), event_text(value_text))


def console_line(prefix: str, record: Column) -> Column:
    """K2: a console sink's line, ``<prefix>> <record>``."""
    return F.concat(F.lit(prefix + "> "), record)


EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def arrival_millis(arrival: str | None = None) -> Column:
    """Epoch milliseconds (truncated, as a millisecond clock reads) of the
    arrival column, a TIMESTAMP_NTZ in UTC wall-clock time; independent of the
    session time zone. Without a column: the micro-batch clock."""
    if arrival is None:
        return F.unix_millis(F.current_timestamp())
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH_NTZ}, CAST(`{arrival}` AS TIMESTAMP_NTZ))")


def shifted_instant(millis: Column) -> Column:
    """The arrival instant plus 5 h 30 min — a shifted instant, not a
    time-zone conversion — as a UTC wall-clock TIMESTAMP_NTZ."""
    since_epoch = F.make_dt_interval(secs=(millis / F.lit(1000)).cast("decimal(18,3)"))
    return F.expr(EPOCH_NTZ) + since_epoch + F.expr(INSTANT_SHIFT)


def stamp_arrival(arrival: str | None = None) -> tuple[Column, Column]:
    """E10 columns ``(timestamp, instant)`` from the named arrival column.
    Without one the micro-batch clock ``current_timestamp()`` is used (live
    streams)."""
    ms = arrival_millis(arrival)
    return ms.alias("timestamp"), shifted_instant(ms).alias("instant")


def iso_instant(instant: Column, millis: Column) -> Column:
    """ISO-8601 instant text as the JVM prints an Instant with millisecond
    precision: ``2024-01-01T05:30:07.179Z``, or ``…:07Z`` when the
    milliseconds are zero."""
    return F.when(millis % 1000 == 0, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")) \
            .otherwise(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def timed_event_text(millis: Column, instant: Column, value_text: Column | None = None) -> Column:
    """E10 printed: ``TimedOrderEvent(orderNumber=…, …, timestamp=<ms>, instant=<ISO>)``."""
    value = value_text if value_text is not None else F.col("total_order_value")
    return F.concat(
        F.lit("TimedOrderEvent(orderNumber="), _txt(F.col("order_number")),
        F.lit(", orderEmail="), _txt(F.col("order_email")),
        F.lit(", orderStatus="), _txt(F.col("order_status")),
        F.lit(", totalOrderValue="), _txt(value),
        F.lit(", timestamp="), _txt(millis),
        F.lit(", instant="), _txt(iso_instant(instant, millis)), F.lit(")"))
