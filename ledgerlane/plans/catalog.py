"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the survey's inventory, over the driver's tables.

Results are projected to portable types so an SQL oracle can be compared
value for value: decimals (exact inside the plan) become DOUBLE at the very
end, timestamps become text, binary keys become text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions import codec, text
from ledgerlane.operators import metrics, placement
from ledgerlane.operators.sinks import published_events
from ledgerlane.session import read_table
from ledgerlane.sources import fixtures as fx
from ledgerlane.sources.events import render_event_json
from ledgerlane.sources.requests import (parse_order_requests, render_order_requests,
                                         request_summary, unrepresentable_prices)
from ledgerlane.sources.synthetic import synthetic_order_events

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
INSTANT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def portable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_FORMAT)
        elif isinstance(f.dataType, T.BinaryType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- requests, stock

def q_order_requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_summary(fx.request_headers(spark, sf), fx.request_lines(spark, sf))


def _parsed_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Nested requests rendered in their JSON wire form and parsed again."""
    wire = render_order_requests(fx.nested_requests(spark, sf))
    return parse_order_requests(wire, key=F.col("order_key"))


def q_order_requests_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed_requests(spark, sf).select(
        "order_key", "order_email", F.size("items").cast("long").alias("line_count"),
        F.col("items").isNull().alias("no_list"))


def q_order_lines_nested(spark: SparkSession, sf: str) -> DataFrame:
    return portable(placement.explode_request_lines(_parsed_requests(spark, sf)))


def q_request_prices(spark: SparkSession, sf: str) -> DataFrame:
    """S3: every price of nested requests, as written and as held; null where it can't be held exactly."""
    requests = parse_order_requests(fx.price_requests(spark, sf), key=F.col("order_key"))
    lines = requests.select("order_key", F.explode("items").alias("line"))
    return lines.select("order_key", "line.id", "line.sku_code", "line.price_text",
                        codec.plain_number(F.col("line.price")).alias("price"))


def q_unrepresentable_prices(spark: SparkSession, sf: str) -> DataFrame:
    return unrepresentable_prices(parse_order_requests(fx.price_requests(spark, sf), key=F.col("order_key")))


def q_stock_answer_lists(spark: SparkSession, sf: str) -> DataFrame:
    """One list of answers per request, in the order of its lines, written out as text."""
    requests = fx.placed_requests(spark, sf)
    lines = placement.valid_lines(placement.explode_request_positions(requests))
    lists = placement.stock_answer_lists(requests, lines, fx.inventory(spark, sf))
    answer = F.array_join(F.transform("answers", lambda a: F.concat(a["sku_code"], F.lit(":"), a["in_stock"].cast("string"))), ",")
    return lists.select("order_key", "part", F.size("answers").cast("long").alias("answer_count"), answer.alias("answers"))


def q_quarantined_requests(spark: SparkSession, sf: str) -> DataFrame:
    bad = placement.quarantine_requests(fx.damaged_lines(spark, sf), fx.inventory(spark, sf))
    return bad.unionByName(placement.quarantine_nested_requests(fx.nested_requests(spark, sf)))


def q_quarantined_events(spark: SparkSession, sf: str) -> DataFrame:
    bad = metrics.event_problems(fx.damaged_events(spark, sf)).select("event_id", "reason")
    huge = codec.unrepresentable_events(render_event_json(fx.order_events(spark, sf)), keep=("event_id",))
    return bad.unionByName(huge.select("event_id", "reason"))


def q_console_lines(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerlane.streaming.dashboard import PROCESSING_PREFIX

    return fx.order_events(spark, sf).select("event_id", text.console_line(
        PROCESSING_PREFIX, text.processing_line()).alias("line"))


def q_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return portable(fx.request_lines(spark, sf).drop("id"))


def q_valid_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return portable(placement.valid_lines(fx.request_lines(spark, sf)).drop("id"))


def q_line_values(spark: SparkSession, sf: str) -> DataFrame:
    v = placement.line_values(placement.valid_lines(fx.request_lines(spark, sf)))
    return portable(v.select("order_key", "id", "sku_code", "line_value"))


def q_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return fx.inventory(spark, sf)


def _requested(spark: SparkSession, sf: str) -> DataFrame:
    return placement.requested_skus(placement.valid_lines(fx.request_lines(spark, sf)))


def q_inventory_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return placement.inventory_in_list(fx.inventory(spark, sf), _requested(spark, sf))


def q_sku_exists(spark: SparkSession, sf: str) -> DataFrame:
    return placement.sku_exists(_requested(spark, sf), fx.inventory(spark, sf))


def q_sku_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return placement.sku_lookup(_requested(spark, sf), fx.inventory(spark, sf))


def q_stock_answers(spark: SparkSession, sf: str) -> DataFrame:
    lines = placement.valid_lines(fx.request_lines(spark, sf))
    return placement.stock_answers(lines, fx.inventory(spark, sf))


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    lines = placement.valid_lines(fx.request_lines(spark, sf))
    return placement.order_totals(lines, fx.inventory(spark, sf))


def q_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    return portable(_totals(spark, sf).select("order_key", "total_value"))


def q_order_all_in_stock(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf).select("order_key", "all_in_stock")


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return placement.placement_decisions(fx.request_headers(spark, sf),
                                         fx.request_lines(spark, sf), fx.inventory(spark, sf))


def q_placement_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return portable(_decisions(spark, sf))


def q_confirmed_orders(spark: SparkSession, sf: str) -> DataFrame:
    return portable(placement.confirmed_orders(_decisions(spark, sf)))


def q_confirmed_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return portable(placement.confirmed_order_lines(_decisions(spark, sf),
                                                    fx.request_lines(spark, sf)))


def q_published_events(spark: SparkSession, sf: str) -> DataFrame:
    return portable(published_events(_decisions(spark, sf)).drop("key"))


# ---------------------------------------------------------------- metrics

def q_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.status_counts(fx.order_events(spark, sf))


def q_status_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.status_running_counts(fx.order_events(spark, sf)).drop("arrival")


def q_revenue_total(spark: SparkSession, sf: str) -> DataFrame:
    return portable(metrics.revenue_total(fx.order_events(spark, sf)))


def q_revenue_running(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.revenue_running(fx.order_events(spark, sf))
    return portable(r.select("order_number", "event_id", "running_revenue"))


def q_revenue_tumbling_30s(spark: SparkSession, sf: str) -> DataFrame:
    return portable(metrics.revenue_tumbling(fx.order_events(spark, sf)))


# ---------------------------------------------------------------- codec, text

def q_decode_order_events(spark: SparkSession, sf: str) -> DataFrame:
    raw = render_event_json(fx.order_events(spark, sf))
    return portable(codec.decode_order_events(raw, "value", keep=("event_id",)))


def q_encode_order_events(spark: SparkSession, sf: str) -> DataFrame:
    return portable(codec.encode_order_events(fx.order_events(spark, sf)))


def q_processing_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx.order_events(spark, sf).select("event_id", text.processing_line().alias("line"))


def q_processed_messages(spark: SparkSession, sf: str) -> DataFrame:
    return fx.order_events(spark, sf).select("event_id", text.processed_message().alias("value"))


def q_notification_lines(spark: SparkSession, sf: str) -> DataFrame:
    return fx.order_events(spark, sf).select("event_id", text.notification_line().alias("line"))


def q_timed_order_events(spark: SparkSession, sf: str) -> DataFrame:
    return timed_projection(fx.order_events(spark, sf))


def timed_projection(ev: DataFrame) -> DataFrame:
    """E10 over events with an ``arrival`` column (batch or stream)."""
    ts, instant = text.stamp_arrival("arrival")
    stamped = ev.select("order_number", "order_email", "order_status", "total_order_value",
                        ts, instant)
    return portable(stamped.select(
        "order_number", "order_email", "order_status", "total_order_value", "timestamp",
        F.date_format("instant", INSTANT_FORMAT).alias("instant"),
        text.timed_event_text(F.col("timestamp"), F.col("instant")).alias("line")))


# ---------------------------------------------------------------- generator

def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    ids = read_table(spark, sf, "events").select("event_id")
    return synthetic_order_events(ids, "event_id")


def q_synthetic_order_events(spark: SparkSession, sf: str) -> DataFrame:
    return portable(_synthetic(spark, sf))


def q_synthetic_order_json(spark: SparkSession, sf: str) -> DataFrame:
    return _synthetic(spark, sf).select("id", codec.generator_json().alias("value"))


BATCH_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "order_requests": q_order_requests,
    "order_requests_nested": q_order_requests_nested,
    "order_lines_nested": q_order_lines_nested,
    "request_prices": q_request_prices,
    "unrepresentable_prices": q_unrepresentable_prices,
    "stock_answer_lists": q_stock_answer_lists,
    "order_lines": q_order_lines,
    "valid_order_lines": q_valid_order_lines,
    "line_values": q_line_values,
    "inventory": q_inventory,
    "inventory_in_list": q_inventory_in_list,
    "sku_exists": q_sku_exists,
    "sku_lookup": q_sku_lookup,
    "stock_answers": q_stock_answers,
    "order_totals": q_order_totals,
    "order_all_in_stock": q_order_all_in_stock,
    "placement_decisions": q_placement_decisions,
    "confirmed_orders": q_confirmed_orders,
    "confirmed_order_lines": q_confirmed_order_lines,
    "published_events": q_published_events,
    "quarantined_requests": q_quarantined_requests,
    "quarantined_events": q_quarantined_events,
    "status_counts": q_status_counts,
    "status_running_counts": q_status_running_counts,
    "revenue_total": q_revenue_total,
    "revenue_running": q_revenue_running,
    "revenue_tumbling_30s": q_revenue_tumbling_30s,
    "decode_order_events": q_decode_order_events,
    "encode_order_events": q_encode_order_events,
    "processing_lines": q_processing_lines,
    "console_lines": q_console_lines,
    "processed_messages": q_processed_messages,
    "notification_lines": q_notification_lines,
    "timed_order_events": q_timed_order_events,
    "synthetic_order_events": q_synthetic_order_events,
    "synthetic_order_json": q_synthetic_order_json,
}
