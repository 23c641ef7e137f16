"""Batch sinks of the placement pipeline (K3, K4).

Publishing is one write with a per-row ``topic`` column: every decision goes
to both topics, CONFIRMED and FAILED alike. Kafka writes are at-least-once;
file writes are atomic per job. An order is stored with its lines or not at all (``operators.commits``). The console lines (K2) are ``functions.text.console_line``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.codec import order_event_json
from ledgerlane.operators.commits import write_together
from ledgerlane.operators.placement import confirmed_order_lines, confirmed_orders
from ledgerlane.sources.events import EVENT_TOPIC, SECOND_TOPIC


def published_events(decisions: DataFrame, topics: tuple[str, ...] = (EVENT_TOPIC, SECOND_TOPIC)
                     ) -> DataFrame:
    """K3: (topic, key, value) — one unkeyed JSON record per decision and topic."""
    # One array of finished records: the JSON is built once, then exploded per topic.
    records = F.transform(F.array(*[F.lit(t) for t in topics]),
                          lambda t: F.struct(t.alias("topic"), F.col("value").alias("value")))
    return (decisions.select(order_event_json().alias("value"))
                     .select(F.inline(records))
                     .select("topic", F.lit(None).cast("binary").alias("key"), "value"))


def publish_to_kafka(records: DataFrame, bootstrap_servers: str) -> None:
    """Write (topic, key, value) records; needs the Kafka connector on the classpath."""
    (records.select("topic", "key", "value").write.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers).save())


def confirmed_tables(decisions: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """K4: the header and line tables of CONFIRMED orders."""
    return {"orders": confirmed_orders(decisions), "order_lines": confirmed_order_lines(decisions, lines)}


def store_confirmed(decisions: DataFrame, lines: DataFrame, root: str, batch: int) -> bool:
    """K4: persist the header and line tables of CONFIRMED orders only, under ``root``/orders and
    ``root``/order_lines, visible together to ``read_committed``. A batch that is stored already stays as it
    is (then false)."""
    return write_together(confirmed_tables(decisions, lines), root, batch)
