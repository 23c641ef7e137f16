"""Synthetic order events.

The source system's generator draws a random e-mail and a random price per
event and derives the status from the price (price 0 → FAILED). Here the
draws are deterministic hashes of the row id, so a recomputed partition
yields the same events and an SQL engine with ``md5`` reproduces them; the
random mode (``uuid()`` order numbers) is available for live load.

The generator emits one event per input row: feed it ``spark.range(n)`` for
load tests, or a table's ids so the volume follows the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.ids import random_order_number
from ledgerlane.schemas import CONFIRMED, FAILED

# The generator's price list (in this order).
PRICES = [0, 41000, 56000, 65000]
# The generator draws from four customer e-mails; these stand in for them.
EMAILS = ["ana@example.com", "ben@example.com", "chen@example.com", "dara@example.com"]


def _draw(id_col: Column, salt: str) -> Column:
    """Uniform draw in [0, 4): first 32 bits of md5(salt-id) modulo 4."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt + "-"), id_col.cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % 4).cast("int")


def synthetic_order_events(ids: DataFrame, id_col: str = "id", random_ids: bool = False,
                           extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, order_number, order_email, total_order_value, order_status, *extra)."""
    rid = F.col(id_col)
    if random_ids:
        number = random_order_number()
    else:
        h = F.md5(F.concat(F.lit("synthetic-"), rid.cast("string")))
        number = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                             F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    price = F.element_at(F.array(*[F.lit(p) for p in PRICES]), _draw(rid, "price") + 1)
    email = F.element_at(F.array(*[F.lit(e) for e in EMAILS]), _draw(rid, "email") + 1)
    return ids.select(
        rid.alias("id"),
        number.alias("order_number"),
        email.alias("order_email"),
        price.cast("decimal(18,0)").alias("total_order_value"),
        F.when(price > 0, F.lit(CONFIRMED)).otherwise(F.lit(FAILED)).alias("order_status"),
        *[F.col(c) for c in extra])


def synthetic_event_stream(spark, rows_per_batch: int, start_ms: int = 1_704_067_200_000,
                           advance_ms_per_batch: int = 1000, random_ids: bool = False) -> DataFrame:
    """S4 as a live source: ``rate-micro-batch`` emits ``rows_per_batch`` ids per
    micro-batch, deterministically (same ids and times on replay), turned into
    order events with an ``arrival`` column and ``event_id`` tie-break."""
    rate = (spark.readStream.format("rate-micro-batch")
            .option("rowsPerBatch", rows_per_batch)
            .option("startTimestamp", start_ms)
            .option("advanceMillisPerBatch", advance_ms_per_batch)
            .load())
    ids = rate.select(F.col("value").alias("id"), F.col("timestamp").alias("arrival"))
    return (synthetic_order_events(ids, "id", random_ids, extra=("arrival",))
            .withColumnRenamed("id", "event_id"))
