"""Order placement on a stream of nested requests (S3 → J1 → E4 → K3, K4).

The source system decides each request as it comes in: it asks the stock service, stores a confirmed order with
its lines in one transaction, and publishes an event either way. Here a micro-batch of requests is
decided by the same plan as a batch (``operators.placement``), in ``foreachBatch``:

* the stock is read afresh for every micro-batch, as the source system asks for every request. The rows asked
  for are kept under the batch's id first, so a batch that is played again after a failure is decided
  on the stock it saw, whatever the stock is by then;
* decisions, both topics' records, confirmed orders, their lines and the requests that raise are committed
  as one (``operators.commits``): a failure anywhere in between leaves nothing of the batch to be seen,
  and a batch played again after its commit changes nothing.

Requests keep the key of their record; two records are two requests, also when equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerlane.operators import placement
from ledgerlane.operators.commits import is_committed, read_committed, remove, write_together
from ledgerlane.operators.sinks import confirmed_tables, published_events

#: Tables of a placement's output folder, read with ``read_committed``.
TABLES = ("decisions", "published", "orders", "order_lines", "quarantine")


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stock_of_batch(lines: DataFrame, inventory: Callable[[SparkSession], DataFrame], out_dir: str,
                   batch_id: int) -> DataFrame:
    """The inventory rows that the lines ask for, as they were when the batch was first decided."""
    spark, root = lines.sparkSession, f"{out_dir}/_stock"
    if not is_committed(spark, root, batch_id):
        asked = placement.requested_skus(placement.valid_lines(lines))
        now = placement.inventory_in_list(inventory(spark).select("sku_code", "quantity"), asked)
        write_together({"rows": now}, root, batch_id)
    return read_committed(spark, root, "rows", with_batch=True).filter(F.col("batch") == batch_id).drop("batch")


def place_batch(batch: DataFrame, batch_id: int, inventory: Callable[[SparkSession], DataFrame], out_dir: str,
                publish: Callable[[DataFrame], None] | None = None, dedupe_answers: bool = False) -> None:
    """Decide one micro-batch of requests (order_key, order_email, items) and commit all that follows from
    it. ``publish`` also sends the records elsewhere ahead of the commit: at least once."""
    spark = batch.sparkSession
    if is_committed(spark, out_dir, batch_id):
        return
    work = f"{out_dir}/_work/{batch_id}"
    requests = _kept(batch, f"{work}/requests")
    lines = placement.explode_request_lines(requests)
    stock = stock_of_batch(lines, inventory, out_dir, batch_id)
    bad = _kept(placement.raising_requests(requests, lines, stock), f"{work}/quarantine")
    headers = requests.select("order_key", F.lit(None).cast("string").alias("order_number"), "order_email")
    decided = _kept(placement.placement_decisions(headers, lines, stock, dedupe_answers, exclude=bad),
                    f"{work}/decisions")
    records = published_events(decided)
    if publish:
        publish(records)
    write_together({"decisions": decided, "published": records, "quarantine": bad,
                    **confirmed_tables(decided, lines)}, out_dir, batch_id)
    remove(spark, work)


def placement_sink(requests: DataFrame, inventory: Callable[[SparkSession], DataFrame], out_dir: str,
                   checkpoint: str, name: str | None = None, **options) -> DataStreamWriter:
    """Placement of a stream of requests; ``inventory(spark)`` is called for every micro-batch. Bound the
    micro-batch where the stream is read (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``)."""
    w = (requests.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: place_batch(batch, batch_id, inventory, out_dir, **options)))
    return w.queryName(name) if name else w
