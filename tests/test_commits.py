"""Tables that are committed together (K4)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from ledgerlane.operators import placement
from ledgerlane.operators.commits import commits, is_committed, read_committed, write_together
from ledgerlane.operators.sinks import store_confirmed
from ledgerlane.sources import fixtures as fx


def _decided(spark):
    lines = fx.request_lines(spark, SF_TINY)
    decisions = placement.placement_decisions(fx.request_headers(spark, SF_TINY), lines, fx.inventory(spark, SF_TINY))
    return decisions, lines


def _broken(rows):
    """Rows that can be planned, but not written."""
    return rows.withColumn("quantity", F.when(F.length("sku_code") >= 0, F.raise_error(F.lit("lost"))).cast("int"))


def test_a_failure_between_the_two_writes_leaves_nothing(spark, scratch):
    root = os.path.join(scratch, "store")
    decisions, lines = _decided(spark)
    confirmed = placement.confirmed_orders(decisions)
    order_lines = placement.confirmed_order_lines(decisions, lines)
    with pytest.raises(Exception, match="lost"):
        write_together({"orders": confirmed, "order_lines": _broken(order_lines)}, root, 7)
    assert os.listdir(f"{root}/orders") == ["batch=7"]          # written, but not to be seen
    assert not is_committed(spark, root, 7) and read_committed(spark, root, "orders").count() == 0

    assert store_confirmed(decisions, lines, root, 7)           # the retry
    orders, stored = read_committed(spark, root, "orders"), read_committed(spark, root, "order_lines")
    assert orders.count() == orders.select("order_number").distinct().count() == confirmed.count()
    assert stored.count() == order_lines.count()
    assert stored.join(orders, "order_number", "left_anti").count() == 0
    assert orders.join(stored, "order_number", "left_anti").count() == 0


def test_a_batch_is_stored_once(spark, scratch):
    root = os.path.join(scratch, "store")
    decisions, lines = _decided(spark)
    assert store_confirmed(decisions, lines, root, 1) and not store_confirmed(decisions, lines, root, 1)
    n = read_committed(spark, root, "orders").count()
    assert n == placement.confirmed_orders(decisions).count()
    assert store_confirmed(decisions, lines, root, 2)           # another batch of equal orders is a batch of its own
    assert read_committed(spark, root, "orders").count() == 2 * n
    assert read_committed(spark, root, "orders", with_batch=True).filter("batch = 2").count() == n


def test_two_attempts_at_once_count_as_one(spark, scratch):
    root = os.path.join(scratch, "store")
    rows = spark.range(5)
    write_together({"t": rows}, root, 0)
    first = commits(spark, root).first().attempt
    # a second writer that did not see the first one's commit
    rows.write.parquet(f"{root}/t/batch=0/attempt=a{'9' * 20}-x")
    spark.createDataFrame([(0, f"a{'9' * 20}-x")], "batch long, attempt string").write.mode("append").parquet(f"{root}/_commits")
    assert commits(spark, root).first().attempt == first and read_committed(spark, root, "t").count() == 5


def test_nothing_written_yet(spark, scratch):
    root = os.path.join(scratch, "none")
    assert commits(spark, root).count() == 0
    assert read_committed(spark, root, "t", spark.range(1).schema).columns == ["id"]
