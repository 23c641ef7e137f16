"""Placement goldens on the stock service's seed inventory, fed
as nested JSON requests through the nested-request path."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import placement
from ledgerlane.sources.requests import inventory_seed, read_order_requests

# (lines as (sku, quantity, price), expected status, expected total)
GOLDENS = [
    ([("iphone_13", 1, "41000"), ("iphone_15", 2, "65000")], "CONFIRMED", Decimal("171000")),
    ([("iphone_13", 1, "41000"), ("iphone_14", 1, "56000")], "FAILED", Decimal("0")),
    ([("iphone_13", 1, "41000"), ("iphone_14", 0, "56000")], "CONFIRMED", Decimal("41000")),
    ([("unknown", 1, "100")], "FAILED", Decimal("0")),
    ([("iphone_13", 1, "41000"), ("iphone_13", 1, "41000")], "CONFIRMED", Decimal("164000")),
    ([("iphone_13", 500, "41000")], "CONFIRMED", Decimal("20500000")),
    ([("iphone_13", 1, "0")], "FAILED", Decimal("0")),
    ([("iphone_13", 1, "0.004")], "CONFIRMED", Decimal("0.004")),
    ([("iphone_13", 1, "10.005")], "CONFIRMED", Decimal("10.005")),
    ([], "FAILED", Decimal("0")),
]


@pytest.fixture(scope="module")
def decided(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("requests") / "requests.json"
    with open(path, "w") as fh:
        for key, (lines, _, _) in enumerate(GOLDENS):
            items = [{"id": i, "skuCode": s, "price": float(p), "quantity": q}
                     for i, (s, q, p) in enumerate(lines)]
            fh.write(json.dumps({"orderEmail": f"c{key}@example.com",
                                 "orderLineItemsDtoList": items}) + "\n")
    requests = read_order_requests(spark, str(path))
    lines = placement.explode_request_lines(requests).withColumn("id", F.lit(0).cast("long"))
    headers = requests.select("order_key", F.lit(None).cast("string").alias("order_number"),
                              "order_email")
    decisions = placement.placement_decisions(headers, lines, inventory_seed(spark))
    return {int(r.order_email[1:].split("@")[0]): r for r in decisions.collect()}


@pytest.mark.parametrize("key", range(len(GOLDENS)))
def test_seed_goldens(decided, key):
    _, status, total = GOLDENS[key]
    row = decided[key]
    assert row.order_status == status
    assert row.total_order_value == total
    assert row.order_number and len(row.order_number) == 36


def test_dedupe_option_gives_plain_sum(spark):
    lines = spark.createDataFrame(
        [(1, 0, "iphone_13", Decimal("41000"), 1), (1, 1, "iphone_13", Decimal("41000"), 1)],
        "order_key long, id long, sku_code string, price decimal(18,2), quantity int")
    headers = spark.createDataFrame([(1, None, "a@example.com")],
                                    "order_key long, order_number string, order_email string")
    inv = inventory_seed(spark)
    faithful = placement.placement_decisions(headers, lines, inv).first()
    plain = placement.placement_decisions(headers, lines, inv, dedupe_answers=True).first()
    assert faithful.total_order_value == Decimal("164000")
    assert plain.total_order_value == Decimal("82000")


def test_k_squared_equals_self_join(spark):
    """The n·s shortcut equals the source system's answers × lines pairing."""
    from conftest import SF_TINY
    from ledgerlane.sources import fixtures as fx
    lines = placement.valid_lines(fx.request_lines(spark, SF_TINY))
    inv = fx.inventory(spark, SF_TINY)
    fast = {r.order_key: r.total_value for r in placement.order_totals(lines, inv).collect()}
    answers = placement.stock_answers(lines, inv).filter("in_stock").alias("a")
    l2 = lines.alias("l")
    pairs = answers.join(l2, (F.col("a.order_key") == F.col("l.order_key"))
                         & (F.col("a.sku_code") == F.col("l.sku_code")))
    slow = {r.order_key: r.t for r in pairs.groupBy("a.order_key").agg(
        F.sum(F.col("l.price") * F.col("l.quantity")).alias("t")).collect()}
    for key, total in fast.items():
        assert total == slow.get(key, Decimal(0)), key


def test_sku_lookup_raises_on_duplicate(spark):
    inv = spark.createDataFrame([("a", 1), ("a", 2)], "sku_code string, quantity int")
    skus = spark.createDataFrame([("a",)], "sku_code string")
    with pytest.raises(Exception, match="duplicate SKU"):
        placement.sku_lookup(skus, inv).collect()


def test_quarantine_reasons(spark):
    lines = spark.createDataFrame(
        [(1, "a", Decimal("1"), None), (2, None, Decimal("1"), 2), (3, "b", None, 1),
         (4, "c", None, 0)],
        "order_key long, sku_code string, price decimal(18,2), quantity int")
    inv = spark.createDataFrame([("b", 1), ("out", 0)], "sku_code string, quantity int")
    lines = lines.union(spark.createDataFrame([(5, "out", None, 1), (6, "unknown", None, 1)], lines.schema))
    got = {r.order_key: r.reason for r in placement.quarantine_requests(lines, inv).collect()}
    # a price is only needed where the SKU is in stock: 5 and 6 fail, they don't raise
    assert got == {1: "null quantity", 2: "null sku", 3: "null price"}
    headers = spark.createDataFrame([(5, None, "e"), (6, None, "f")],
                                    "order_key long, order_number string, order_email string")
    lines = lines.withColumn("id", F.lit(0).cast("long"))
    assert {r.order_status for r in placement.placement_decisions(headers, lines, inv).collect()} == {"FAILED"}


def test_stored_lines_carry_the_number_of_their_decision(spark):
    lines = spark.createDataFrame([(1, 0, "iphone_13", Decimal("2"), 1)],
                                  "order_key long, id long, sku_code string, price decimal(18,2), quantity int")
    headers = spark.createDataFrame([(1, "MY-NUMBER", "a")],
                                    "order_key long, order_number string, order_email string")
    decided = placement.placement_decisions(headers, lines, inventory_seed(spark))
    assert [r.order_number for r in placement.confirmed_order_lines(decided, lines).collect()] == ["MY-NUMBER"]
    assert [r.order_number for r in placement.confirmed_orders(decided).collect()] == ["MY-NUMBER"]


def test_excluded_requests_get_no_decision(spark):
    from ledgerlane.sources.requests import inventory_seed
    lines = spark.createDataFrame(
        [(1, 0, "iphone_13", Decimal("10"), 1), (2, 0, "iphone_13", Decimal("10"), None)],
        "order_key long, id long, sku_code string, price decimal(18,2), quantity int")
    headers = spark.createDataFrame([(1, None, "a"), (2, None, "b")],
                                    "order_key long, order_number string, order_email string")
    bad = placement.quarantine_requests(lines, inventory_seed(spark))
    got = placement.placement_decisions(headers, lines, inventory_seed(spark), exclude=bad)
    assert [(r.order_key, r.order_status) for r in got.collect()] == [(1, "CONFIRMED")]


def test_nested_request_without_list_is_quarantined(spark):
    req = spark.createDataFrame([(1, "a", None)], "order_key long, order_email string, "
                                "items array<struct<id:long,sku_code:string,"
                                "price:decimal(18,6),quantity:int>>")
    assert placement.quarantine_nested_requests(req).first().reason == "null line list"


def test_duplicate_inventory_sku_is_never_double_counted(spark):
    lines = spark.createDataFrame(
        [(1, 0, "a", Decimal("10"), 1), (2, 0, "b", Decimal("5"), 2)],
        "order_key long, id long, sku_code string, price decimal(18,2), quantity int")
    headers = spark.createDataFrame([(1, None, "x"), (2, None, "y")],
                                    "order_key long, order_number string, order_email string")
    inv = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "sku_code string, quantity int")
    got = {r.order_key: (r.order_status, r.total_order_value)
           for r in placement.placement_decisions(headers, lines, inv).collect()}
    assert got == {2: ("CONFIRMED", Decimal("10"))}     # order 1 raises upstream: no decision
    conflicts = placement.inventory_conflicts(lines, inv).collect()
    assert [(r.order_key, r.reason) for r in conflicts] == [(1, "duplicate SKU in inventory")]
    with pytest.raises(Exception, match="duplicate SKU"):
        placement.stock_answers(lines, inv).collect()
    answers = placement.stock_answers(lines.filter("sku_code = 'b'"), inv).collect()
    assert [r.in_stock for r in answers] == [True]
