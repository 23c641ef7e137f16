"""Placement of streamed requests: replays, failures, a stock that changes, requests that raise."""

import json
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import placement
from ledgerlane.operators.commits import is_committed, read_committed
from ledgerlane.sources.requests import (PRICE_BEYOND, PRICE_NO_NUMBER, parse_order_requests, read_order_requests,
                                         unrepresentable_prices)
from ledgerlane.streaming import jobs
from ledgerlane.streaming.placement import TABLES, place_batch, placement_sink


def _stock(spark, *rows):
    return spark.createDataFrame(list(rows), "sku_code string, quantity int")


def _requests(spark, *requests):
    """(key, [(sku, price token, quantity), …] or None) as parsed requests."""
    rows = [(k, json.dumps({"orderEmail": f"u{k}@example.com", "orderLineItemsDtoList": None}) if lines is None else
             '{"orderEmail":"u%d@example.com","orderLineItemsDtoList":[%s]}' % (k, ",".join(
                 '{"id":%d,"skuCode":%s,"price":%s,"quantity":%s}' % (i, json.dumps(s), p, json.dumps(q))
                 for i, (s, p, q) in enumerate(lines)))) for k, lines in requests]
    return parse_order_requests(spark.createDataFrame(rows, "order_key long, value string"), key=F.col("order_key"))


def _statuses(spark, out):
    return {r.order_key: (r.order_status, r.total_order_value) for r in read_committed(spark, out, "decisions").collect()}


def test_a_replayed_batch_sees_the_stock_it_saw(spark, scratch):
    out = os.path.join(scratch, "out")
    batch = _requests(spark, (1, [("a", "5", 2)]), (2, [("b", "1", 1)]))
    first, later = _stock(spark, ("a", 1), ("b", 0)), _stock(spark, ("a", 0), ("b", 3))

    def fails(records):
        raise RuntimeError("the topic is away")

    with pytest.raises(RuntimeError, match="away"):
        place_batch(batch, 0, lambda s: first, out, publish=fails)
    assert not is_committed(spark, out, 0)
    seen = []
    place_batch(batch, 0, lambda s: later, out, publish=lambda r: seen.append(r.count()))
    assert _statuses(spark, out) == {1: ("CONFIRMED", Decimal(10)), 2: ("FAILED", Decimal(0))} and seen == [4]
    place_batch(batch, 0, lambda s: later, out)                 # played again after the commit
    assert read_committed(spark, out, "published").count() == 4
    place_batch(_requests(spark, (3, [("b", "1", 1)])), 1, lambda s: later, out)
    assert _statuses(spark, out)[3] == ("CONFIRMED", Decimal(1))


def test_every_table_of_a_batch(spark, scratch):
    out = os.path.join(scratch, "out")
    stock = _stock(spark, ("a", 1), ("twice", 1), ("twice", 2), ("none", 0))
    place_batch(_requests(
        spark, (1, [("a", "2.5", 2), ("a", "1", 1), ("a", "9", 0)]), (2, [("none", "1", 1)]), (3, []), (4, None),
        (5, [("a", "1.0000005", 1)]), (6, [("a", '"x"', 1)]), (7, [("twice", "1", 1)]), (8, [("a", "1", None)]),
        (9, [(None, "1", 1)]), (10, [("a", "null", 1)]), (11, [("none", "null", 1)])), 0, lambda s: stock, out)
    assert _statuses(spark, out) == {1: ("CONFIRMED", Decimal(12)), 2: ("FAILED", 0), 3: ("FAILED", 0), 11: ("FAILED", 0)}
    reasons = {r.order_key: r.reason for r in read_committed(spark, out, "quarantine").collect()}
    assert reasons == {4: "null line list", 5: PRICE_BEYOND, 6: PRICE_NO_NUMBER, 7: "duplicate SKU in inventory",
                       8: "null quantity", 9: "null sku", 10: "null price"}
    assert read_committed(spark, out, "orders").count() == 1
    assert sorted((r.sku_code, r.price, r.quantity) for r in read_committed(spark, out, "order_lines").collect()) == [
        ("a", Decimal(1), 1), ("a", Decimal("2.5"), 2)]
    assert read_committed(spark, out, "published").count() == 8
    assert set(TABLES) <= set(os.listdir(out)) and os.listdir(f"{out}/_work") == []


def test_streamed_files_with_a_restart_equal_the_batch(spark, scratch):
    src, out, ckpt = (os.path.join(scratch, x) for x in ("src", "out", "ckpt"))
    os.makedirs(src)
    stock = _stock(spark, *[(f"s{i}", i % 3) for i in range(30)])

    def write(name, keys):
        with open(os.path.join(src, name), "w") as f:
            for k in keys:
                items = [{"id": i, "skuCode": f"s{(k * 7 + i * i) % 33}", "price": (k % 90) / 4, "quantity": (k + i) % 4}
                         for i in range(k % 5)]
                f.write(json.dumps({"orderEmail": f"u{k}@example.com", "orderLineItemsDtoList": items}) + "\n")

    def run():
        stream = read_order_requests(spark, src, streaming=True)
        jobs.run_available(placement_sink(stream, lambda s: stock, out, ckpt))

    write("a.json", range(0, 40))
    write("b.json", range(40, 80))
    run()
    time.sleep(1.1)
    write("c.json", range(80, 120))
    run()
    requests = read_order_requests(spark, src)
    lines = placement.explode_request_lines(requests)
    expected = placement.placement_decisions(
        requests.select("order_key", F.lit(None).cast("string").alias("order_number"), "order_email"), lines, stock)
    columns = ["order_email", "order_status", "total_order_value"]
    got = read_committed(spark, out, "decisions")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))
    assert got.filter("order_status = 'CONFIRMED'").count() > 5


@pytest.mark.parametrize("token, price", [
    ("1", "1"), ("1.10", "1.10"), ("-0.000001", "-0.000001"), ("12345678901234567890.123456", "12345678901234567890.123456"),
    ("1e3", "1000"), ("1.25E-4", "0.000125"), ("1.5000000000000", "1.5"), ('" 7 "', "7"), ("0E-30", "0"), ("0.0000000", "0"),
    ("1200000E-9", "0.0012"), ("100E18", "100000000000000000000E0")])
def test_prices_are_held_as_written(spark, token, price):
    lines = placement.explode_request_lines(_requests(spark, (1, [("a", "3", 1), ("a", token, 1), ('b","price":4', "5", 1)])))
    got = [r.price for r in lines.collect()]
    if Decimal(price) < 10 ** 20:
        assert got == [3, Decimal(price), 5]
    else:
        assert got == [3, None, 5]


@pytest.mark.parametrize("token, reason", [
    ("1.0000001", PRICE_BEYOND), ("123456789012345678901", PRICE_BEYOND), ("1E-7", PRICE_BEYOND), ("1E20", PRICE_BEYOND),
    ("12E-7", PRICE_BEYOND), ('"1,5"', PRICE_NO_NUMBER), ("true", PRICE_NO_NUMBER), ('{"a":1}', PRICE_NO_NUMBER)])
def test_prices_that_cannot_be_held_are_listed(spark, token, reason):
    requests = _requests(spark, (1, [("a", "3", 1), ("a", token, 1)]))
    rows = unrepresentable_prices(requests).collect()
    assert [(r.order_key, r.position, r.reason) for r in rows] == [(1, 1, reason)]


def test_answers_keep_order_and_duplicates(spark):
    requests = _requests(spark, (1, [("b", "1", 1), ("a", "1", 1), ("b", "2", 3), ("x", "1", 1), ("a", "1", 0)]), (2, []),
                         (3, [("s%d" % (i % 7), "1", 1) for i in range(95)]))
    lines = placement.valid_lines(placement.explode_request_positions(requests)).repartition(5)
    stock = _stock(spark, ("a", 0), ("b", 2), *[(f"s{i}", i % 2) for i in range(6)])
    rows = placement.stock_answer_lists(requests, lines, stock, part_lines=10).collect()
    lists = {(r.order_key, r.part): [tuple(a) for a in r.answers] for r in rows}
    assert lists[1, 0] == [("b", True), ("a", False), ("b", True), ("x", False)] and lists[2, 0] == []
    assert sum((lists[3, k] for k in range(10)), []) == [(f"s{i % 7}", i % 7 < 6 and i % 2 == 1 if i % 7 == i else (i % 7) % 2 == 1 and i % 7 < 6)
                                                         for i in range(95)]
    assert len(lists) == 12


def test_plain_and_odd_prices_are_held_alike(spark):
    """Prices taken by one pattern and those taken by the whole reading give what the rule says, token by token."""
    from ledgerlane.schemas import PRICE
    from ledgerlane.sources.requests import parse_order_requests
    limit = "9" * 20 + ".999999"
    held = {"7.25": "7.25", "-7.25": "-7.25", "007.5": "7.5", limit: limit, "1.1234560": "1.123456", "1E3": "1000", "1e-6": "0.000001",
            '"8.50"': "8.5", '" 8.5\\n"': "8.5", '"8.5\\n"': "8.5", '"1."': "1", '".5"': "0.5", "0.0000000": "0"}
    lost = ["1" * 21, "1.1234567", "1e-7", '"abc"', '"1.5e"', '"1,5"', '"NaN"', "true"]
    tokens = [*held, *lost, '""', "null"]
    raw = spark.createDataFrame([(k, '{"orderLineItemsDtoList":[{"id":1,"price":%s,"quantity":2},{"id":2}]}' % t)
                                 for k, t in enumerate(tokens)], "order_key long, value string")
    parsed = parse_order_requests(raw, key=F.col("order_key"))
    got = {tokens[r.order_key]: r["items"] for r in parsed.collect()}
    assert all(len(items) == 2 and (items[1].price, items[1].price_text) == (None, None) for items in got.values())
    assert {t: got[t][0].price for t in held} == {t: Decimal(v) for t, v in held.items()}
    assert all(got[t][0].price is None and got[t][0].price_text for t in lost)
    assert [(got[t][0].price, got[t][0].price_text) for t in ('""', "null")] == [(None, None)] * 2
    assert got['"8.5\\n"'][0].price_text == "8.5" and got['"8.50"'][0].price_text == "8.50"
    assert parsed.schema["items"].dataType.elementType["price"].dataType == PRICE


def test_plain_prices_take_one_pattern(spark):
    """The readings of a price that isn't plain, a dozen patterns each, stand behind the one that tells plain ones."""
    from ledgerlane.sources import requests
    parsed = requests.parse_order_requests(spark.range(1).selectExpr("id", "'{}' AS value"), key=F.col("id"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(requests._PLAIN_PRICE) < plan.index("[\\x00-\\x20]+")
