"""Decode strictness table, encode/quote forms, round trip."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import codec, text

GOOD = '{"orderNumber":"a","orderEmail":"e","orderStatus":"CONFIRMED","totalOrderValue":41000}'

# (input, kept?, expected value, expected value text)
CASES = [
    (GOOD, True, Decimal("41000"), "41000"),
    ('{"orderNumber":"a"', False, None, None),
    ("", False, None, None),
    ("null", False, None, None),
    ("[1]", False, None, None),
    ('{"orderNumber":"a","extra":1}', False, None, None),
    ('{"OrderNumber":"a"}', False, None, None),
    ("{}", True, None, None),
    ('{"totalOrderValue":"41000.50"}', True, Decimal("41000.50"), "41000.50"),
    ('{"totalOrderValue":"abc"}', False, None, None),
    ('{"totalOrderValue":true}', False, None, None),
    ('{"orderNumber":123}', True, None, None),
    ('{"orderNumber":"a"} junk', True, None, None),
    ('{"totalOrderValue":12.30}', True, Decimal("12.30"), "12.30"),
    ('{"totalOrderValue":null}', True, None, None),
    ("not json", False, None, None),
    ('{"orderNumber":{"x":1}}', False, None, None),
    ('{"orderEmail":["a"]}', False, None, None),
    ('{"orderStatus":true}', True, None, None),
    ('{"orderEmail":"say \\"orderNumber\\":{"}', True, None, None),
    ("{'orderNumber':'a'}", False, None, None),
    ('{"orderNumber":NaN}', False, None, None),
    ('{"totalOrderValue":Infinity}', False, None, None),
    ('{"totalOrderValue":01}', False, None, None),
    ('{"orderNumber":"a",}', False, None, None),
    ('{"orderNumber":"a","orderNumber":"b"}', True, None, None),
    ('{"totalOrderValue":-0.5}', True, Decimal("-0.5"), "-0.5"),
    ('{"totalOrderValue":""}', True, None, None),
    ('{"totalOrderValue":" 5 "}', True, Decimal("5"), "5"),
    ('{"totalOrderValue":1E3}', True, Decimal("1000"), "1E3"),
    ('{"totalOrderValue":1,"totalOrderValue":2}', True, Decimal("2"), "2"),
    ('{"orderEmail":"a"} "orderEmail":{"x":1}', True, None, None),
    ('{"orderEmail":"{a}"}', True, None, None),
    ('{"totalOrderValue":1.0050000}', True, Decimal("1.005"), "1.0050000"),
    # more than the value type holds: not rounded, but listed as unrepresentable
    ('{"totalOrderValue":1.0000001}', False, None, None),
    ('{"totalOrderValue":1e-7}', False, None, None),
    ('{"totalOrderValue":' + "9" * 33 + "}", False, None, None),
]
UNREPRESENTABLE = [c[0] for c in CASES[-3:]]


@pytest.fixture(scope="module")
def decoded(spark):
    raw = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, value string")
    return {r.i: r for r in codec.decode_order_events(raw, keep=("i",)).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_decode_case(decoded, i):
    _, kept, value, value_text = CASES[i]
    assert (i in decoded) == kept
    if kept:
        assert decoded[i].total_order_value == value
        assert decoded[i].value_text == value_text


def test_unrepresentable_numbers_are_listed(spark):
    raw = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, value string")
    rows = codec.unrepresentable_events(raw, keep=("i",)).collect()
    assert sorted(CASES[r.i][0] for r in rows) == sorted(UNREPRESENTABLE)
    assert {r.reason for r in rows} == {"value beyond decimal(38,6)"}


def test_encoded_value_is_exact_and_plain(spark):
    values = ["1.005", "5", "0", "100.10", "-0.5", "12345678901234567890.000001"]
    ev = spark.createDataFrame([("n", None, "s", Decimal(v)) for v in values],
                               "order_number string, order_email string, order_status string, "
                               "total_order_value decimal(38,6)")
    got = [r.value.split(":")[-1][:-1] for r in codec.encode_order_events(ev).collect()]
    assert got == ["1.005", "5", "0", "100.1", "-0.5", "12345678901234567890.000001"]
    assert codec.encode_order_events(ev, value_scale=2).first().value.endswith('"totalOrderValue":1.01}')


def test_repeated_field_last_wins(decoded):
    i = [c[0] for c in CASES].index('{"orderNumber":"a","orderNumber":"b"}')
    assert decoded[i].order_number == "b"


def test_integer_in_text_field_kept_as_text(decoded):
    i = [c[0] for c in CASES].index('{"orderNumber":123}')
    assert decoded[i].order_number == "123"


def test_json_quote_escapes(spark):
    df = spark.createDataFrame([('say "hi"\\',), (None,)], "s string")
    got = [r.q for r in df.select(codec.json_quote(F.col("s")).alias("q")).collect()]
    assert got == ['"say \\"hi\\"\\\\"', "null"]


def test_encode_decode_round_trip(spark):
    events = spark.createDataFrame(
        [("n1", "a@example.com", "CONFIRMED", Decimal("41000.50")),
         ("n2", None, "FAILED", Decimal("0")), (None, "x", "FAILED", Decimal("1"))],
        "order_number string, order_email string, order_status string, "
        "total_order_value decimal(38,6)")
    enc = codec.encode_order_events(events)
    assert enc.count() == 2  # no order number → no record
    dec = codec.decode_order_events(enc, "value")
    got = sorted((r.order_number, r.order_email, r.order_status, r.total_order_value)
                 for r in dec.collect())
    assert got == [("n1", "a@example.com", "CONFIRMED", Decimal("41000.5")),
                   ("n2", None, "FAILED", Decimal("0"))]


def test_event_text_and_processed(spark):
    ev = spark.createDataFrame([("7", "a@x", "CONFIRMED", Decimal("41000"))],
                               "order_number string, order_email string, order_status string, "
                               "total_order_value decimal(18,0)")
    r = ev.select(text.processing_line().alias("p"), text.processed_message().alias("m"),
                  text.notification_line().alias("n")).first()
    body = "OrderEvent(orderNumber=7, orderEmail=a@x, orderStatus=CONFIRMED, totalOrderValue=41000)"
    assert r.p == body + " PROCESSING"
    assert r.m == '"OrderEvent(7) PROCESSED"'
    assert r.n == "Received Notification for Order - " + body


def test_arrival_stamp_shift(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07.179575",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("arrival"))
    ts, instant = text.stamp_arrival("arrival")
    r = df.select(ts, F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSS").alias("i")).first()
    assert r.timestamp == 1704067207179
    assert r.i == "2024-01-01 05:30:07.179"


def test_timed_event_text_instant_forms(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:07",), ("2024-01-01 00:00:07.05",)],
                               "t string").select(F.col("t").cast("timestamp_ntz").alias("arrival"))
    ts, instant = text.stamp_arrival("arrival")
    ev = df.select(F.lit("7").alias("order_number"), F.lit("a@x").alias("order_email"),
                   F.lit("FAILED").alias("order_status"), F.lit("0").alias("total_order_value"),
                   ts, instant)
    got = [r.l for r in ev.select(text.timed_event_text(F.col("timestamp"), F.col("instant"))
                                  .alias("l")).collect()]
    assert got == [
        "TimedOrderEvent(orderNumber=7, orderEmail=a@x, orderStatus=FAILED, totalOrderValue=0, "
        "timestamp=1704067207000, instant=2024-01-01T05:30:07Z)",
        "TimedOrderEvent(orderNumber=7, orderEmail=a@x, orderStatus=FAILED, totalOrderValue=0, "
        "timestamp=1704067207050, instant=2024-01-01T05:30:07.050Z)"]
