"""Property tests (hypothesis): codec round trip and placement against a
direct model of the documented placement semantics."""

from collections import Counter
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlane.functions import codec
from ledgerlane.operators import placement

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))

TEXT = st.one_of(st.none(), st.text(alphabet=st.characters(blacklist_categories=("Cs",)),
                                    max_size=12))
VALUE = st.one_of(st.none(), st.decimals(min_value=-10**9, max_value=10**9, places=2,
                                         allow_nan=False, allow_infinity=False))


@SETTINGS
@given(st.lists(st.tuples(TEXT, TEXT, TEXT, VALUE), min_size=1, max_size=25))
def test_decode_of_encode_is_identity(spark, events):
    df = spark.createDataFrame(events, "order_number string, order_email string, "
                               "order_status string, total_order_value decimal(38,6)")
    back = codec.decode_order_events(codec.encode_order_events(df), "value")
    got = [(r.order_number, r.order_email, r.order_status, r.total_order_value)
           for r in back.collect()]
    want = [(n, e, s, v) for n, e, s, v in events if n is not None]

    def norm(rows):
        return Counter((n, e, s, None if v is None else Decimal(v).normalize())
                       for n, e, s, v in rows)
    assert norm(got) == norm(want)


def model_decision(lines, stock):
    """Placement of one request as documented: drop lines with quantity ≤ 0;
    one stock answer per remaining line (unknown SKU → not in stock, known →
    quantity > 0); every in-stock answer adds price × quantity of every line
    with its SKU; confirmed iff all answers are in stock and the total > 0."""
    kept = [(sku, q, p) for sku, q, p in lines if q > 0]
    answers = [(sku, stock.get(sku, 0) > 0 if sku in stock else False) for sku, _, _ in kept]
    total = Decimal(0)
    for sku, ok in answers:
        if ok:
            total += sum((p * q for s2, q, p in kept if s2 == sku), Decimal(0))
    if all(ok for _, ok in answers) and total > 0:
        return "CONFIRMED", total
    return "FAILED", Decimal(0)


SKUS = ["a", "b", "c", "d"]
LINE = st.tuples(st.sampled_from(SKUS), st.integers(-2, 3),
                 st.sampled_from([Decimal("0"), Decimal("1.50"), Decimal("10"), Decimal("99.99")]))


@SETTINGS
@given(requests=st.lists(st.lists(LINE, max_size=5), min_size=1, max_size=12),
       stock=st.dictionaries(st.sampled_from(SKUS[:3]), st.integers(0, 2)))
def test_placement_matches_model(spark, requests, stock):
    headers = spark.createDataFrame([(k, None, f"u{k}@example.com") for k in range(len(requests))],
                                    "order_key long, order_number string, order_email string")
    rows = [(k, i, sku, p, q) for k, lines in enumerate(requests)
            for i, (sku, q, p) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "order_key long, id long, sku_code string, "
                                  "price decimal(18,2), quantity int")
    inv = spark.createDataFrame(sorted(stock.items()), "sku_code string, quantity int")
    got = {r.order_key: (r.order_status, r.total_order_value)
           for r in placement.placement_decisions(headers, lines, inv).collect()}
    for k, req in enumerate(requests):
        status, total = model_decision(req, stock)
        assert got[k] == (status, total), (req, stock, got[k])
