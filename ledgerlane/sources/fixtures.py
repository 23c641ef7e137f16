"""Adapters from the driver's star-schema tables to the order-event domain.

Every adapter is a pure projection/filter over one parquet table, so Catalyst
prunes columns and pushes predicates into the scan, and the work grows with
the table.

* ``order_events``   ← events   (one order event per event row)
* ``request_headers``← orders   (one placement request per order)
* ``request_lines``  ← lineitem (flat request lines; ``quantity`` may be ≤ 0)
* ``inventory``      ← part     (``p_size % 10`` puts some SKUs at zero stock;
  a share of the request lines asks for SKUs that no part has)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions.ids import order_number_for_key
from ledgerlane.schemas import CONFIRMED, FAILED
from ledgerlane.session import read_table

# Fixed values of the adapters (see FIXTURES.md §3).
FAILED_EVENT_TYPE = "error"
QUANTITY_SHIFT = 5          # request quantity = l_quantity - 5, so some lines are <= 0
UNKNOWN_SKU_MODULUS = 50    # lines with (7 * l_orderkey + l_linenumber) % 50 = 0 ask for 'x' || l_partkey
STOCK_MODULUS = 10          # stock = p_size % 10


def _email(id_col: Column) -> Column:
    return F.concat(F.lit("user"), id_col.cast("string"), F.lit("@example.com"))


def to_order_events(ev: DataFrame) -> DataFrame:
    """events rows (batch or streaming) → (event_id, order_number, order_email,
    order_status, total_order_value, arrival).

    FAILED iff the event is an error or its value rounds to 0.00; a FAILED
    event carries value 0, as in the source system. ``arrival`` is the event
    time; ``event_id`` breaks ties in arrival order.
    """
    failed = (F.col("event_type") == FAILED_EVENT_TYPE) | (F.round("value", 2) == 0)
    return ev.select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("order_number"),
        _email(F.col("user_id")).alias("order_email"),
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(CONFIRMED)).alias("order_status"),
        F.when(failed, F.lit(0)).otherwise(F.col("value")).cast("decimal(18,2)")
         .alias("total_order_value"),
        F.col("ts").alias("arrival"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as order events (see ``to_order_events``)."""
    return to_order_events(read_table(spark, sf_dir, "events"))


def request_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → one placement request per order: (order_key, order_number, order_email)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_key"),
        order_number_for_key(F.col("o_orderkey")).alias("order_number"),
        _email(F.col("o_custkey")).alias("order_email"),
    )


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem → flat request lines (order_key, id, sku_code, price, quantity)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("long").alias("id"),
        F.when((7 * F.col("l_orderkey") + F.col("l_linenumber")) % UNKNOWN_SKU_MODULUS == 0,
               F.concat(F.lit("x"), F.col("l_partkey").cast("string")))
         .otherwise(F.col("l_partkey").cast("string")).alias("sku_code"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        (F.col("l_quantity").cast("int") - F.lit(QUANTITY_SHIFT)).alias("quantity"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → inventory (sku_code, quantity)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("sku_code"),
                    (F.col("p_size") % STOCK_MODULUS).cast("int").alias("quantity"))


def nested_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → one nested request per order (order_key, order_email, items): ``o_orderkey % 5``
    lines, so that some lists are empty, and no list at all where ``o_orderkey % 11 = 0``."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    items = F.transform(F.sequence(F.lit(0).cast("long"), key % 5), lambda i: F.struct(
        i.alias("id"), F.concat(F.lit("sku"), ((key * 3 + i) % 1000).cast("string")).alias("sku_code"),
        ((key % 1000 + i) / 100).cast("decimal(18,6)").alias("price"),
        ((key + i) % 4 - 1).cast("int").alias("quantity")))
    return o.select(key.alias("order_key"), _email(F.col("o_custkey")).alias("order_email"),
                    F.when(key % 11 != 0, F.slice(items, F.lit(2), (key % 5).cast("int"))).alias("items"))


def placed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_headers`` and ``request_lines`` as nested requests, lines in the order of their id."""
    line = F.struct("id", "sku_code", F.col("price").cast("decimal(26,6)").alias("price"), "quantity")
    items = request_lines(spark, sf_dir).groupBy("order_key").agg(F.sort_array(F.collect_list(line)).alias("items"))
    none = F.array().cast(items.schema["items"].dataType)
    return (request_headers(spark, sf_dir).join(items, "order_key", "left")
            .select("order_key", "order_email", F.coalesce("items", none).alias("items")))


def restocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state of ``inventory``: every quantity is another one."""
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("sku_code"),
                    ((F.col("p_size") + 1) % STOCK_MODULUS).cast("int").alias("quantity"))


# What order_key % 10 gives the price of a request's second line.
PRICE_TOKENS = ["7.25", "1.0000005", "12345678901234.5", "1E3", '"8.50"', "1.5000000", "123456789012345678901.5",
                '"abc"', '" 12.000001 "', "12300000000000000000000E-9"]


def price_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → (order_key, value): requests in their wire form with two lines, the second one's price written
    in the way of ``PRICE_TOKENS`` that the key picks."""
    o = read_table(spark, sf_dir, "orders")
    token = F.get(F.array(*[F.lit(t) for t in PRICE_TOKENS]), (F.col("o_orderkey") % len(PRICE_TOKENS)).cast("int"))
    first = F.concat(F.lit('{"id":1,"skuCode":"price","price":'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
                     F.lit(',"quantity":1}'))
    second = F.concat(F.lit(',{"skuCode":"a\\"price\\": 5","id":2,"quantity":2,"price" : '), token, F.lit("}"))
    return o.select(F.col("o_orderkey").alias("order_key"), F.concat(
        F.lit('{"orderEmail":"p@example.com","orderLineItemsDtoList":['), first, second, F.lit("]}")).alias("value"))


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request_lines`` with every line kept and nulls in a share of them: the quantity where
    ``order_key % 97 = 0``, the SKU where ``% 89``, the price where ``% 83``."""
    lines, key = request_lines(spark, sf_dir), F.col("order_key")
    return lines.withColumns({"quantity": F.when(key % 97 != 0, F.col("quantity")),
                              "sku_code": F.when(key % 89 != 0, F.col("sku_code")),
                              "price": F.when(key % 83 != 0, F.col("price"))})


def damaged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_events`` with every event kept and nulls in a share of them: the number where
    ``event_id % 97 = 0``, the status where ``% 89``, the value where ``% 83``."""
    events, key = order_events(spark, sf_dir), F.col("event_id")
    return events.withColumns({"order_number": F.when(key % 97 != 0, F.col("order_number")),
                               "order_status": F.when(key % 89 != 0, F.col("order_status")),
                               "total_order_value": F.when(key % 83 != 0, F.col("total_order_value"))})
