"""Order-request sources (S3) and the inventory seed.

Requests arrive nested — an e-mail plus an array of lines — as JSON lines or
parquet with ``schemas.ORDER_REQUEST``. ``operators.placement.
explode_request_lines`` flattens them; everything downstream works on flat
lines, so the driver-table adapters in ``sources.fixtures`` feed the same
pipeline without ever building arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.functions.codec import fits_exactly, is_number, without_blanks
from ledgerlane.schemas import INVENTORY, ORDER_REQUEST, ORDER_REQUEST_WIRE, PRICE

# The stock service's seed rows (sku → quantity).
INVENTORY_SEED = [("iphone_13", 10), ("iphone_14", 0), ("iphone_15", 5)]


# A bare price; a parser would hand it on by way of a double. In JSON, an unescaped name with a colon behind
# it is a field's name and never part of a text.
_BARE_PRICE = r'("price"\s*:\s*)(-?[0-9][-+0-9.eE]*)'
# A price as nearly all are written: nothing around it, and no more digits than ``schemas.PRICE`` holds.
_PLAIN_PRICE = rf"^-?[0-9]{{1,{PRICE.precision - PRICE.scale}}}([.][0-9]{{1,{PRICE.scale}}})?\z"
PRICE_BEYOND, PRICE_NO_NUMBER = "price beyond " + PRICE.simpleString(), "price is no number"


def parse_order_requests(raw: DataFrame, value_col: str = "value", key: Column | None = None) -> DataFrame:
    """Requests in their JSON wire form → (order_key, order_email, items). A record has no id of
    its own: ``key``, by default a hash of its text, must be the same on a replay. Text that is no
    request gives a request without a list, which ``quarantine_nested_requests`` lists.

    Prices are read as written: bare numbers are quoted ahead of the parse. ``price`` holds those that
    ``schemas.PRICE`` holds exactly; ``price_text`` keeps every one, and ``unrepresentable_prices`` lists the
    rest. None is rounded."""
    value = F.col(value_col).cast("string")
    quoted = F.regexp_replace(value, _BARE_PRICE, '$1"$2"')
    parsed = F.from_json(quoted, ORDER_REQUEST_WIRE, {"allowSingleQuotes": "false"})
    key = F.xxhash64(value) if key is None else key
    return raw.select(key.alias("order_key"), parsed.alias("r")).select(
        "order_key", F.col("r.orderEmail").alias("order_email"),
        F.transform("r.orderLineItemsDtoList", _parsed_line).alias("items"))


def _parsed_line(i: Column) -> Column:
    def line(price: Column, price_text: Column) -> Column:
        return F.struct(i["id"].alias("id"), i["skuCode"].alias("sku_code"), price.alias("price"),
                        i["quantity"].alias("quantity"), price_text.alias("price_text"))

    written = i["price"]
    # Plain prices are told by one pattern; the rest takes a dozen, each of them on a token of its own making.
    return F.when(written.rlike(_PLAIN_PRICE), line(written.try_cast(PRICE), written)).otherwise(
        line(_exact_price(written), without_blanks(written)))


def _exact_price(written: Column) -> Column:
    token = without_blanks(written)
    return F.when(is_number(token) & fits_exactly(token, PRICE), token.try_cast(PRICE))


def unrepresentable_prices(requests: DataFrame) -> DataFrame:
    """(order_key, position, price_text, reason) of the lines of parsed requests whose price is no number, or
    has more digits than ``schemas.PRICE`` holds exactly."""
    lines = requests.select("order_key", F.posexplode("items").alias("position", "line"))
    written = F.col("line.price_text")
    return lines.filter(written.isNotNull() & F.col("line.price").isNull()).select(
        "order_key", "position", written.alias("price_text"),
        F.when(is_number(written), PRICE_BEYOND).otherwise(PRICE_NO_NUMBER).alias("reason"))


def read_order_requests(spark: SparkSession, path: str, fmt: str = "json",
                        streaming: bool = False) -> DataFrame:
    """``json``: one request per line in its wire form, keyed by a hash of file, block and text place
    where the reader knows them; other formats hold ``schemas.ORDER_REQUEST``."""
    reader = spark.readStream if streaming else spark.read
    if fmt != "json":
        return reader.schema(ORDER_REQUEST).format(fmt).load(path)
    raw = reader.format("text").load(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
    if streaming:
        return parse_order_requests(raw, key=F.xxhash64("file", "value"))
    # Equal lines are requests of their own: number them within file, block and text.
    same = Window.partitionBy("file", "block", "value").orderBy("value")
    numbered = raw.withColumn("n", F.row_number().over(same))
    return parse_order_requests(numbered, key=F.xxhash64("file", "block", "value", "n"))


def render_order_requests(headers: DataFrame) -> DataFrame:
    """Requests (order_key, order_email, items) in their JSON wire form: (order_key, value)."""
    items = F.transform("items", lambda i: F.struct(
        i["id"].alias("id"), i["sku_code"].alias("skuCode"), i["price"].alias("price"),
        i["quantity"].alias("quantity")))
    return headers.select("order_key", F.to_json(F.struct(
        F.col("order_email").alias("orderEmail"), items.alias("orderLineItemsDtoList")),
        {"ignoreNullFields": "false"}).alias("value"))


def request_summary(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per request: header plus its line count (0 for an empty list)."""
    counts = lines.groupBy("order_key").agg(F.count(F.lit(1)).alias("line_count"))
    return (headers.join(counts, "order_key", "left")
                   .withColumn("line_count", F.coalesce("line_count", F.lit(0)).cast("long")))


def inventory_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INVENTORY_SEED, INVENTORY)


def read_inventory(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(INVENTORY).format(fmt).load(path)


def read_inventory_jdbc(spark: SparkSession, url: str, table: str = "inventory",
                        properties: dict | None = None,
                        predicates: list[str] | None = None) -> DataFrame:
    """S2 from the stock service's relational table (columns ``sku_code``,
    ``quantity``; the surrogate id is not read). ``predicates`` — one
    database-side condition per partition, e.g. ranges or ``CRC32(sku_code) %
    8 = i`` — split large tables into parallel reads."""
    props = dict(properties or {})
    if predicates:
        df = spark.read.jdbc(url, table, predicates=predicates, properties=props)
    else:
        df = spark.read.format("jdbc").options(url=url, dbtable=table, **props).load()
    return df.select("sku_code", F.col("quantity").cast("int"))
