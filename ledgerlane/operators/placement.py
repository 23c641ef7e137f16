"""Order placement as one DataFrame plan.

The source service handles one request at a time: unnest the lines, drop
lines with quantity ≤ 0, ask the stock service about every remaining SKU
(a remote call), add up price × quantity over in-stock answers, and confirm
the order iff every answer is in stock and the total is positive. Here the
remote call becomes a join and the whole batch of requests is decided at once:

    lines → filter(q > 0) → groupBy(order, sku) → ⋈ stock → groupBy(order)
          → ⟕ headers → decision

Lines are dealt by (order, SKU) before they are summed up: nearly every pair
has one line, so partial sums ahead of that shuffle would only fill the map
tasks' memory. A hot order or SKU is spread over all its pairs, and the sum per
order runs partial (map-side) first. The planner picks the stock join from the
tables' sizes and AQE splits skewed partitions of joins; there is no hint.

The duplicate-SKU rule (R3): the source service joins every in-stock answer
with every line of the same SKU, so a SKU on k lines counts k times. With
n = lines and s = Σ price × quantity per (order, SKU) the faithful total is
Σ n·s over in-stock SKUs; ``dedupe_answers=True`` gives the plain Σ s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.ids import order_number_for_key
from ledgerlane.schemas import CONFIRMED, FAILED
from ledgerlane.session import cores, partitions_for
from ledgerlane.sources.requests import unrepresentable_prices

TOTAL_TYPE = "decimal(38,6)"

#: Lines are summed up per order and SKU in partitions of this many bytes as the planner expects them (of packed
#: tables, about 200,000 lines), so that a task's table of sums stays the same size however many lines there are.
LINE_PARTITION_BYTES = 1 << 20


# ---------------------------------------------------------------- lines

def explode_request_lines(requests: DataFrame) -> DataFrame:
    """Nested requests (order_key, order_email, items[]) → one row per line;
    keeps sku, price, quantity (the client's line id is dropped)."""
    return (requests.select("order_key", F.explode("items").alias("line"))
                    .select("order_key", "line.sku_code", "line.price", "line.quantity"))


def explode_request_positions(requests: DataFrame) -> DataFrame:
    """E1 with each line's place in its request, from 0."""
    return (requests.select("order_key", F.posexplode("items").alias("position", "line"))
                    .select("order_key", "position", "line.sku_code", "line.price", "line.quantity"))


def valid_lines(lines: DataFrame) -> DataFrame:
    """Keep lines with quantity > 0. Runs before the stock check, so a
    dropped line can never fail its order."""
    return lines.filter(F.col("quantity") > 0)


def line_values(lines: DataFrame) -> DataFrame:
    """Exact decimal line value price × quantity."""
    return lines.withColumn("line_value", F.col("price") * F.col("quantity"))


# ---------------------------------------------------------------- stock

def stock_table(inventory: DataFrame) -> DataFrame:
    """(sku_code, in_stock, duplicated), one row per SKU: a known SKU is in
    stock iff its quantity > 0; the requested quantity is not compared and
    stock is never decremented. A SKU stored twice is flagged: the source
    service raises for any request that asks for it (see
    ``placement_decisions``), and one row per SKU keeps the join from
    counting lines twice."""
    return (inventory.groupBy("sku_code")
                     .agg((F.max("quantity") > 0).alias("in_stock"),
                          (F.count(F.lit(1)) > 1).alias("duplicated")))


def _answer() -> Column:
    """Stock answer of a line joined with ``stock_table``; a duplicated SKU raises."""
    conflict = F.when(F.coalesce("duplicated", F.lit(False)), F.raise_error(
        F.concat(F.lit("duplicate SKU in inventory: "), F.col("sku_code"))))
    return F.coalesce(conflict.cast("boolean"), F.col("in_stock"), F.lit(False))


def requested_skus(lines: DataFrame) -> DataFrame:
    """Distinct SKUs of the given lines (partial aggregation before the shuffle)."""
    return lines.select("sku_code").distinct()


def inventory_in_list(inventory: DataFrame, skus: DataFrame) -> DataFrame:
    """Inventory rows whose SKU is in a list; the list is a table."""
    return inventory.join(skus, "sku_code", "left_semi")


def sku_exists(skus: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per SKU, whether any inventory row has it, regardless of quantity."""
    known = inventory.select("sku_code").distinct().withColumn("_known", F.lit(True))
    return (skus.join(known, "sku_code", "left")
                .select("sku_code", F.coalesce("_known", F.lit(False)).alias("sku_exists")))


def sku_lookup(skus: DataFrame, inventory: DataFrame) -> DataFrame:
    """P5: the inventory row of each requested SKU that exists. A SKU stored
    twice is an error in the source system; the query raises it."""
    per_sku = inventory.groupBy("sku_code").agg(F.count(F.lit(1)).alias("_rows"),
                                                F.max("quantity").alias("_q"))
    checked = F.when(F.col("_rows") > 1,
                     F.raise_error(F.concat(F.lit("duplicate SKU in inventory: "),
                                            F.col("sku_code"))))
    return (skus.join(per_sku, "sku_code", "inner")
                .select("sku_code", F.coalesce(checked.cast("int"), F.col("_q")).alias("quantity")))


def stock_answer_lists(headers: DataFrame, lines: DataFrame, inventory: DataFrame, position: str = "position",
                       part_lines: int = 10_000) -> DataFrame:
    """J1 as the stock service answers: per request (order_key of ``headers``) its answers (sku_code, in_stock) in the
    order of the requested lines, duplicates kept; a request without lines gets an empty list. A request of more
    than ``part_lines`` positions is answered in parts, numbered from 0 in the same order, so that none has to fit
    one task; ``lines`` are the valid lines with their ``position`` (from ``explode_request_positions``)."""
    answered = lines.join(stock_table(inventory), "sku_code", "left").select(
        "order_key", F.floor(F.col(position) / F.lit(part_lines)).alias("part"),
        F.struct(F.col(position).alias("position"), "sku_code", _answer().alias("in_stock")).alias("answer"))
    parts = answered.groupBy("order_key", "part").agg(F.sort_array(F.collect_list("answer")).alias("answers"))
    lists = F.transform("answers", lambda a: F.struct(a["sku_code"].alias("sku_code"), a["in_stock"].alias("in_stock")))
    none = F.array().cast("array<struct<sku_code:string,in_stock:boolean>>")
    return (headers.select("order_key").join(parts.select("order_key", "part", lists.alias("answers")), "order_key", "left")
            .select("order_key", F.coalesce("part", F.lit(0).cast("long")).alias("part"),
                    F.coalesce("answers", none).alias("answers")))


def stock_answers(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """One answer per requested line, duplicates kept; unknown SKU → not
    in stock. A requested SKU stored twice raises, as the lookup (P5) does;
    ``inventory_conflicts`` lists the requests it would hit."""
    return (lines.join(stock_table(inventory), "sku_code", "left")
                 .select("order_key", "id", "sku_code", _answer().alias("in_stock")))


# ---------------------------------------------------------------- totals

def order_totals(lines: DataFrame, inventory: DataFrame, dedupe_answers: bool = False) -> DataFrame:
    """Per order with at least one valid line: ``total_value`` (J2 + A4) and
    ``all_in_stock`` (A5). ``lines`` must already be the valid lines."""
    dealt = lines.repartition(partitions_for(lines, LINE_PARTITION_BYTES, least=cores(lines.sparkSession)),
                              "order_key", "sku_code")
    per_sku = (dealt.groupBy("order_key", "sku_code")
                    .agg(F.count(F.lit(1)).alias("n"),
                         F.sum(F.col("price") * F.col("quantity")).alias("s")))
    answered = (per_sku.join(stock_table(inventory), "sku_code", "left")
                       .withColumn("in_stock", F.coalesce("in_stock", F.lit(False))))
    weight = F.col("s") if dedupe_answers else F.col("n") * F.col("s")
    contribution = F.when(F.col("in_stock"), weight).otherwise(F.lit(0))
    return (answered.groupBy("order_key")
                    .agg(F.sum(contribution).cast(TOTAL_TYPE).alias("total_value"),
                         F.bool_and("in_stock").alias("all_in_stock"),
                         F.coalesce(F.bool_or("duplicated"), F.lit(False))
                          .alias("asks_duplicated_sku")))


# ---------------------------------------------------------------- decision

def placement_decisions(headers: DataFrame, lines: DataFrame, inventory: DataFrame,
                        dedupe_answers: bool = False,
                        exclude: DataFrame | None = None) -> DataFrame:
    """E4 for every request: CONFIRMED with its total iff all answers are in
    stock and the total is > 0; else FAILED with 0. A request without valid
    lines has no answers (all-in-stock is vacuously true) and total 0, so it
    fails, as in the source system.

    ``exclude`` (order_key, …) lists requests that raise in the source system
    before any event (see ``quarantine_requests``); they get no decision. A
    request asking for a SKU stored twice in the inventory raises there too
    and gets no decision (``inventory_conflicts`` lists them).
    """
    totals = order_totals(valid_lines(lines), inventory, dedupe_answers)
    if exclude is not None:
        headers = headers.join(exclude.select("order_key"), "order_key", "left_anti")
    d = (headers.join(totals, "order_key", "left")
                .filter(~F.coalesce(F.col("asks_duplicated_sku"), F.lit(False))))
    total = F.coalesce(F.col("total_value"), F.lit(0).cast(TOTAL_TYPE))
    confirmed = F.coalesce(F.col("all_in_stock"), F.lit(True)) & (total > 0)
    return d.select(
        "order_key",
        F.coalesce(F.col("order_number"), order_number_for_key(F.col("order_key")))
         .alias("order_number"),
        "order_email",
        F.when(confirmed, F.lit(CONFIRMED)).otherwise(F.lit(FAILED)).alias("order_status"),
        F.when(confirmed, total).otherwise(F.lit(0).cast(TOTAL_TYPE)).alias("total_order_value"))


def confirmed_orders(decisions: DataFrame) -> DataFrame:
    """K4 header table: only CONFIRMED orders are stored."""
    return (decisions.filter(F.col("order_status") == CONFIRMED)
                     .select("order_key", "order_number", "order_email", "total_order_value"))


def confirmed_order_lines(decisions: DataFrame, lines: DataFrame) -> DataFrame:
    """K4 line table: the valid lines of CONFIRMED orders, keyed by the number of their decision."""
    confirmed = decisions.filter(F.col("order_status") == CONFIRMED).select("order_key", "order_number")
    return (valid_lines(lines).join(confirmed, "order_key")
                              .select("order_number", "sku_code", "price", "quantity"))


def inventory_conflicts(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requests that ask for a SKU stored more than once in the inventory."""
    stored_twice = stock_table(inventory).filter("duplicated")
    return (valid_lines(lines).join(stored_twice, "sku_code", "left_semi").select("order_key").distinct()
            .withColumn("reason", F.lit("duplicate SKU in inventory")))


def quarantine_nested_requests(requests: DataFrame) -> DataFrame:
    """R2 for nested input: a request without a line list raises before any event; so does one of
    which a price can't be read, and one whose price can't be held exactly gets no decision (R1)."""
    bad = requests.filter(F.col("items").isNull()).select("order_key", F.lit("null line list").alias("reason"))
    if "price_text" in requests.schema["items"].dataType.elementType.names:
        bad = bad.unionByName(unrepresentable_prices(requests).groupBy("order_key").agg(F.min("reason").alias("reason")))
    return bad


def quarantine_requests(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """R2: requests the source service would reject with an exception: a null quantity, a null
    SKU on a line that survives the filter, or a null price on a line whose SKU is in stock
    (the price of other lines is never touched: such a request fails, it does not raise)."""
    early = (F.when(F.col("quantity").isNull(), F.lit("null quantity"))
              .when((F.col("quantity") > 0) & F.col("sku_code").isNull(), F.lit("null sku")))
    raised = lines.select("order_key", early.alias("reason")).filter(F.col("reason").isNotNull())
    unpriced = (lines.filter((F.col("quantity") > 0) & F.col("price").isNull())
                     .join(stock_table(inventory).filter("in_stock"), "sku_code", "left_semi")
                     .select("order_key", F.lit("null price").alias("reason")))
    return raised.unionByName(unpriced).groupBy("order_key").agg(F.min("reason").alias("reason"))


def raising_requests(requests: DataFrame, lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """(order_key, reason) of all nested requests that get no decision, one reason each: what can't be read
    at all comes first."""
    found = [quarantine_nested_requests(requests), quarantine_requests(lines, inventory),
             inventory_conflicts(lines, inventory)]
    rows = None
    for k, part in enumerate(found):
        part = part.select("order_key", F.struct(F.lit(k).alias("rank"), "reason").alias("first"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("order_key").agg(F.min("first").alias("first")).select("order_key", "first.reason")
