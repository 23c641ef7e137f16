"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

A source's target is its share of the budget by weight, at most ``cap`` times its own words;
what is cut off goes to the others by weight, until none is above (water filling). Each
document of a source is due ``target / source words`` copies. The whole part is taken as it is;
the fractional parts are rounded together: two documents at a time, words move from the one to
the other, in a direction drawn so that each one's expectation holds, until one of them is
a whole copy or none. Blocks of ``fan`` documents settle all but one each, blocks of such
residuals the next level, up to one residual per source, which rounds to the nearer side.
So a source's words miss its target by half a document at most.

Equal rows (id, source, size) are one unit with a count, of which whole copies are dealt
first; a block therefore never depends on one key's rows. Blocks are drawn by hash: reruns
agree. Null ids, texts (size 0) and sources (last) are values like others. A text without
words takes none. An empty table gives no rows. Extra columns are ignored by ``plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import fresh, staged, words

SEED = 20


def _unit(*parts: Column) -> Column:
    """Draw from [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / float(1 << 52)


def source_targets(units: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """Per source: its place by code point (null last), words, units and target. One row
    per source meets in the windows."""
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                       F.count(F.lit(1)).alias("units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    whole = Window.orderBy(F.col("top") / F.col("weight"), "place")
    before, every = whole.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "all": F.sum("source_size").over(every) * F.lit(float(budget)), "all_w": F.sum("weight").over(every),
        "gone": F.coalesce(F.sum("top").over(before), F.lit(0.0)),
        "gone_w": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    full = F.col("top") <= (F.col("all") - F.col("gone")) * F.col("weight") / (F.col("all_w") - F.col("gone_w"))
    rows = rows.withColumn("full", full)
    taken, taken_w = (F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(every) for c in ("top", "weight"))
    rows = rows.withColumns({"taken": taken, "taken_w": taken_w})
    target = F.when(F.col("full"), F.col("top")).otherwise(
        (F.col("all") - F.col("taken")) * F.col("weight")
        / F.greatest(F.col("all_w") - F.col("taken_w"), F.lit(1e-300)))
    return rows.select("source", "place", "source_size", "units", target.alias("target"))


def _pivot(items: Column) -> Column:
    """Settle a block: (i: the residual, done: the others with up 1 or 0)."""

    def step(s: Column, j: Column) -> Column:
        i = s["i"]
        rise, fall = F.least(i["size"] - i["mass"], j["mass"]), F.least(i["mass"], j["size"] - j["mass"])
        up = _unit(i["key"], j["key"]) * (rise + fall) < fall
        first = F.when(up, i["size"] - i["mass"] <= j["mass"]).otherwise(i["mass"] <= j["size"] - j["mass"])
        out = F.when(first, i).otherwise(j)
        left = F.when(first, j).otherwise(i)
        mass = F.when(first, F.when(up, j["mass"] - rise).otherwise(j["mass"] + fall)).otherwise(
            F.when(up, i["mass"] + rise).otherwise(i["mass"] - fall))
        rest = F.struct(left["size"].alias("size"), left["key"].alias("key"), left["doc_id"].alias("doc_id"),
                        mass.alias("mass"))
        settled = F.struct(out["doc_id"].alias("doc_id"), out["size"].alias("size"),
                           (up == first).cast("int").alias("up"))
        return F.struct(rest.alias("i"), F.concat(s["done"], F.array(settled)).alias("done"))

    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,up:int>>")
    return F.aggregate(F.slice(items, 2, F.size(items)),
                       F.struct(items[0].alias("i"), none.alias("done")), step)


def _settle(rows: DataFrame, label: str) -> DataFrame:
    """One level: blocks (place, block) of ``item``, largest first, to residuals and settled units."""
    item = "struct<size:bigint,key:bigint,doc_id:bigint,mass:double>"
    block = rows.groupBy("place", "block").agg(
        F.sort_array(F.collect_list(F.col("item").cast(item)), asc=False).alias("items"))
    out = block.select("place", "block", _pivot(F.col("items")).alias("s"))
    return staged(out.select("place", "block", F.col("s.i").alias("i"), F.col("s.done").alias("done")), label)


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0,
         fan: int = 64, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """Per unit (doc_id, source, size), with the number of its rows ``n``: source_size, target,
    ``base`` copies of each row, and ``extra``: how many of its rows get one more."""
    units = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                               F.size(words(F.col(text_col))).cast("long").alias("size"))
                   .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "units")
    sources = staged(source_targets(units, weights, budget, cap), "sources")
    due = units.join(sources, units["source"].eqNullSafe(sources["source"])).select(
        units["doc_id"], units["source"], "size", "n", "place", "units", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.greatest("source_size", F.lit(1)))
        .otherwise(0.0).alias("rate"))
    due = due.withColumn("base", F.floor("rate"))
    due = due.withColumn("part", (F.col("rate") - F.col("base")) * F.col("n"))
    due = due.withColumn("whole", F.floor("part")).withColumn("part", F.col("part") - F.col("whole"))
    open_ = due.filter("size > 0 and part > 0").select(
        "place", F.xxhash64(F.lit(SEED), "place", "doc_id", "size").alias("key"),
        "units", "doc_id", "size", "part")
    rows = open_.select(
        "place", F.pmod(F.col("key"), F.ceil(F.col("units") / fan)).alias("block"),
        F.struct("size", "key", "doc_id", (F.col("part") * F.col("size")).alias("mass")).alias("item"))
    blocks = math.ceil((sources.agg(F.max("units")).first()[0] or 0) / fan)
    settled, level = [], _settle(rows, "level")
    while True:
        settled.append(level.select("place", F.explode("done").alias("u")).select("place", "u.*"))
        if blocks <= 1:
            break
        blocks = math.ceil(blocks / fan)
        level = _settle(level.select("place", F.floor(F.col("block") / fan).alias("block"),
                                     F.col("i").alias("item")), "level")
    last = level.select("place", "i.doc_id", "i.size",
                        (F.col("i.mass") * 2 >= F.col("i.size")).cast("int").alias("up"))
    ups = last
    for part in settled:
        ups = ups.unionByName(part)
    ups = ups.filter("up = 1").select(F.col("place").alias("p"), F.col("doc_id").alias("d"), F.col("size").alias("s"))
    joined = due.join(ups, (due["place"] == ups["p"]) & due["doc_id"].eqNullSafe(ups["d"])
                      & (due["size"] == ups["s"]), "left")
    return joined.select("doc_id", "source", "size", "n", "source_size", "target", "base",
                         (F.col("whole") + F.when(F.col("p").isNotNull(), 1).otherwise(0)).alias("extra"))


def taken_words(units: DataFrame) -> DataFrame:
    """One row per document again: doc_id, size, source_size, target, copies, taken."""
    step = 4096  # rows of a unit are unfolded in short runs
    runs = units.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    rows = runs.withColumn("k", F.explode(F.sequence(
        F.col("run") * step, F.least((F.col("run") + 1) * step, F.col("n")) - 1)))
    copies = (F.col("base") + (F.col("k") < F.col("extra")).cast("long")).alias("copies")
    return rows.select("doc_id", "size", "source_size", "target", copies).withColumn(
        "taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken. Rows that share id,
    source and size are told apart by their number among them."""
    names = {k: options.get(k, v) for k, v in
             (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    size, number, copy = fresh(docs, "mix_size", "mix_number", "mix_copy")
    units = plan(docs, **options).select(F.col("doc_id").alias("u_id"), F.col("source").alias("u_source"),
                                         F.col("size").alias("u_size"), "base", "extra")
    units = units.toDF(*fresh(docs, *units.columns))
    u_id, u_source, u_size, base, extra = units.columns
    sized = docs.withColumn(size, F.size(words(F.col(names["text_col"]))).cast("long"))
    rows = sized.join(units, F.col(names["id_col"]).cast("long").eqNullSafe(F.col(u_id))
                      & F.col(names["source_col"]).eqNullSafe(F.col(u_source)) & (F.col(size) == F.col(u_size)))
    same = Window.partitionBy(u_id, u_source, u_size).orderBy(F.xxhash64(F.col(names["text_col"])))
    copies = F.col(base) + (F.col(number) <= F.col(extra)).cast("long")
    return (rows.withColumn(number, F.row_number().over(same))
            .withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), copies)))
            .filter(F.col(copy) > 0).select(*docs.columns))
