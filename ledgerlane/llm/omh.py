"""Order MinHash fingerprints, in DataFrame operations.

The alphabet is words: a text's k-mers are its runs of ``k`` words, numbered by occurrence, so that
a repeated run counts each time. Every (k-mer, occurrence) is hashed once and falls by its hash
into one of ``slots``; each slot keeps the ``tuple_size`` least, puts them back into text order and hashes
that tuple. Two texts agree in a slot where both the least k-mers and their order agree, so
the share of equal slots follows edit distance, not just overlap.

A text of fewer than ``k`` words is one k-mer; white space between words doesn't count; a text
without words has all slots empty, and the like fingerprint of such texts has likeness 1. Slots that are
empty in both texts don't count. Null counts as empty. Equal texts have equal fingerprints.
Positions take 24 bits: beyond 16 million words the order within a slot wraps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import staged, words

K, SLOTS, TUPLE = 2, 32, 2
POSITION = (1 << 24) - 1


def signature(text: Column, k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE) -> Column:
    """array<int> of ``slots`` tuple hashes; 0 marks an empty slot."""
    low = F.lit(POSITION).cast("long")
    high = F.lit(~POSITION).cast("long")

    def placed(w: Column) -> Column:  # k-mer hash above, position below, in hash order
        def one(i: Column) -> Column:
            return F.xxhash64(*[F.get(w, i + d) for d in range(k)]).bitwiseAND(high).bitwiseOR(
                i.cast("long").bitwiseAND(low))

        last = F.greatest(F.size(w) - k, F.lit(0))
        return F.when(F.size(w) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), one))).otherwise(
            F.array().cast("array<bigint>"))

    def hashed(x: Column, occurrence: Column) -> Column:
        return F.xxhash64(x.bitwiseAND(high), occurrence).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low))

    def numbered(s: Column) -> Column:
        """Hash of k-mer and occurrence above, position below; equal k-mers lie side by side."""
        n = F.size(s)
        new = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
            F.get(s, i).bitwiseAND(high) != F.get(s, F.greatest(i - 1, F.lit(0))).bitwiseAND(high)))

        def runs(first: Column) -> Column:
            return F.flatten(F.transform(first, lambda at, j: F.transform(
                F.slice(s, at + 1, F.coalesce(F.get(first, j + 1), n) - at), hashed)))

        repeated = _let(new, lambda first: F.when(F.size(first) == n, F.transform(s, lambda x: hashed(x, F.lit(0))))
                        .otherwise(runs(first)))
        return F.when(n > 0, F.sort_array(repeated)).otherwise(s)

    def tuples(s: Column) -> Column:
        """The hash's top bits are the slot, so a slot's least k-mers are the first of a stretch."""
        bits = slots.bit_length() - 1
        slot = lambda x: F.shiftrightunsigned(x, 64 - bits)
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (
            slot(F.get(s, i)) != slot(F.get(s, F.greatest(i - 1, F.lit(0))))))

        def one(i: Column) -> Column:
            least = F.filter(F.slice(s, i + 1, tuple_size), lambda x: slot(x) == slot(F.get(s, i)))
            in_order = F.sort_array(F.transform(least, lambda x: F.struct(
                x.bitwiseAND(low).alias("at"), x.bitwiseAND(high).alias("h"))))
            whole = F.xxhash64(F.transform(in_order, lambda x: x["h"]))
            return (F.pmod(whole, F.lit((1 << 31) - 1)) + 1).cast("int")

        def spread(f: Column) -> Column:
            places = F.transform(f, lambda i: slot(F.get(s, i)))
            return _let(places, lambda at: _let(F.transform(f, one), lambda hashes: F.transform(
                F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")),
                lambda j: F.coalesce(F.get(hashes, (F.array_position(at, j) - 1).cast("int")), F.lit(0)))))

        return F.when(F.size(s) > 0, _let(first, spread)).otherwise(
            F.array_repeat(F.lit(0), slots))

    if slots < 2 or slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    return _let(words(text), lambda w: _let(placed(w), lambda p: _let(numbered(p), tuples)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(sig: Column) -> Column:
    """The signature as text: eight hexadecimal digits a slot."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that are not empty in both; 1 where all are."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
    return _let(F.array_compact(both), lambda m: F.when(F.size(m) == 0, F.lit(1.0)).otherwise(
        F.aggregate(m, F.lit(0), lambda n, x: n + x) / F.greatest(F.size(m), F.lit(1))))


def range_cell(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by two short searches; -1 for null."""
    if not bounds:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    head = F.size(F.filter(lits([g[0] for g in groups]), lambda b: b <= value)) - 1
    inside = F.size(F.filter(F.get(F.array(*map(lits, groups)), head), lambda b: b <= value))
    return F.when(value.isNull(), F.lit(-1)).when(head < 0, F.lit(0)).otherwise(head * step + inside)


def with_next(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """(doc_id, text, next_text, cell, tie, last): each document beside its successor by id (the first
    after the last; null ids first, rows of one id by text hash).

    Documents are dealt into cells by ranges of their id, of which there are four for each
    shuffle partition; the text moves once. A cell's last row gets the first text of the next cell
    from a table of one row per cell."""
    spark = docs.sparkSession
    cells = cells or 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 20 * cells)).first()[0]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"),
                       range_cell(F.col("doc_id"), sorted(set(cuts or []))).alias("cell"))
    heads = staged(rows.groupBy("cell").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
                   .select(F.col("cell").alias("c"), F.col("head.doc_id").alias("d"), F.col("head.tie").alias("t")), "heads")
    texts = (rows.join(heads, (rows["cell"] == heads["c"]) & rows["doc_id"].eqNullSafe(heads["d"])
                       & (rows["tie"] == heads["t"])).select("cell", "text").dropDuplicates(["cell"]))
    order, every = Window.orderBy("cell"), Window.partitionBy()
    after = F.coalesce(F.lead(F.struct("text")).over(order),
                       F.min_by(F.struct("text"), "cell").over(every))
    firsts = staged(texts.select(F.col("cell").alias("c"), after["text"].alias("after")), "firsts")
    own = Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    led = rows.withColumns({"next_text": F.lead("text").over(own), "last": F.lead(F.lit(1)).over(own).isNull()})
    joined = led.join(firsts, (F.col("cell") == F.col("c")) & F.col("last"), "left")
    return joined.select("doc_id", "text", "tie", "cell", "last",
                         F.when(F.col("last"), F.col("after")).otherwise(F.col("next_text")).alias("next_text"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by the
    beginning of the next document, and the likeness to that and to the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = with_next(rows).select("doc_id", "tie", "cell", n.cast("long").alias("n_chars"),
                                  signature(F.col("text")).alias("sig"), edited.alias("edited"),
                                  F.when(F.col("last"), signature(F.col("next_text"))).alias("after"))
    own = Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.select("doc_id", "n_chars", "sig", signature(F.col("edited")).alias("edited_sig"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       F.coalesce("after", F.lead("sig").over(own)).alias("next_sig"))
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sig")).alias("fingerprint"),
                       fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                       likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
