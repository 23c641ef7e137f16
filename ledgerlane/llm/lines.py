"""Line dedup: exact set-similarity join over lines, in DataFrame operations.

A line is the set of its words. Words are ordered by rarity: the count of their hash cell in a table
of ``CELLS`` bytes over all lines, then their hash; any order gives the same result, a good one
fewer pairs. Two lines of Jaccard similarity t share one of their first (1 - t) n + 1 words.

1. Lines of equal sets are one; all but the first occurrence go. That settles lines so short that
   no unequal set reaches the threshold (three words at 0.8).
2. The prefix words, as 32-bit keys, deal the lines into buckets. A key brings all that the filters ask of its
   line, so that the buckets are dealt once a step and never written; ``ROUNDS`` parts of the keys follow each
   other, and the disk holds the shuffled buckets of one.
3. Each line is checked against its bucket's earliest line of equal length first, which settles
   nearly all of a group of alike lines in as many pairs as it has lines.
4. Lines that still have no earlier match are joined with all earlier lines of their buckets under the
   length and the positional filter and a bound from maps of 128 bits, of which each word turns one.
5. The pairs that are left, hardly more than the matches, are verified by the words of their lines. A table of
   ``NEEDED`` bytes, seven bits of each, tells most other lines apart before any text is shuffled.
6. What stays are the first lines of the sets that no earlier one matches, and lines without words: they are
   told to the documents, not the lines that go.

So a line goes if, and only if, an earlier line (by document id, nulls last, then text hash and line number)
has a similarity of at least the threshold. Lines of fewer than ``least`` distinct words stay, like
empty ones; by default (1) all lines that have a word take part. Null texts stay null. Rows of one id are told apart by their text. An empty table
gives no rows. Extra columns are kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import SPACE, dense_array, fresh, passing, staged

CELLS, ROUNDS, NEEDED = 1 << 16, 2, 1 << 16
#: Lines hold few of them, so that most are split at plain blanks.
OTHER_SPACE, HAS_WORD = r"[\x09-\x0D]", r"[^\x20\x09-\x0D]"
WORD = (1 << 56) - 1
THRESHOLD, LEAST = (80, 100), 1
MAPS = ("map", "map_high")


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_hash, line_no, line) of every line."""
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return docs.filter("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("doc_hash"), line)


def _words(line: Column) -> Column:
    """Words of a line, as ``common.words`` has them; a split at one character needs no pattern."""
    parts = F.when(line.rlike(OTHER_SPACE), F.split(line, SPACE)).otherwise(F.split(line, " "))
    return F.array_remove(parts, "")


def _short(line: Column, least: int) -> Column:
    """Whether a line has fewer than ``least`` distinct words, or none."""
    return ~line.rlike(HAS_WORD) if least <= 1 else F.size(F.array_distinct(_words(line))) < least


def _hashes(line: Column) -> Column:
    """The distinct words of a line, as hashes."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _rarity(lines: DataFrame) -> Column:
    """Four times the binary logarithm of each cell's count: ``CELLS`` bytes, a constant of one plan."""
    cell = F.col("h").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = (lines.select(F.explode(_words(F.col("line"))).alias("w")).select(F.xxhash64("w").alias("h")).groupBy(cell.alias("idx"))
              .agg(F.count(F.lit(1)).alias("n")))
    rank = counts.select("idx", F.least(F.floor(F.log2("n") * 4), F.lit(126)).cast("int").alias("n"))
    return F.lit(bytearray(dense_array(staged(rank, "rarity"), CELLS).first()["cells"]))


def _tokens(hashes: Column, rarity: Column) -> Column:
    """Words as numbers in the order of rarity: the rank above, the hash below."""
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(
        F.ascii(F.substring(rarity, h.bitwiseAND(F.lit(CELLS - 1)).cast("int") + 1, F.lit(1)).cast("string")).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(WORD)))))


def _word_maps(tokens: Column) -> list[Column]:
    """128 bits in two halves: seven bits of a word's hash name the one that it turns."""
    def turned(m: Column, value: Column, t: Column) -> Column:
        return m.bitwiseXOR(F.call_function("shiftleft", value, t.bitwiseAND(F.lit(63)).cast("int")))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    every = F.aggregate(tokens, zero, lambda m, t: turned(m, one, t))
    high = F.aggregate(tokens, zero, lambda m, t: turned(m, F.shiftright(t, 6).bitwiseAND(one), t))
    return [every.alias("map"), high.alias("map_high")]


def _key(token: Column) -> Column:
    """The low half of a word's hash. Words that share it only add pairs to verify."""
    return F.shiftright(F.shiftleft(token, 32), 32).cast("int")


def _dealt(firsts: DataFrame, part: int) -> DataFrame:
    """(key, lid, pos, n, doc, maps): a row for each prefix word of each line, of the keys of one round. The order of
    documents is settled with the words; null ids, the last, stand with the greatest here."""
    doc = F.coalesce("place.doc_id", F.lit((1 << 63) - 1)).alias("doc")
    maps = [c for c in firsts.columns if c in MAPS]
    return firsts.select("lid", "n", doc, *maps, F.posexplode("prefix").alias("pos", "key")).filter(
        F.pmod("key", F.lit(ROUNDS)) == part)


def _in_rounds(pairs: Callable[[int], DataFrame], label: str) -> DataFrame:
    """The distinct pairs of all rounds, each written before the next is dealt."""
    parts = [staged(pairs(k).select("lid", "other").distinct(), label) for k in range(ROUNDS)]
    return reduce(DataFrame.union, parts).distinct()


def _needed(n: Column, m: Column, threshold: tuple[int, int]) -> Column:
    """Least overlap of sets of these sizes."""
    a, b = threshold
    return F.ceil((n + m) * F.lit(a) / F.lit(float(a + b)) - F.lit(1e-9))


def _alike(threshold: tuple[int, int]) -> Column:
    """Whether sizes (n, o_n) and word maps leave a chance of the threshold: a word that one side alone holds
    turns one bit of the 128. ``map`` has all words, so its two halves differ where it and ``map_high`` do."""
    a, b = threshold
    n, m = F.col("n"), F.col("o_n")
    high = F.col("map_high").bitwiseXOR(F.col("o_map_high"))
    apart = F.bit_count(high) + F.bit_count(F.col("map").bitwiseXOR(F.col("o_map")).bitwiseXOR(high))
    return (n * a <= m * b) & (m * a <= n * b) & (apart <= n + m - 2 * _needed(n, m, threshold))


def _mark(doc_hash: Column, line_no: Column) -> Column:
    """A line's bit in the table of needed lines."""
    return F.pmod(F.xxhash64(doc_hash, line_no), F.lit(7 * NEEDED)).cast("int")


def _table(marks: DataFrame) -> Column:
    """The bits ``at`` as bytes below 128, a constant of one plan."""
    bits = bytearray(NEEDED)
    for r in marks.distinct().toLocalIterator():
        bits[r["at"] // 7] |= 1 << r["at"] % 7
    return F.lit(bits)


def _set(table: Column, mark: Column) -> Column:
    byte = F.ascii(F.substring(table, F.floor(mark / F.lit(7)).cast("int") + 1, F.lit(1)).cast("string"))
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(mark, F.lit(7)))) != 0


def _matched(pairs: DataFrame, firsts: DataFrame, lines: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(lid, place) of every pair (lid, other) whose other line comes first and whose words reach the threshold: words
    are taken from the texts of these lines, in their whole hashes."""
    ids = pairs.select("lid").union(pairs.select("other")).distinct()
    places = staged(firsts.join(ids, "lid", "left_semi").select("lid", "place", *[
        F.col("place." + c).alias("p_" + c) for c in ("doc_id", "doc_hash", "line_no")]), "places")
    needed = _table(places.select(_mark(F.col("p_doc_hash"), F.col("p_line_no")).alias("at")))
    some = lines.filter(_set(needed, _mark(F.col("doc_hash"), F.col("line_no"))))
    here = (some["doc_id"].eqNullSafe(places["p_doc_id"]) & (some["doc_hash"] == places["p_doc_hash"])
            & (some["line_no"] == places["p_line_no"]))
    found = some.join(places, here).select("lid", "place", "line").dropDuplicates(["place"])
    sets = staged(found.select("lid", "place", _hashes(F.col("line")).alias("x")), "sets")
    both = pairs.join(sets, "lid").join(sets.toDF("other", "o_place", "y"), "other").filter("o_place < place")
    return both.filter(F.size(F.array_intersect("x", "y")) >= _needed(F.size("x"), F.size("y"), threshold)).select(
        "lid", "place").distinct()


def kept_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(doc_id, doc_hash, line_no) of every line of ``least`` words or more that stays, from rows (doc_id, text)."""
    a, b = threshold
    lines = _line_rows(docs).filter(~_short(F.col("line"), least))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_hash", "line_no")
    rows = lines.select(place.alias("place"), _tokens(_hashes(F.col("line")), _rarity(lines)).alias("tokens"))
    size = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), size - F.ceil(size * a / F.lit(float(b)) - 1e-9).cast("int") + 1)
    longer = size * (b - a) >= a  # n / (n + 1) reaches the threshold
    every = rows.select(
        F.xxhash64("tokens").alias("lid"), F.xxhash64(F.lit(1), "tokens").alias("lid2"), size.alias("n"), "place",
        *_word_maps(F.col("tokens")), F.when(longer, F.transform(prefix, _key)).alias("prefix"))
    # two sets may share lid: they are told apart by lid2, by their place, and by their words when verified
    own = [F.first(c).alias(c) for c in ("n", *MAPS, "prefix")]
    firsts = staged(every.groupBy("lid", "lid2").agg(F.min("place").alias("place"), *own).drop("lid2"), "firsts")

    shared = F.col("pos") <= F.col("n") - _needed(F.col("n"), F.col("n"), threshold)  # the prefix among lines of equal length

    def heads(part: int) -> DataFrame:
        head = F.min(F.struct("doc", "lid", *MAPS)).over(Window.partitionBy("key", "n"))
        near = _dealt(firsts, part).filter(shared).withColumn("head", head).withColumns(
            {"other": F.col("head.lid"), "o_n": F.col("n"), **{"o_" + c: F.col("head." + c) for c in MAPS}})
        return near.filter("lid <> other").filter(_alike(threshold))

    tried = staged(_in_rounds(heads, "heads"), "tried")
    with passing(docs.sparkSession):
        settled = staged(_matched(tried, firsts, lines, threshold), "settled", last=True)
    open_lines = staged(firsts.join(settled, ["lid", "place"], "left_anti").select("lid", "n", "place", *MAPS, "prefix"), "open")

    def earlier(part: int) -> DataFrame:
        other = _dealt(firsts, part).select("key", *[F.col(c).alias("o_" + c) for c in ("lid", "pos", "n", "doc", *MAPS)])
        open_ = _dealt(open_lines, part)
        left = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("o_n") - F.col("o_pos") - 1)
        fits = ((F.col("o_doc") <= F.col("doc")) & (F.col("o_lid") != F.col("lid")) & _alike(threshold)
                & (left >= _needed(F.col("n"), F.col("o_n"), threshold)))
        return open_.join(other, (open_["key"] == other["key"]) & fits).withColumnRenamed("o_lid", "other")

    more = staged(_in_rounds(earlier, "earlier").join(tried, ["lid", "other"], "left_anti"), "more")
    stay = open_lines
    if more.take(1):
        with passing(docs.sparkSession):
            later = staged(_matched(more, firsts, lines, threshold), "later", last=True)
        stay = open_lines.join(later, ["lid", "place"], "left_anti")
    return stay.select("place.doc_id", "place.doc_hash", "place.line_no")


def _kept(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, doc_hash, lines): the numbers of a document's lines that stay, of those with ``least`` words. Equal
    rows of the table fare alike."""
    return kept_lines(docs, **options).groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("lines"))


def removed_per_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and the text that is left."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("n_lines"))
    out, lines = _without(rows, "doc_id", "text", **options)
    n_removed = F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines))
    return out.select("doc_id", "n_lines", n_removed.alias("n_removed"), "text")


def _gone(text: Column, kept: Column, least: int = LEAST, **_) -> Column:
    """The numbers of a text's lines that go, none or null where all stay: those with ``least`` words that are not kept."""
    parts = F.split(text, "\n")
    stay = F.array_union(F.coalesce(kept, F.array().cast("array<int>")),
                         F.array_compact(F.transform(parts, lambda line, i: F.when(_short(line, least), i))))
    gone = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), stay)
    return F.when((text != "") & (F.size(parts) > F.coalesce(F.size(kept), F.lit(0))), gone)


def _without(docs: DataFrame, id_col: str, text_col: str, **options) -> tuple[DataFrame, str]:
    """``docs`` without their later lines, and the name of an added column: the numbers of the lines that
    went, none or null where all stayed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with passing(docs.sparkSession):
        kept = staged(_kept(rows, **options), "kept", last=True)
    ident, mark, lines = fresh(docs, "gone_id", "gone_hash", "gone_lines")
    kept = kept.toDF(ident, mark, lines)
    joined = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(ident))
                       & (F.xxhash64(F.col(text_col)) == F.col(mark)), "left")
    # a generator's column is computed once: the planner would put its rule into each place, and each line, that asks for it
    joined = joined.select(*[F.col(c) for c in docs.columns], F.explode(F.array(
        _gone(F.col(text_col), F.col(lines), **options))).alias(lines))
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(F.col(lines), i)), "\n")
    text = F.when(F.size(lines) > 0, left).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], lines), lines


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True,
          **options) -> DataFrame:
    """``docs`` without their later lines. ``drop_emptied``: documents go that lose all their words."""
    out, lines = _without(docs, id_col, text_col, **options)
    if drop_emptied:
        out = out.filter((F.coalesce(F.size(lines), F.lit(0)) < 1) | F.col(text_col).rlike(HAS_WORD))
    return out.drop(lines)
