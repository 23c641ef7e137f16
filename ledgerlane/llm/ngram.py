"""N-gram Jaccard join: word shingles, count vectors in R-trees, sketches, exact check, components.

1. A document's shingles are hashed; documents of equal sets form one class.
2. Two sets of Jaccard similarity t share one of their rarest (1 - t) n + 1 shingles. These keys
   deal the classes into groups, so that a tree never has to hold more than one group. Rarity
   is counted over all documents in a hashed table of fixed size; it only sets the order.
   Groups of the same members are one.
3. A class brings a sketch, the last 16 bits of each of its shingles, packed. Counted by hash group it is a
   point. In a group, an R-tree over the points finds those whose bound on the overlap, the sum of the
   coordinates' minima, is large enough; boxes are bounded by their upper corners. What the tree finds is
   bounded again by the sketches themselves, which is the overlap but for a few shingles in 65,536, so that
   groups of texts somewhat below the threshold make no pairs. The first pass gives each group's spanning
   forest of such pairs, which are checked exactly against the shingle sets. After that only
   pairs of different components are searched: all of them, in the second pass.
4. So every link between different components is found, and components are exact without
   listing the pairs within one.

Groups over ``TILE`` members are searched in tiles: by hash in the first pass, each with the group's
least member; all pairs of tiles in the second.

Null and empty texts, or texts without words, have no shingles and no links. Equal rows share a
class. Rows of one id count as one document; rows with a null id have a size but take no part
in links (component null). Texts of fewer than ``n`` words are one shingle. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import fresh, passing, ship, staged
from ledgerlane.llm.components import connected

CELLS, BLOCK = 1 << 20, 1 << 10
LEAF, TILE = 16, 4096
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Bytes fold A-Z only, and split at blank and
    tab to carriage return only."""
    import xxhash

    hash_ = xxhash.xxh64_intdigest
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = _mixed(np.array([hash_(x) for x in found], np.uint64))
    with np.errstate(over="ignore"):
        size = min(n, len(w))
        x = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            x = _mixed(x * _STEP + w[k:len(w) - size + 1 + k])
        return np.unique(_mixed(x + np.uint64(size)))


def groups_for(n: int) -> int:
    """Coordinates of a set of size n: the next power of two, so that about one shingle counts in each and the bound
    is close to the overlap; 4,096 at most, which bounds a tile's memory and leaves longer sets a looser bound."""
    return 1 << min(12, max(5, (n - 1).bit_length()))


def count_vector(x: np.ndarray) -> bytes:
    """The sketch: the shingles' last 16 bits in order, as steps whose low and high bytes lie apart, compressed to about
    a byte each. Any smaller number of groups can be counted from it."""
    steps = np.diff(np.sort(x.astype("<u2")), prepend=np.uint16(0)).astype("<u2")
    press = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return press.compress(steps.view("u1").reshape(-1, 2).T.tobytes()) + press.flush()


def read_vector(data: bytes, n: int) -> np.ndarray:
    """The marks of a sketch of ``n`` shingles, in order."""
    steps = np.frombuffer(zlib.decompress(data, -15), "u1").reshape(2, n)
    return np.cumsum(steps[0].astype(np.int32) + (steps[1].astype(np.int32) << 8))


def point(marks: np.ndarray) -> np.ndarray:
    """The marks counted by group."""
    g = groups_for(len(marks))
    return np.bincount(marks & (g - 1), minlength=g).astype(np.int32)


class Overlaps:
    """Bounds on the overlap of one sketch with others: how many marks they share, repeats counted."""

    def __init__(self, sketches: list[np.ndarray]):
        self.sketches, self.table = sketches, np.zeros(1 << 16, np.int32)
        self.turns: dict[int, np.ndarray] = {}

    def _turn(self, k: int) -> np.ndarray:
        """Which of its equals in the sketch each mark is."""
        if k not in self.turns:
            s = self.sketches[k]
            self.turns[k] = np.arange(len(s), dtype=np.int32) - np.searchsorted(s, s).astype(np.int32)
        return self.turns[k]

    def with_(self, i: int, others: np.ndarray) -> np.ndarray:
        mine = self.sketches[i]
        np.add.at(self.table, mine, 1)
        shared = np.array([np.count_nonzero(self.table[self.sketches[k]] > self._turn(k)) for k in others], np.int64)
        self.table[mine] = 0
        return shared


def folded(v: np.ndarray, g: int) -> np.ndarray:
    """The same set counted in fewer groups: groups are the hash's low bits."""
    return v.reshape(-1, g).sum(axis=0, dtype=np.int32) if len(v) > g else v


class CountTree:
    """R-tree over count vectors, bulk loaded by median splits; a leaf holds up to ``LEAF`` points and
    knows its box's upper corner and its sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: tuple[int, int]):
        self.points, self.sizes, self.t = points, sizes, threshold
        leaves, stack = [], [np.arange(len(points))]
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            spread = points[part]
            axis = int(np.argmax(spread.max(0) - spread.min(0)))
            by = part[np.lexsort((sizes[part], spread[:, axis]))]
            stack += [by[:len(by) // 2], by[len(by) // 2:]]
        # two levels: leaves, and boxes of LEAF leaves
        self.order = np.concatenate(leaves)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in leaves])))
        self.tops = np.stack([points[x].max(0) for x in leaves])
        self.least = np.array([sizes[x].min() for x in leaves])
        cuts = np.arange(0, len(leaves), LEAF)
        self.upper = np.maximum.reduceat(self.tops, cuts, axis=0)
        self.upper_least = np.minimum.reduceat(self.least, cuts)

    def _enough(self, q: np.ndarray, n: int, boxes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        a, b = self.t
        return np.minimum(boxes, q).sum(axis=1) * (a + b) >= a * (n + sizes)

    def near(self, i: int, free: np.ndarray) -> np.ndarray:
        """Points of ``free`` whose bound with point i reaches the threshold."""
        q, n = self.points[i], int(self.sizes[i])
        if len(self.upper) > 1:
            top = np.flatnonzero(self._enough(q, n, self.upper, self.upper_least))
            leaf = (top[:, None] * LEAF + np.arange(LEAF)).ravel()
            leaf = leaf[leaf < len(self.tops)]
            leaf = leaf[self._enough(q, n, self.tops[leaf], self.least[leaf])]
            where = np.concatenate([self.order[self.at[k]:self.at[k + 1]] for k in leaf]) if len(leaf) else leaf
        else:
            where = self.order
        a, b = self.t
        m = self.sizes[where]
        where = where[free[where] & (b * m >= a * n) & (a * m <= b * n)]
        return where[self._enough(q, n, self.points[where], self.sizes[where])]


def links(reps: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], comps: np.ndarray,
          threshold: tuple[int, int], forest: bool) -> list[tuple[int, int]]:
    """Pairs of one group, as places, that the bounds let through: a spanning forest of them, or all of
    different components. Vectors of unlike length meet in the shorter one's groups."""
    vectors, overlaps, (a, b) = [point(s) for s in sketches], Overlaps(sketches), threshold
    widths, out = np.array([len(v) for v in vectors]), []

    def near(tree: CountTree, some: np.ndarray, i: int, free: np.ndarray) -> np.ndarray:
        found = tree.near(i, free)
        if not len(found):
            return found
        shared = overlaps.with_(some[i], some[found])
        return found[shared * (a + b) >= a * (sizes[some[i]] + sizes[some[found]])]

    for g in np.unique(widths):
        some = np.flatnonzero((widths == g) | (widths == 2 * g))
        own = widths[some] == g
        if len(some) < 2 or not own.any():
            continue
        tree = CountTree(np.stack([folded(vectors[k], g) for k in some]), sizes[some], threshold)
        if forest:
            free = np.ones(len(some), bool)
            for start in range(len(some)):
                if not free[start]:
                    continue
                free[start], queue = False, [start]
                while queue:
                    i = queue.pop()
                    for k in near(tree, some, i, free & (own | own[i])):
                        free[k] = False
                        queue.append(k)
                        out.append((some[i], some[k]))
        else:
            for i in range(len(some)):
                free = (np.arange(len(some)) > i) & (own | own[i]) & (comps[some] != comps[some[i]])
                if free.any():
                    out += [(some[i], some[k]) for k in near(tree, some, i, free)]
    return out


def _rarity(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold a shingle of each hash cell; ``CELLS`` numbers, summed by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                x = shingles(text.as_py(), n)
                np.add.at(cells, (x >> np.uint64(44)).astype(np.int64), 1)
        blocks = np.flatnonzero(cells.reshape(-1, BLOCK).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([cells[b * BLOCK:(b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())],
            ["block", "counts"])

    def add(key, rows):
        total = np.sum([np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist()], axis=0)
        return pa.table({"block": [key[0].as_py()], "counts": [total.tobytes()]},
                        schema=pa.schema([("block", pa.int32()), ("counts", pa.binary())]))

    parts = docs.select("text").mapInArrow(count, "block int, counts binary")
    whole = np.zeros(CELLS, np.int64)
    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():  # 8 MB, always
        whole[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return whole


def points(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, n, s1, s2, keys, sketch): the set's size, two hashes of it, its rarest shingles, its sketch."""
    ship(docs.sparkSession)
    a, b = threshold
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(docs, n))  # fixed size
    schema = "doc_id long, n long, s1 long, s2 long, keys array<long>, sketch binary"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = rarity.value
        for batch in batches:
            ns, s1, s2, keys, sketches = [], [], [], [], []
            for text in batch.column(1):
                x = shingles(text.as_py(), n)
                k = len(x)
                with np.errstate(over="ignore"):
                    s1.append(int(x.sum(dtype=np.uint64).astype(np.int64)))
                    s2.append(int(_mixed(x ^ _STEP).sum(dtype=np.uint64).astype(np.int64)))
                first = np.lexsort((x, cells[(x >> np.uint64(44)).astype(np.int64)]))[:k - (a * k + b - 1) // b + 1]
                ns.append(k)
                keys.append(x[first].astype(np.int64))
                sketches.append(count_vector(x) if k else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "s1", "s2", "keys", "sketch"])

    return docs.mapInArrow(measure, schema)


def _candidates(members: DataFrame, threshold: tuple[int, int], forest: bool) -> DataFrame:
    """Distinct pairs (a, b) of the rows (tile, rep, n, sketch, comp) of each tile."""
    ship(members.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            _, rep, n, marks, comp = zip(*held)
            found = links(np.array(rep), np.array(n), [read_vector(m, k) for m, k in zip(marks, n)],
                          np.array(comp), threshold, forest)
            return [(min(rep[i], rep[k]), max(rep[i], rep[k])) for i, k in found if rep[i] != rep[k]]

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += pairs()
                    held.clear()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
        if out := pairs():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return (members.repartition("tile").sortWithinPartitions("tile", "n", "rep")
            .select("tile", "rep", "n", "sketch", "comp").mapInArrow(search, "a long, b long").distinct())


def _verified(pairs: DataFrame, docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose sets reach the threshold, by the shingles themselves."""
    a, b = threshold

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), n).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "x"])

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # of the rows with one id and unlike texts, all sets count
    texts = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    with passing(docs.sparkSession):
        held = staged(texts.mapInArrow(sets, "id long, x array<long>"), "sets")
        left, right = held.toDF("a", "xa"), held.toDF("b", "xb")
        both = pairs.join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("xa", "xb"))
        true = both.filter(shared * (a + b) >= a * (F.size("xa") + F.size("xb"))).select("a", "b").distinct()
        return staged(true, "links", last=True)


def classes_and_components(docs: DataFrame, n: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points of all documents, classes with their component, verified pairs of classes)."""
    if 2 * threshold[0] < threshold[1]:
        raise ValueError("links are found at thresholds of one half or more")
    found = staged(points(docs, n, threshold), "points")
    same = ["s1", "s2", "n"]
    classes = staged(found.filter("n > 0 and doc_id is not null").groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    over = classes.select(F.explode("keys").alias("key"), "rep")
    # summed first and joined back, so that a key that many classes hold is no one task's
    keys = over.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"),
                                   F.bit_xor(F.xxhash64("rep")).alias("mark")).filter("size > 1")
    shared = over.join(keys, "key")
    # keys of the same members are one group
    members = staged(shared.groupBy("mark", "size", "rep").agg(F.min("low").alias("low")), "members")
    narrow = classes.select("rep", "n", "sketch")

    tiles = F.ceil(F.col("size") / TILE)
    at = F.pmod(F.xxhash64("rep", "mark"), tiles)
    # the group's least member is in every tile, so that tiles are joined
    at = F.when(F.col("rep") == F.col("low"), F.sequence(F.lit(0).cast("long"), tiles - 1)).otherwise(F.array(at))
    first = members.withColumn("at", F.explode(at)).join(narrow, "rep").select(
        F.struct("mark", "size", "at").alias("tile"), "rep", "n", "sketch", F.col("rep").alias("comp"))
    tried = staged(_candidates(_flat(first), threshold, True), "pairs")
    edges = _verified(tried, docs, n, threshold)
    comp = staged(connected(edges), "components")

    named = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "mark", "size", "rep", F.coalesce("component", "rep").alias("comp"))
    groups = named.groupBy("mark", "size").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    mixed = named.join(groups.select("mark", "size"), ["mark", "size"])
    place = F.pmod(F.xxhash64("rep", "mark"), F.ceil(F.col("size") / TILE))
    mixed = mixed.withColumn("place", place)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / TILE) - 1))
    second = mixed.withColumn("other", other).join(narrow, "rep").select(
        F.struct("mark", "size", (F.least("place", "other") * (1 << 31) + F.greatest("place", "other")).alias("at")).alias("tile"),
        "rep", "n", "sketch", "comp")
    more = staged(_candidates(_flat(second), threshold, False).join(tried, ["a", "b"], "left_anti"), "pairs")
    if more.take(1):
        edges = edges.union(_verified(more, docs, n, threshold))
        comp = staged(connected(edges), "components")
    named = classes.select(*same, "rep").join(comp, F.col("rep") == F.col("node"), "left").select(
        *same, "rep", F.coalesce("component", "rep").alias("component"))
    return found, named, edges


def _flat(members: DataFrame) -> DataFrame:
    """The tile as one value that sorts and compares cheaply."""
    return members.withColumn("tile", F.xxhash64("tile"))


def components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per document: n_shingles and component_id, the least id that links reach. ``threshold`` is the
    least Jaccard similarity as a fraction, one half at least."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with passing(docs.sparkSession):
        found, classes, _ = classes_and_components(rows, n, threshold)
        named = found.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
        ident = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return staged(named.select("doc_id", F.col("n").alias("n_shingles"), ident.alias("component_id")),
                      "jaccard", last=True)


def keep_first(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One document of each component: the rows whose id is its component's; of equal ids, all."""
    (gone,) = fresh(docs, "gone")
    with passing(docs.sparkSession):
        left = components(docs, n, threshold, id_col, text_col).filter(
            "component_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
        left = staged(left, "gone", last=True)
    return docs.join(left, F.col(id_col) == F.col(gone), "left_anti")
