"""Nearest vectors by inner product: a hash-prefix forest (LSH forest).

Vectors are dealt into shards of bounded size. In a shard, every tree gives each vector a long
hash string (signs of random projections) and keeps the strings as a sorted array. A query
finds in each tree the entries with the longest common prefix; all trees ascend
together, one bit at a time, until their entries make up ``share`` of the shard (measured on the
test tables: half gives a recall of 0.93 to 0.98 at 20; they are nearly random in 64 dimensions). The candidates
are scored exactly, in double precision, and the best of all shards are merged. A prefix's entries are
taken all or not at all, so that copies of a vector stay together; equal vectors count once.

Norms may differ: a shard's vectors are parted into bands of like norm, each with a forest of its
own, and get a further coordinate that makes those of a band equally long, which leaves the
order by inner product as it is for any query. Rows take no part whose id or vector is null, or whose
vector is empty, zero, or holds null or non-finite values; vectors of another length
are no candidates. Rows that share the query's id are the query's own. Fewer than ``k``
candidates give fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import ship

BITS = 32
#: Norms of one band differ by this factor at most; the last band takes all that are shorter.
BAND, BANDS = 1.25, 16
FOUND = "query_id long, vec_id long, score double"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


class Forest:
    """Sorted hash strings of the distinct vectors of one shard."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        norm = np.linalg.norm(x, axis=1)
        top = norm.max()
        extra = np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))
        self.lines = np.random.default_rng(seed).standard_normal((trees * BITS, x.shape[1] + 1)).astype("f4")
        self.n, self.trees = len(x), trees
        codes = self.codes(np.column_stack([x / top, extra]).astype("f4"))
        # a row per tree: which vectors, and their strings, in order
        self.order = np.ascontiguousarray(np.argsort(codes, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(np.ascontiguousarray(codes.T), self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = np.packbits((x @ self.lines.T) >= 0, axis=1)
        return bits.reshape(len(x), self.trees, BITS // 8).view(">u4")[:, :, 0].astype(np.uint64)

    def candidates(self, q: np.ndarray, want: int):
        """For each query the entries under its prefixes, at the depth where all trees
        together first hold ``want`` of them."""
        codes = self.codes(np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]).astype("f4"))
        low, high, total = [], [], []
        # From the root down, as deep as any query still has enough: the same depths as from the
        # longest prefixes up, in fewer searches.
        for depth in range(BITS + 1):
            shift = np.uint64(BITS - depth)
            base = (codes >> shift) << shift
            last = base + ((np.uint64(1) << shift) - np.uint64(1))
            low.append(np.stack([np.searchsorted(self.sorted[t], base[:, t], "left") for t in range(self.trees)], axis=1))
            high.append(np.stack([np.searchsorted(self.sorted[t], last[:, t], "right") for t in range(self.trees)], axis=1))
            total.append((high[-1] - low[-1]).sum(axis=1))
            if not (total[-1] >= want).any():
                break
        row = np.arange(self.trees) * self.n
        for i in range(len(q)):
            depth = max(k for k in range(len(total)) if k == 0 or total[k][i] >= want)
            while True:  # entries of several trees may be the same: ascend until enough differ
                size = high[depth][i] - low[depth][i]
                at = np.repeat(low[depth][i] + row - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                seen = np.zeros(self.n, bool)
                seen[self.order.ravel()[at]] = True
                if depth == 0 or np.count_nonzero(seen) >= want:
                    break
                depth -= 1
            yield np.flatnonzero(seen)


def norm_bands(x: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors, longest band first."""
    norm = np.linalg.norm(x, axis=1)
    band = np.minimum(np.log(norm.max() / norm) / np.log(BAND), BANDS - 1).astype(int)
    return [np.flatnonzero(band == b) for b in np.unique(band)]


def search(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 64, share: float = 0.5,
           shard_rows: int = 8192, query_rows: int = 16_384, seed: int = 7, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` its ``k`` nearest found, ties to
    the smaller id. ``is_query`` is a condition on ``vec_id``."""
    ship(vectors.sparkSession)
    rows = valid(vectors, id_col, vector_col)
    n, q = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(q / query_rows))

    def nearest(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lengths = own["vector"].map(len)
        for dim, part in own.groupby(lengths):
            some = asked[asked["vector"].map(len) == dim]
            if some.empty:
                continue
            ids, every = part["vec_id"].to_numpy(), np.stack(part["vector"].to_numpy())
            x, which = np.unique(every, axis=0, return_inverse=True)
            order = np.lexsort((ids, which.ravel()))
            start = np.searchsorted(which.ravel()[order], np.arange(len(x) + 1))
            forests = [(band, Forest(x[band], trees, seed), max(4 * k, math.ceil(share * len(band))))
                       for band in norm_bands(x)]
            names, asks = some["vec_id"].to_numpy(), np.stack(some["vector"].to_numpy())
            for at in range(0, len(asks), 256):
                found = zip(*(forest.candidates(asks[at:at + 256], want) for _, forest, want in forests))
                for name, one, places in zip(names[at:], asks[at:at + 256], found):
                    near = np.concatenate([band[p] for (band, _, _), p in zip(forests, places)])
                    score = x[near] @ one
                    if len(near) > k + 1:  # ties at the edge stay in
                        edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                        near, score = near[score >= edge], score[score >= edge]
                    # of equal vectors the k + 1 smallest ids are enough
                    size = np.minimum(start[near + 1] - start[near], k + 1)
                    rows_ = np.concatenate([order[start[v]:start[v] + s] for v, s in zip(near, size)])
                    score = np.repeat(score, size)
                    other = ids[rows_] != name
                    rows_, score = rows_[other], score[other]
                    best = np.lexsort((ids[rows_], -score))[:k]
                    out.append((np.full(len(best), name), ids[rows_][best], score[best]))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    own = dealt.withColumn("block", spread(blocks))
    asked = (rows.filter(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
             .withColumn("shard", spread(shards)))
    found = (own.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInPandas(nearest, FOUND))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
