"""Lexical retrieval packing: fill each window with the unused BM25 neighbours of its seed.

``encode_pieces`` gives each document's ids (end id included): full windows as they are, and
the rest, shorter than a window, as one piece. ``pack`` counts the rests that hold each id, gives
each rest a lexical key (its least ids in three random orders, the rare ones likely first) and deals
them by range of that key, so that alike pieces meet and a group of copies
of any size is split; each task reads its range in blocks of ``shard_pieces`` pieces and
builds a BM25 inverted index over a block, its terms weighted by their counts over all rests. A seed's window takes its best unused
neighbours that fit; then the best other one is cut to fill it, and its tail seeds the next
window. Where no neighbour scores, the next piece in key order follows. Nothing is padded: what is
left at a task's end is dealt into sequences whose lengths are powers of two.

Null and empty texts are a single end id. Equal rows are packed each. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import ship, small_batches, staged
from ledgerlane.llm.tokenizer import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
ROUTED = "doc_id long, start long, ids binary, doc_tokens long, key long"
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids from here on are windows that one document fills.
FULL_IDS = 1 << 62
_FLUSH_BYTES = 1 << 20


#: Bits of a key for each of its three orders; places beyond share the last.
_KEY_BITS = 21


def holders(rests: DataFrame) -> tuple[int, np.ndarray]:
    """How many rests there are, and how many hold each id: a table as long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(0, np.int64)
        for batch in batches:
            total += batch.num_rows
            flat, starts = _joined(batch.column(0).to_pylist())
            if not len(flat):
                continue
            if flat.max() >= len(held):
                held = np.concatenate([held, np.zeros(int(flat.max()) + 1 - len(held), np.int64)])
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.append(starts, len(flat))))
            once = np.sort((row << 32) | flat)
            held += np.bincount(once[np.append(True, once[1:] != once[:-1])] & 0xFFFFFFFF, minlength=len(held))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int64()), pa.array([total, *held[seen]], pa.int64())],
                                         ["id", "n"])

    found = rests.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = {r.id: r.n for r in found}  # bound: the vocabulary
    total = counts.pop(-1, 0)
    held = np.zeros(max(counts, default=-1) + 1, np.int64)
    held[list(counts)] = list(counts.values())
    return total, held


def rarity(total: int, held: np.ndarray) -> np.ndarray:
    """BM25's weight of each id in its form that is never zero."""
    return np.log1p((total - held + 0.5) / (held + 0.5))


def key_orders(weights: np.ndarray) -> np.ndarray:
    """Each id's place in three random orders; the odds to come first grow with the weight's square.
    An id that all rests hold, as the end id, comes last."""
    draws = -np.log1p(-np.stack([np.random.default_rng(s).random(len(weights)) for s in range(3)]))
    places = np.argsort(np.argsort(draws / weights ** 2, axis=1, kind="stable"), axis=1, kind="stable")
    return np.minimum(places, (1 << _KEY_BITS) - 1)


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, one behind the other, and where each begins."""
    flat = np.frombuffer(b"".join(pieces), "<u4")
    return flat, np.cumsum([0, *(len(p) // 4 for p in pieces[:-1])])


def _keys(pieces: list[bytes], orders: np.ndarray) -> np.ndarray:
    """For each piece the least places of its ids, side by side: alike pieces sort near each other. Every piece holds
    an id."""
    flat, starts = _joined(pieces)
    a, b, c = (np.minimum.reduceat(x[flat], starts) for x in orders)
    return (a << 2 * _KEY_BITS) | (b << _KEY_BITS) | c


def _key(ids: np.ndarray, orders: np.ndarray) -> int:
    """One piece's key."""
    return int(_keys([ids.tobytes()], orders)[0])


def encode_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, id_col: str = "doc_id",
                  text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of every document: ids as little-endian unsigned 32-bit integers. A piece shorter than the
    window is the document's rest."""
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, schema = encoder(tokenizer), pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids", pa.binary()), ("doc_tokens", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = enc.encode(text.as_py()) + end
                n = len(data) // 4
                for start in range(0, n, window):
                    piece = data[4 * start:4 * (start + window)]
                    rows.append((doc_id.as_py(), start, len(piece) // 4, piece, n))
                    held += len(piece)
                    if held >= _FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(encode, PIECES)


class Index:
    """BM25 inverted index over a block of pieces: term -> (piece, weight). ``weights``: each id's weight
    (``rarity`` over the whole table); without it, the block's own, where terms in half of the block drop out."""

    def __init__(self, pieces: list[np.ndarray], k1: float = 1.2, b: float = 0.75, weights: np.ndarray | None = None):
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        doc = np.repeat(np.arange(n), sizes)
        pair, tf = np.unique((np.concatenate(pieces).astype(np.int64) << 32) | doc, return_counts=True)
        term, doc = pair >> 32, pair & 0xFFFFFFFF
        self.terms, first, slot, df = np.unique(term, return_index=True, return_inverse=True, return_counts=True)
        idf = np.log((n - df + 0.5) / (df + 0.5)) if weights is None else weights[self.terms]
        norm = k1 * (1 - b + b * sizes / sizes.mean())
        weight = idf[slot] * tf * (k1 + 1) / (tf + norm[doc])
        keep = idf[slot] > 0  # all of them under ``weights``
        self.doc, self.weight, slot = doc[keep], weight[keep], slot[keep]
        self.at = np.searchsorted(slot, np.arange(len(self.terms) + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        self.slots = slot[by_doc]
        self.of = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all pieces of the block for a seed's distinct terms."""
        slots = self.slots[self.of[seed]:self.of[seed + 1]]
        low, size = self.at[slots], self.at[slots + 1] - self.at[slots]
        if not size.sum():
            return np.zeros(self.n)
        at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` largest scores above zero, best first, equal ones in order."""
    near = np.flatnonzero(score > 0)
    if len(near) > n:
        own = score[near]
        near = near[own >= np.partition(own, len(own) - n)[len(own) - n]]
    return near[np.lexsort((near, -score[near]))][:n]


def pack(pieces: DataFrame, window: int = 1024, shard_pieces: int = 1024, look: int = 32) -> DataFrame:
    """Sequences of at most ``window`` ids from the rows of ``encode_pieces``. ``look``: how many
    neighbours in rank order are tried for one that fits before the best is cut. Every id
    lies in one row of the result, whatever these are."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in names])
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        open_: list[tuple] = []  # the unfinished window: (doc_id, start, ids, doc_tokens)
        used = 0

        def close(parts: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc_id, start, ids, total in parts:
                out.append((doc_id, start, len(ids), ids.tobytes(), total, sequence, at))
                at += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return rows

        def put(piece: tuple, at: int, n: int) -> None:
            nonlocal used, open_
            doc_id, start, ids, total = piece
            open_.append((doc_id, start + at, ids[at:at + n], total))
            used += n
            if used == window:
                close(open_)
                open_, used = [], 0

        def block(rows: list[tuple]) -> None:
            free = np.ones(len(rows), dtype=bool)
            sizes = np.array([len(r[2]) for r in rows])
            index, after, tail = Index([r[2] for r in rows], weights=weights.value), 0, None
            while True:
                if tail is not None:
                    seed, done = tail
                    tail = None
                else:
                    while after < len(rows) and not free[after]:
                        after += 1
                    if after == len(rows):
                        return
                    seed, done = after, 0
                    free[seed] = False
                n = min(sizes[seed] - done, window - used)
                put(rows[seed], done, n)
                if done + n < sizes[seed]:
                    tail = seed, done + n
                    continue
                if not used:
                    continue
                score = index.scores(seed) * free
                near = _best(score, look + 1)  # the last is the one to cut where all others fit
                for k in near[:look]:
                    if sizes[k] <= window - used:
                        free[k] = False
                        put(rows[k], 0, sizes[k])
                        if not used:
                            break
                if used:
                    rest = near[free[near]]
                    if len(rest):  # cut the best that is left; its tail seeds the next window
                        free[rest[0]] = False
                        tail = rest[0], 0

        held: list[tuple] = []
        for batch in batches:
            for doc_id, start, ids, total in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc_id, start, np.frombuffer(ids, "<u4"), total))
                if len(held) == shard_pieces:
                    block(held)
                    held = []
                    if out:  # a block may fill no window
                        yield flush()
        if held:
            block(held)
        while used:  # no padding: the rest in sequences whose lengths are powers of two
            take = want = 1 << (int(used).bit_length() - 1)
            now, later = [], []
            for doc_id, start, ids, total in open_:
                k = min(len(ids), want)
                want -= k
                if k:
                    now.append((doc_id, start, ids[:k], total))
                if k < len(ids):
                    later.append((doc_id, start + k, ids[k:], total))
            close(now)
            open_, used = later, used - take
        if out:
            yield flush()

    ship(pieces.sparkSession)
    rests = pieces.filter(F.col("length") < window).select("doc_id", "start", "ids", "doc_tokens")
    total, held = holders(rests)
    context, known = pieces.sparkSession.sparkContext, rarity(total, held)
    weights, orders = context.broadcast(known), context.broadcast(key_orders(known))  # as long as the vocabulary

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column(2).to_pylist(), orders.value) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])

    packed = (rests.mapInArrow(route, ROUTED).repartitionByRange("key", "doc_id", "start")
              .sortWithinPartitions("key", "doc_id", "start")
              .select("doc_id", "start", "ids", "doc_tokens").mapInArrow(fill, PACKED))
    full = pieces.filter(F.col("length") >= window).select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.monotonically_increasing_id() + F.lit(FULL_IDS)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, **names: str) -> DataFrame:
    """``encode_pieces`` staged once, then ``pack``."""
    with small_batches(docs.sparkSession):
        pieces = staged(encode_pieces(docs, tokenizer, window, **names), "pieces")
    return pack(pieces, window)
