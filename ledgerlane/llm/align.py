"""Cross-tokenizer alignment: token links of two vocabularies, counted corpus-wide by external spilling.

Each text is encoded by a byte-level BPE (side A, over a blank and the text) and by a piece vocabulary (side B,
which adds that blank itself). Byte offsets where tokens of both sides end cut the tokens into groups; tokens
whose bytes overlap are linked. A pair of ids counts once for each row of the table that holds it linked.

1. ``spill``: tasks gather pair-document records of a bounded number of links, sort them A id first, and write them
   as one Zstandard run for each radix of the A id: pairs with their number of documents, and the postings
   (document, occurrences) apart. A document is never split over spills.
2. ``merge_runs``: the pairs of a radix are counted by k-way heap merges of at most ``FAN`` runs a task, in as many
   levels as the number of spills asks for. Postings take no part, so a frequent A id brings only its few
   distinct pairs of each spill. The last merge meets an A id's pairs in a row and marks its maxima.
3. ``contributions``: each run streams against its radix's counts and gives every document of its spill the sum of
   its pairs' counts and its number of best links. Radixes are split by the bytes of their postings, so that a
   radix holding a third of all rows is shared by as many tasks as its size asks for.
4. The contributions are added up per spill beside the spill's documents.

Texts that are null or empty, or whose joined token bytes on either side aren't blank+text (a literal
U+2581 reads as a blank), have no tokens: zeros, and an empty hash column. Every row counts as a document of its
own, also where ids repeat; a null id stays null. Very long texts make a spill of their own. Special
strings inside texts are plain text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import ship, staged

#: Characters, and so links at most, a task holds before it spills; runs that one merge opens; bytes of postings for one task; radixes of the A id.
SPILL_LINKS, FAN, TASK_BYTES, RADIXES = 2_000_000, 256, 32 << 20, 64
RUNS = "spill long, radix int, pairs binary, postings binary, docs binary"
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_BLANK = "▁"
#: Where one of these occurs, the text is encoded as a whole: white space (to one library at least) beyond blank
#: and line end, and the sign that stands for a blank.
_WHOLE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0" + _BLANK + "".join(
    map(chr, (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")
_LOADED: dict[tuple[str, str], "Aligner"] = {}


def _byte_of_sign() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 signs are themselves, other bytes count up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligned(tuple):
    """(number, fits, n_a, n_b, groups, links): the alignment of one chunk or text. ``number`` is its own in the worker,
    ``links`` are its pairs as 64-bit integers, A id in the upper half, repeats included."""


class Aligner(dict):
    """Chunk -> its alignment. Neither vocabulary merges a visible sign with a blank or line end behind it, so
    a text's alignment is the chain of its chunks' (blanks, then a word), and chunks not met before are aligned
    many in a row. The cache takes the first ``entries`` chunks a worker meets; others serve one batch of texts."""

    def __init__(self, path_a: str, path_b: str, entries: int = 250_000):
        import sentencepiece
        from tokenizers import Tokenizer

        super().__init__()
        self.a, self.b, self.room = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), entries
        self.a.encode_special_tokens = True
        sign = _byte_of_sign()
        special = {int(k) for k in self.a.get_added_tokens_decoder()}
        signs = {i: t.encode() if i in special else bytes(sign[c] for c in t) for t, i in self.a.get_vocab().items()}
        self.bytes_a = [signs.get(i, b"") for i in range(max(signs) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b)]
        # an id as text, with the sign behind it where it ends its side of a group, and where it doesn't
        self.texts = [[np.array([f"{i}{sign}" for i in range(len(side))], object) for sign in (",", end)]
                      for side, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        self.made = 0
        crossing = re.compile(rf"[^{_BLANK}\n][{_BLANK}\n]|\n.|{_BLANK}\n", re.S)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not spec.get("normalizer")
                         and not any(crossing.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
                         and self.b.encode(" a  b\n", out_type=str)[:1] == [_BLANK])

    def _row(self, chunks: list[str]) -> list[Aligned] | None:
        """Alignments of the chunks, which stand in a row; None where they don't fit one by one. The first
        begins with the blank that the pieces' vocabulary adds."""
        text = "".join(chunks)
        cuts = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        ids = (np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(text[1:]), np.int64))
        raw = text.encode("utf-8", "surrogatepass")
        if any(b"".join([side[i] for i in x.tolist()]) != raw for side, x in zip((self.bytes_a, self.bytes_b), ids)):
            return None
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids)]
        both = np.union1d(*ends)  # between two ends lies one token of either side: a link
        of = [np.searchsorted(e, both) for e in ends]
        shared = both[(ends[0][of[0]] == both) & (ends[1][of[1]] == both)]
        if not np.isin(cuts, shared).all():
            return None
        links = ids[0][of[0]] << 32 | ids[1][of[1]]
        names, group = [], []
        for text_, x, e in zip(self.texts, ids, ends):
            at = np.searchsorted(shared, e)
            names.append(np.where(shared[at] == e, text_[1][x], text_[0][x]))
            group.append(at)
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        names = np.concatenate(names)[order].tolist()
        n_a, n_b, n_links = (np.searchsorted(e, cuts, side="right").tolist() for e in (*ends, both))
        out, a, b, k = [], 0, 0, 0
        for to_a, to_b, to_k in zip(n_a, n_b, n_links):
            groups = "".join(names[a + b:to_a + to_b])[:-1].encode()
            out.append(Aligned((self.made, True, to_a - a, to_b - b, groups, links[k:to_k].tobytes())))
            a, b, k = to_a, to_b, to_k
            self.made += 1
        return out

    def _alone(self, text: str) -> Aligned:
        """The alignment of a text, or of a chunk behind a word; if it doesn't fit, without tokens."""
        row = self._row([" a", text]) if text[0] != " " else self._row([text]) if len(text) > 1 else self._row([" a", " "])
        self.made += 1
        return row[-1] if row else Aligned((self.made - 1, False, 0, 0, b"", b""))

    def align(self, texts: list[str | None]) -> list[list[Aligned]]:
        """For each text the alignments that make it up; none where it has no tokens."""
        chunks = [[] if not t else None if not self.by_chunk or _WHOLE.search(t) else _CHUNK.findall(" " + t) for t in texts]
        new = {c for row in chunks if row for c in row if c not in self}
        found: dict[str, Aligned] = {}
        # in a row, a chunk of blanks alone would join the next one
        words = sorted(c for c in new if c.strip(" \n"))
        for k in range(0, len(words), 4096):
            row = self._row([" a", *words[k:k + 4096]])
            found.update(zip(words[k:k + 4096], row[1:]) if row else ((c, self._alone(c)) for c in words[k:k + 4096]))
        found.update((c, self._alone(c)) for c in new if c not in found)
        if len(self) < self.room:
            self.update((c, x) for c, x in found.items() if len(c) <= 64)
        out = []
        for text, row in zip(texts, chunks):
            parts = [self._alone(" " + text)] if row is None else [self[c] if c in self else found[c] for c in row]
            out.append(parts if all(p[1] for p in parts) else [])
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of these vocabularies, loaded once and kept over tasks."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of equal or unlike length as one Zstandard frame."""
    import zstandard

    head = np.array([len(arrays), *map(len, arrays)], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8 * (len(kinds) + 1), []
    for size, kind in zip(np.frombuffer(raw, "<i8", len(kinds) + 1)[1:], kinds):
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * np.dtype(kind).itemsize
    return out


class _Spill:
    """Documents and their alignments, before they are written as runs."""

    def __init__(self):
        self.ids, self.parts, self.of, self.size = [], [], [], 0

    def add(self, doc_id: int | None, parts: list[Aligned]) -> None:
        self.ids.append(doc_id)
        self.parts += parts
        self.of.append(len(parts))

    def close(self) -> None:
        """The distinct alignments, which of them each part is, and the document of each part."""
        number = np.fromiter((p[0] for p in self.parts), np.int64, len(self.parts))
        _, first, self.at = np.unique(number, return_index=True, return_inverse=True)
        self.kinds = [self.parts[i] for i in first]
        self.doc = np.repeat(np.arange(len(self.of)), self.of)

    def runs(self, radixes: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix, pairs, postings) of every radix that has any, pairs in order of A id, then B id."""
        if not self.parts:
            return
        kinds, n_docs = self.kinds, len(self.of)
        seen, often = np.unique(self.doc * len(kinds) + self.at, return_counts=True)
        doc, at = np.divmod(seen, len(kinds))
        sizes = np.array([len(p[5]) // 8 for p in kinds])
        pairs, keys = np.unique(np.frombuffer(b"".join([p[5] for p in kinds]), np.uint64), return_inverse=True)
        # one record for each (document, chunk) and link of the chunk
        n = sizes[at]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(sizes) - sizes)[at], n)
        record = keys[where] * n_docs + np.repeat(doc, n)
        times = np.repeat(often, n)
        order = np.argsort(record)
        record = record[order]
        first = np.flatnonzero(np.concatenate(([True], record[1:] != record[:-1])))
        times, (pair, doc) = np.add.reduceat(times[order], first), np.divmod(record[first], n_docs)
        held = np.bincount(pair, minlength=len(pairs))
        of_pair = ((pairs >> np.uint64(32)) % np.uint64(radixes)).astype(np.int64)
        by_radix, radix_of = np.argsort(of_pair, kind="stable"), of_pair[pair]
        records = np.argsort(radix_of, kind="stable")
        found, starts = np.unique(of_pair[by_radix], return_index=True)
        cuts = np.searchsorted(radix_of[records], found)
        for k, radix in enumerate(found):
            some = by_radix[starts[k]:starts[k + 1] if k + 1 < len(found) else None]
            mine = records[cuts[k]:cuts[k + 1] if k + 1 < len(found) else None]
            yield (int(radix), _packed(pairs[some], held[some].astype("<u8")),
                   _packed(doc[mine].astype("<u4"), times[mine].astype("<u4")))

    def documents(self) -> bytes:
        n_a, n_b, links = (np.zeros(len(self.of), np.int64) for _ in range(3))
        for total, size in ((n_a, [p[2] for p in self.kinds]), (n_b, [p[3] for p in self.kinds]),
                            (links, [len(p[5]) // 8 for p in self.kinds])):
            np.add.at(total, self.doc, np.array(size, np.int64)[self.at])
        sha, start = [], 0
        for n in self.of:
            groups = b";".join([p[4] for p in self.parts[start:start + n]])
            sha.append(hashlib.sha256(groups).hexdigest() if n else "")
            start += n
        # tokens that overlap form a path within their group, so groups follow from the numbers of tokens
        columns = [pa.array(c, pa.int64()) for c in (self.ids, n_a, n_b, n_a + n_b - links, links)] + [pa.array(sha, pa.string())]
        batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.values())], list(names))


def spill(docs: DataFrame, path_a: str, path_b: str, radixes: int = RADIXES, links: int = SPILL_LINKS) -> DataFrame:
    """Rows (spill, radix, pairs, postings) of all runs, and (spill, docs) of each spill's documents, from
    rows (doc_id, text). A spill ends with the document that brings it to ``links`` characters: a link covers
    at least one byte."""
    ship(docs.sparkSession)
    names = {"spill": pa.int64(), "radix": pa.int32(), "pairs": pa.binary(), "postings": pa.binary(), "docs": pa.binary()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, number = aligner(path_a, path_b), _Spill(), TaskContext.get().partitionId() << 24

        def out() -> Iterator[pa.RecordBatch]:
            held.close()
            yield _rows(names, [(number, None, None, None, held.documents())])
            for radix, pairs, postings in held.runs(radixes):
                yield _rows(names, [(number, radix, pairs, postings, None)])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            for k, text in enumerate(texts):
                size += len(text or "") + 1
                if held.size + size >= links or k + 1 == len(texts):
                    for doc_id, parts in zip(ids[start:k + 1], both.align(texts[start:k + 1])):
                        held.add(doc_id, parts)
                    held.size += size
                    start, size = k + 1, 0
                    if held.size >= links:
                        yield from out()
                        held, number = _Spill(), number + 1
        if held.ids:
            yield from out()

    return docs.mapInArrow(write, RUNS)


def merged(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, documents) in order of the pair, from a heap over the runs' heads."""

    def entries(run: bytes) -> Iterator[tuple[int, int]]:
        keys, counts = _unpacked(run, "<u8", "<u8")
        return zip(keys.tolist(), counts.tolist())

    last, total = None, 0
    for key, n in heapq.merge(*map(entries, runs)):
        if key != last:
            if last is not None:
                yield last, total
            last, total = key, 0
        total += n
    if last is not None:
        yield last, total


def _best(counted: Iterator[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts, and whether a pair's count is its A id's highest, which shows once the A id ends."""
    keys, counts, best, start, high = [], [], [], 0, 0
    for key, n in counted:
        if keys and key >> 32 != keys[-1] >> 32:
            best += [x == high for x in counts[start:]]
            start, high = len(keys), 0
        keys.append(key)
        counts.append(n)
        high = max(high, n)
    best += [x == high for x in counts[start:]]
    return np.array(keys, "<u8"), np.array(counts, "<u8"), np.array(best, "u1")


def merge_runs(runs: DataFrame, spills: int, fan: int = FAN) -> DataFrame:
    """(radix, counts): pairs, counts and marks of the best, from rows (spill, radix, pairs); ``spills``:
    how many there are at most."""

    def merge(last: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], None
            names = {"part": pa.int64(), "radix": pa.int32(), "pairs": pa.binary()}

            def out() -> pa.RecordBatch:
                if last:
                    return _rows(names, [(at[1], at[0], _packed(*_best(merged(held))))])
                keys, counts = zip(*merged(held))
                return _rows(names, [(at[1], at[0], _packed(np.array(keys, "<u8"), np.array(counts, "<u8")))])

            for batch in batches:
                for radix, part, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                    if at != (radix, part):
                        if held:
                            yield out()
                        held, at = [], (radix, part)
                    held.append(pairs)
            if held:
                yield out()

        return task

    rows = runs.select("radix", F.col("spill").alias("part"), "pairs")
    while True:
        groups = -(-spills // fan)
        rows = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(groups, 1))))
        rows = rows.repartition("radix", "part").sortWithinPartitions("radix", "part").mapInArrow(
            merge(groups <= 1), "part long, radix int, pairs binary").select("radix", "part", "pairs")
        if groups <= 1:
            return rows.select("radix", F.col("pairs").alias("counts"))
        rows, spills = staged(rows, "merged"), groups


def contributions(runs: DataFrame, counts: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(spill, sums): per spill and radix, what its documents' links add to n_best and count_sum."""
    sizes = {r.radix: r.b for r in runs.groupBy("radix").agg(F.sum(F.length("postings")).alias("b")).collect()}
    if not sizes:  # one number for each radix
        return runs.select("spill", F.col("pairs").alias("sums"))
    salts = [-(-sizes.get(k, 1) // task_bytes) for k in range(max(sizes) + 1)]
    of = F.get(F.array(*[F.lit(int(x)) for x in salts]), F.col("radix"))
    mine = runs.select("radix", F.pmod(F.xxhash64("spill"), of.cast("long")).alias("salt"), "spill", "pairs", "postings")
    every = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1)).alias("salt"),
                          F.lit(None).cast("long").alias("spill"), F.col("counts").alias("pairs"),
                          F.lit(None).cast("binary").alias("postings"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spill_, pairs, postings in zip(*(batch.column(k) for k in ("spill", "pairs", "postings"))):
                if not spill_.is_valid:  # the radix's counts come ahead of its runs
                    keys, total, best = _unpacked(pairs.as_py(), "<u8", "<u8", "u1")
                    continue
                own, held = _unpacked(pairs.as_py(), "<u8", "<u8")
                doc, times = _unpacked(postings.as_py(), "<u4", "<u4")
                at, times = np.repeat(np.searchsorted(keys, own), held.astype(np.int64)), times.astype(np.int64)
                there, doc = np.unique(doc, return_inverse=True)
                n_best, count_sum = np.zeros(len(there), "<i8"), np.zeros(len(there), "<i8")
                np.add.at(n_best, doc, times * best[at])
                np.add.at(count_sum, doc, times * total[at].astype(np.int64))
                yield _rows({"spill": pa.int64(), "sums": pa.binary()},
                            [(spill_.as_py(), _packed(there.astype("<u4"), n_best, count_sum))])

    return (mine.unionByName(every).repartition(sum(salts), "radix", "salt")
            .sortWithinPartitions("radix", "salt", F.col("spill").asc_nulls_first())
            .mapInArrow(add, "spill long, sums binary"))


def _documents(rows: DataFrame) -> DataFrame:
    """The result, from rows (spill, docs) and (spill, sums): a spill's documents come first."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = n_best = count_sum = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*docs.columns[:5], pa.array(n_best), pa.array(count_sum), docs.columns[5]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        for batch in batches:
            for found, sums in zip(batch.column("docs"), batch.column("sums")):
                if found.is_valid:
                    if docs is not None:
                        yield out()
                    docs = pa.ipc.open_stream(found.as_buffer()).read_next_batch()
                    n_best, count_sum = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
                else:
                    there, best, total = _unpacked(sums.as_py(), "<u4", "<i8", "<i8")
                    n_best[there] += best
                    count_sum[there] += total
        if docs is not None:
            yield out()

    return (rows.repartition("spill").sortWithinPartitions("spill", F.col("docs").isNull())
            .select("docs", "sums").mapInArrow(finish, RESULT))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    radixes: int = RADIXES, spill_links: int = SPILL_LINKS, fan: int = FAN,
                    task_bytes: int = TASK_BYTES) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spilled = staged(spill(rows, path_a, path_b, radixes, spill_links), "spills")
    runs = spilled.filter("radix is not null")
    spills = spilled.filter("docs is not null").count()
    counts = staged(merge_runs(runs, spills, fan), "counts")
    sums = contributions(runs, counts, task_bytes)
    none = F.lit(None).cast("binary")
    return _documents(spilled.filter("docs is not null").select("spill", "docs", none.alias("sums"))
                      .unionByName(sums.select("spill", none.alias("docs"), "sums")))
