"""Phrase collocation mining: word suffixes truncated at ``DEPTH``, dealt to subtrees by vertical partitioning.

A phrase's count is the total of the leaves below its node in the tree of all word suffixes of its language
(pieces end at punctuation and line ends). The tree is never built whole:

1. ``suffix_runs``: each task sorts the truncated suffixes of a bounded number of words, joins equal ones
   and writes them, compressed, as runs. Repeated passages shrink to one row a run here.
2. ``vertical``: prefixes are counted in the runs: all single words, then, level by level, the heavy extensions of those
   prefixes whose suffixes are more than half of the budget. Prefixes within it, and those of full depth, become the
   subtrees' roots. The table of prefixes over the budget is broadcast: the budget grows with the input where
   needed so that it has at most ``CUT_PREFIXES`` rows a level.
3. ``subtrees``: roots are hashed into groups of half the budget on average. Each group's suffixes are sorted in one
   task, independent of all others, and every node's count is read from its leaves' totals. Suffixes that many runs
   share are joined as they come, so that a repeated passage takes one row.
4. Scores, the dropping of contained candidates and the ranking are joins, groupings and a window with a group limit.

A cut of a candidate only needs counts of its own parts, which are at least as frequent, so phrases rarer than
``least`` never leave their subtree. A candidate inside a longer one of equal count is inside one longer by a single
word of equal count too, so only those are compared. Products are DECIMAL(38): exact below 10^16 words a language.

Null texts and empty ones have no words; a null language is ``und``. Rows of one id, and repeated rows, all
count. Very long texts are read whole; no phrase crosses from one row to the next. Ties are settled as the
ranking says. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import ship, small_batches, staged

#: Words of the longest phrase; least count; words a task holds before it writes runs; suffix rows one subtree task
#: may hold; prefixes over the budget a level, at most.
DEPTH, LEAST, RUN_WORDS, BUDGET, CUT_PREFIXES = 5, 100, 600_000, 400_000, 1 << 20
#: Parts of a language in which candidates are ranked ahead of the language as a whole.
RANK_PARTS = (256, 16)
#: Lower case for A-Z; every sign that ends a piece becomes a full stop, which no word holds; tab is a blank.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ........." )
RUNS = "lang string, words binary, heads binary, suffixes binary"
COUNTS = "lang string, phrase string, rows long, f long"


def tokens(text: str) -> list[bytes]:
    """The words of a text, with ``.`` at each piece's end and at the text's."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b".", b" . ").split(b" ") + [b"."]


@cache
def _compressor():
    """One for a process: a new one for each of many small pieces takes longer than the pieces."""
    import zstandard

    return zstandard.ZstdCompressor(level=3)


@cache
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def _packed(*arrays: np.ndarray) -> bytes:
    """The numbers of each array byte by byte, all lowest bytes first: the high ones are mostly alike."""
    return _compressor().compress(b"".join([np.array([len(arrays), *map(len, arrays)], "<i8").tobytes(),
                                            *(np.ascontiguousarray(a, "<i4").view("u1").reshape(-1, 4).T.tobytes() for a in arrays)]))


def _packed_parts(arrays: list[np.ndarray], ends: list[int]) -> Iterator[bytes]:
    """``_packed`` of each part of arrays of one length; a part ends where the next begins."""
    planes = np.ascontiguousarray(np.stack(arrays).astype("<i4").view("u1").reshape(len(arrays), -1, 4).transpose(0, 2, 1))
    for a, b in zip([0, *ends], ends):
        sizes = np.array([len(arrays), *[b - a] * len(arrays)], "<i8").tobytes()
        yield _compressor().compress(sizes + planes[:, :, a:b].tobytes())


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = _decompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
    if len(set(sizes)) == 1:
        planes = np.frombuffer(raw, "u1", -1, 8 * (n + 1)).reshape(n, 4, sizes[0])
        return list(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i4").reshape(n, sizes[0]))
    ends = 8 * (n + 1) + 4 * np.cumsum(sizes)
    return [np.ascontiguousarray(np.frombuffer(raw, "u1", int(4 * size), int(end - 4 * size)).reshape(4, -1).T).view("<i4")[:, 0]
            for size, end in zip(sizes, ends)]


def _words(words: list[bytes]) -> bytes:
    return _compressor().compress(b"\n".join(words))


def _read_words(data: bytes) -> list[bytes]:
    return _decompressor().decompress(data).split(b"\n")


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows one by one: a batch holds many runs."""
    return (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows))


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the row above; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of numbers from 0 up: as many columns as fit make one key of 64 bits, whose rank then stands
    for them. Equal rows come in any order."""
    key, bits = np.zeros(len(columns[0]), np.uint64), 0
    for c in columns:
        more = int(c.max(initial=0)).bit_length()
        if bits + more > 64:
            order = np.argsort(key)
            rank = np.cumsum(_changes([key[order]])) - 1
            key[order] = rank
            bits = int(rank[-1]).bit_length()
        key = np.left_shift(key, np.uint64(more)) | c.astype(np.uint64) if more else key
        bits += more
    return np.argsort(key)


def sorted_suffixes(columns: list[np.ndarray], counts: np.ndarray, extra: tuple[np.ndarray, ...] = ()) -> list[np.ndarray]:
    """Distinct rows of the columns in order, then their summed counts, then each extra column, which equal rows share."""
    order = _order(columns)
    columns = [c[order] for c in columns]
    first = np.flatnonzero(_changes(columns))
    total = np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else counts
    return [c[first] for c in columns] + [total] + [x[order][first] for x in extra]


def _suffixes(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """Columns of the suffixes at every word of a row of ids, in which 0 ends a piece."""
    at = np.flatnonzero(ids)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    columns = [padded[at]]
    for k in range(1, depth):
        columns.append(np.where(columns[-1] == 0, 0, padded[at + k]))
    return columns


def _numbers() -> dict[bytes, int]:
    """Word -> number by first occurrence; a piece's end is 0, and so is what stands between two blanks."""
    return defaultdict(count(1).__next__, {b".": 0})


def suffix_runs(docs: DataFrame, depth: int = DEPTH, run_words: int = RUN_WORDS) -> DataFrame:
    """Rows (lang, words, heads, suffixes) from rows (lang, text): a run's words, how many suffixes and
    occurrences begin with each, and its distinct suffixes with their counts."""
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        numbers: dict[str, dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang in held:
                words = [b".", *sorted(w for w in numbers[lang] if w != b".")]
                rank = np.empty(len(words), np.int32)
                rank[np.fromiter(map(numbers[lang].__getitem__, words), np.int64, len(words))] = np.arange(len(words))
                columns = _suffixes(rank[np.concatenate(held[lang])], depth)
                if not len(columns[0]):
                    continue
                *columns, counts = sorted_suffixes(columns, np.ones(len(columns[0]), np.int64))
                first = np.flatnonzero(_changes(columns[:1]))
                heads = (columns[0][first], np.diff(np.append(first, len(counts))), np.add.reduceat(counts, first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([_words(words)], pa.binary()),
                     pa.array([_packed(*heads)], pa.binary()), pa.array([_packed(*columns, counts)], pa.binary())],
                    ["lang", "words", "heads", "suffixes"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    held[lang], numbers[lang] = [], _numbers()
                number = numbers[lang]
                found = [w for w in tokens(text.as_py()) if w]
                held[lang].append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= run_words:
                    yield from out()
                    held, numbers, size = {}, {}, 0
        yield from out()

    return docs.mapInArrow(write, RUNS)


def _places(words: list[bytes], cut: list[set[bytes]], columns: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each level of ``cut`` (prefixes over the budget, words joined by blanks), the number of each suffix's
    prefix of that depth among them, 0 where it is none; and the depth of the levels."""
    of = {w: i for i, w in enumerate(words)}
    at, before, known = [], np.ones(len(columns[0]), np.int64), {b"": 1}
    for k, level in enumerate(cut):
        names, keys = [], []
        for name in sorted(level):
            head, _, last = name.rpartition(b" ")
            if head in known and last in of:
                names.append(name)
                keys.append(known[head] * len(words) + of[last])
        table = np.array(sorted(keys), np.int64)
        known = {name: int(np.searchsorted(table, key)) + 1 for name, key in zip(names, keys)}
        mine = before * len(words) + columns[k]
        spot = np.minimum(np.searchsorted(table, mine), max(len(table) - 1, 0))
        hit = (table[spot] == mine) & (before > 0) & (columns[k] > 0) if len(table) else np.zeros(len(mine), bool)
        before = np.where(hit, spot + 1, 0)
        at.append(before)
    return at, len(cut)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("rows").alias("rows"), F.sum("f").alias("f"))


def word_counts(runs: DataFrame) -> DataFrame:
    """(lang, phrase, rows, f) of every word."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, data in _each(batch):
                names, (at, rows, f) = _read_words(words), _unpacked(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([names[i] for i in at], pa.binary()).cast(pa.string()),
                     pa.array(rows, pa.int64()), pa.array(f, pa.int64())], ["lang", "phrase", "rows", "f"])

    return _counted(runs.select("lang", "words", "heads").mapInArrow(heads, COUNTS))


def _prefixes(runs: DataFrame, cut: list[dict[str, set[bytes]]], least_rows: float) -> DataFrame:
    """(lang, phrase, rows, f) added up over the runs: with ``least_rows``, of the prefixes one word longer than the
    deepest level of ``cut`` that have so many suffixes in a run; with 0, of the prefixes in ``cut``."""
    held = runs.sparkSession.sparkContext.broadcast(cut)  # CUT_PREFIXES a level at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, data in _each(batch):
                names, (*columns, counts) = _read_words(words), _unpacked(data)
                at, known = _places(names, [level.get(lang, set()) for level in held.value], columns)
                for depth in ([known + 1] if least_rows else range(1, known + 1)):
                    some = (at[depth - 1 if not least_rows else -1] > 0) & (columns[depth - 1] > 0)
                    own, of = [c[some] for c in columns[:depth]], counts[some].astype(np.int64)
                    first = np.flatnonzero(_changes(own))
                    rows = np.diff(np.append(first, len(of)))
                    f = np.add.reduceat(of, first) if len(first) else of
                    first, rows, f = (x[rows >= least_rows] for x in (first, rows, f))
                    if len(first):
                        phrases = [b" ".join([names[i] for i in row]) for row in zip(*(c[first].tolist() for c in own))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(first), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                             pa.array(rows, pa.int64()), pa.array(f, pa.int64())], ["lang", "phrase", "rows", "f"])

    return _counted(runs.select("lang", "words", "suffixes").mapInArrow(counted, COUNTS))


def vertical(runs: DataFrame, depth: int = DEPTH, budget: int = BUDGET,
             cut_prefixes: int = CUT_PREFIXES) -> tuple[DataFrame, list[dict[str, set[bytes]]], int]:
    """(words, cut, groups): all words counted; by level, the prefixes over half of the budget; the number of groups.

    A longer prefix over half of the budget has, over R runs, at least a quarter of it in runs that hold a (4 R)-th
    of the budget each. So only those parts are added up, and what reaches a quarter is cut: all that must be, and
    twice as many prefixes at most."""
    words = staged(word_counts(runs), "words")
    rows, n = words.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], max(1, runs.count())
    budget = max(budget, -(-4 * rows // cut_prefixes))
    cut: list[dict[str, set[bytes]]] = []
    level = words.filter(F.col("rows") > budget / 2)
    while True:
        names: dict[str, set[bytes]] = {}
        for r in level.select("lang", "phrase").toLocalIterator():
            names.setdefault(r.lang, set()).add(r.phrase.encode())
        if names:
            cut.append(names)
        if not names or len(cut) == depth - 1:
            return words, cut, max(1, -(-2 * rows // budget))
        level = _prefixes(runs, cut, max(1.0, budget / (4 * n))).filter(F.col("rows") >= budget / 4)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _own_numbers(columns: np.ndarray, part: np.ndarray, parts: int, words: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(numbers, used, begins): each part's words numbered on their own, all parts at once. ``used``: the words of one
    part after the other, in order, 0 first; ``begins``: where each part's begin."""
    zeros = np.arange(parts, dtype=np.int64) * words
    used, number = np.unique(np.concatenate((zeros, (part * words + columns).ravel())), return_inverse=True)
    begins = np.searchsorted(used, zeros)
    return number[parts:].reshape(columns.shape) - begins[part], used % words, begins.tolist()


def _dealt(runs: DataFrame, cut: list[dict[str, set[bytes]]], groups: int, depth: int) -> DataFrame:
    """Rows (subtree, lang, words, suffixes): the part of a run that belongs to a group; the last column of
    ``suffixes`` is the depth of each suffix's root."""
    held = runs.sparkSession.sparkContext.broadcast(cut)  # CUT_PREFIXES a level at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for lang, words, data in _each(batch):
                names, (*columns, counts) = _read_words(words), _unpacked(data)
                at, known = _places(names, [level.get(lang, set()) for level in held.value], columns)
                hashes = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)
                key = np.full(len(counts), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
                root = np.zeros(len(counts), np.int32)
                with np.errstate(over="ignore"):
                    for k in range(min(known + 1, depth)):
                        open_ = (root == 0) & (columns[k] > 0)  # a piece that ends here adds nothing below its prefix
                        key = np.where(open_, _mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[columns[k]]), key)
                        root[open_ & (at[k] == 0 if k < known else True)] = k + 1
                some = np.flatnonzero(root)
                if not len(some):
                    continue
                to = key[some] % np.uint64(groups)
                order = _order([to])
                some, to = some[order], to[order]
                new = _changes([to])
                starts = np.flatnonzero(new)
                own, used, begins = _own_numbers(np.stack([c[some] for c in columns]), np.cumsum(new) - 1, len(starts), len(names))
                used = [names[i] for i in used.tolist()]
                ends = [*starts[1:].tolist(), len(some)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[starts], pa.int64()), pa.array([lang] * len(starts), pa.string()),
                     pa.array([_words(used[a:b]) for a, b in zip(begins, [*begins[1:], len(used)])], pa.binary()),
                     pa.array(list(_packed_parts([*own, counts[some], root[some]], ends)), pa.binary())],
                    ["subtree", "lang", "words", "suffixes"])

    return runs.select("lang", "words", "suffixes").mapInArrow(deal, "subtree long, " + RUNS.replace(" heads binary,", ""))


class Subtree:
    """The suffixes of one group, and what its nodes count."""

    def __init__(self, depth: int):
        self.depth, self.langs, self.parts, self.numbers = depth, [], [], _numbers()
        self.size, self.room = 0, BUDGET

    def add(self, lang: str, words: bytes, suffixes: bytes) -> None:
        words = _read_words(words)
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        if lang not in self.langs:
            self.langs.append(lang)
        *columns, counts, root = _unpacked(suffixes)
        self.parts.append([np.full(len(counts), self.langs.index(lang), np.int32), *(number[c] for c in columns), counts, root])
        self.size += len(counts)
        if self.size > self.room:  # suffixes that many runs share are one
            self.parts = [self._joined()]
            self.size = len(self.parts[0][0])
            self.room = max(BUDGET, 2 * self.size)

    def _joined(self) -> list[np.ndarray]:
        lang, *columns, counts, root = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        return sorted_suffixes([lang, *columns], counts, (root,))

    def nodes(self, least: int) -> Iterator[tuple[str, bytes, int]]:
        """(lang, phrase, count) of the nodes at or below their root that occur ``least`` times."""
        names = list(self.numbers)
        lang, *columns, counts, root = self._joined()
        for k in range(1, self.depth + 1):
            first = np.flatnonzero(_changes([lang, *columns[:k]]))
            f = np.add.reduceat(counts, first)
            some = first[(f >= least) & (columns[k - 1][first] > 0) & (root[first] <= k)]
            f = f[(f >= least) & (columns[k - 1][first] > 0) & (root[first] <= k)]
            for i, n in zip(some.tolist(), f.tolist()):
                yield self.langs[lang[i]], b" ".join([names[c[i]] for c in columns[:k]]), n


def subtrees(dealt: DataFrame, least: int = LEAST, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, f) of the frequent nodes of all groups' subtrees."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, Subtree(depth)

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(tree.nodes(least)) if tree.parts else []
            if rows:
                lang, phrase, f = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())],
                    ["lang", "phrase", "f"])

        for batch in batches:
            for subtree, lang, words, suffixes in _each(batch):
                if subtree != at:
                    yield from out()
                    at, tree = subtree, Subtree(depth)
                tree.add(lang, words, suffixes)
        yield from out()

    return (dealt.repartition("subtree").sortWithinPartitions("subtree")
            .mapInArrow(build, "lang string, phrase string, f long"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, run_words: int = RUN_WORDS,
                     budget: int = BUDGET, cut_prefixes: int = CUT_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of up to ``depth`` words with f >= ``least``, (lang, n)), from rows
    (lang, text)."""
    with small_batches(docs.sparkSession):
        runs = staged(suffix_runs(docs, depth, run_words), "runs")
    with small_batches(docs.sparkSession, 8):  # a run takes megabytes
        words, cut, groups = vertical(runs, depth, budget, cut_prefixes)
        found = subtrees(_dealt(runs, cut, groups, depth), least, depth)
        if cut:  # the nodes above the roots
            found = found.unionByName(_prefixes(runs, cut, 0).filter(F.col("f") >= least).select("lang", "phrase", "f"))
        return staged(found, "phrases"), staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")


def score() -> Column:
    """floor(1000 a n / (l r)) of the columns so called, in DECIMAL(38)."""
    return F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)))"
                  " div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")


def collocations(docs: DataFrame, top: int = 2000, least: int = LEAST, depth: int = DEPTH, lang_col: str = "lang",
                 text_col: str = "text", **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` candidates."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(rows, least, depth, **options)
    words = F.size(F.split("phrase", " "))
    candidates = phrases.filter(words >= 2).select("lang", "phrase", F.col("f").alias("a"), words.alias("m"))

    k = F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", k).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substring(phrase, char_length(head) + 2)"))
    left = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang").withColumn("score", score())
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"),
                                                F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = F.expr("array(substring_index(phrase, ' ', m - 1), substring(phrase, instr(phrase, ' ') + 1))")
    longer = (candidates.filter("m > 2").select("lang", F.explode(inside).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = best.join(longer, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # a language may hold most rows: its first ``top`` are among those of its parts, and of theirs
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in RANK_PARTS:
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        within = F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))
        kept = kept.withColumn("rank", within).filter(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
