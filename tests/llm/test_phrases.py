"""Phrase mining against counting every phrase."""

import random
import re
from collections import Counter

import pytest
from helpers import docs, edge_texts
from pyspark.sql import functions as F

from ledgerlane.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_counts(rows, depth=5):
    """lang -> (phrase as words -> count, number of words)."""
    out = {}
    for lang, text in rows:
        f, n = out.setdefault(lang if lang is not None else "und", (Counter(), Counter()))
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["words"] += len(words)
            for i in range(len(words)):
                for m in range(1, min(depth, len(words) - i) + 1):
                    f[tuple(words[i:i + m])] += 1
    return out


def brute(rows, least, top):
    out = []
    for lang, (f, n) in brute_counts(rows).items():
        n, found = n["words"], []
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def table(spark, rows, clash=True):
    own = [(k, t, "src") for k, (_, t) in enumerate(rows)]
    langs = spark.createDataFrame([(k, lang) for k, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return docs(spark, own, clash).drop("lang").join(langs, "doc_id").withColumns(
        {c: F.lit("x") for c in ("f", "a", "l", "m", "k", "phrase", "rows", "subtree", "longer", "rank", "score", "words")})


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def sample(seed, n, langs=("en", "de", None)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Straße", "漢字", "é", "\x1cz", "A", "É"]
    passage = "the quick brown fox jumps over the lazy dog"
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "!"])
                       for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(langs), text + (passage if rng.random() < 0.3 else "")))
    return rows + [("en", None), (None, ""), ("en", "...,,,\n\n"), ("fr", "solo"), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("options", [
    {}, {"run_words": 200, "budget": 400}, {"run_words": 60, "budget": 24},  # cuts at every depth
    {"run_words": 100, "budget": 8, "cut_prefixes": 64}])  # the budget grows so that few prefixes are cut
def test_counts_scores_and_ranks_match_brute_force(spark, options):
    rows = sample(1, 220)
    result = phrases.collocations(table(spark, rows).repartition(3), least=6, top=50, **options)
    assert got(result) == brute(rows, 6, 50)


def test_all_nodes_are_counted_once(spark):
    rows = sample(2, 120)
    plain = table(spark, rows, False).select(F.coalesce("lang", F.lit("und")).alias("lang"),
                                             F.coalesce("text", F.lit("")).alias("text"))
    found, totals = phrases.frequent_phrases(plain, least=2, run_words=80, budget=40)
    expected = brute_counts(rows)
    assert sorted(map(tuple, found.collect())) == sorted(
        (lang, " ".join(p), a) for lang, (f, _) in expected.items() for p, a in f.items() if a >= 2)
    assert {r.lang: r.n for r in totals.collect()} == {k: v[1]["words"] for k, v in expected.items() if v[1]["words"]}


def test_a_copied_passage_is_cut_to_full_depth(spark):
    rows = [("en", "one two three four five six seven") for _ in range(300)]
    result = phrases.collocations(table(spark, rows).repartition(4), least=100, run_words=7, budget=8)
    assert got(result) == brute(rows, 100, 2000)


def test_edge_texts_and_empty_table(spark):
    rows = [("en", t) for _, t, _ in edge_texts()]
    assert got(phrases.collocations(table(spark, rows), least=2)) == brute(rows, 2, 2000)
    assert got(phrases.collocations(table(spark, rows).limit(0))) == []


def test_products_past_64_bits(spark):
    """The score's arithmetic, on counts no test table has."""
    a, n, l, r = 9 * 10**14, 9 * 10**15, 10**15 - 1, 9 * 10**14 + 7
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(phrases.score().alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)


def test_top_of_many_parts(spark):
    """More candidates than a rank's parts keep: the first of the language are the same."""
    rows = [("en", " ".join(f"x{i % 97} y{i * 7 % 101} z{i % 13}" for i in range(k, k + 40))) for k in range(0, 900, 9)]
    assert got(phrases.collocations(table(spark, rows), top=3, least=2)) == brute(rows, 2, 3)


def test_packed_numbers_take_less_than_plain_ones_and_return():
    import numpy as np
    import zstandard

    rng = np.random.default_rng(3)
    arrays = [np.sort(rng.integers(0, 20_000, 5_000)), rng.integers(0, 20_000, 5_000), np.zeros(0, np.int64), np.array([2**31 - 1])]
    data = phrases._packed(*arrays)
    plain = zstandard.ZstdCompressor(level=3).compress(b"".join(a.astype("<i4").tobytes() for a in arrays))
    assert len(data) < 0.9 * len(plain)
    assert [x.tolist() for x in phrases._unpacked(data)] == [x.tolist() for x in arrays]


def test_a_run_is_dealt_as_one_batch_of_pieces():
    """Many small pieces cost what a few large ones do: one batch a run, each piece with its own words and numbers."""
    import numpy as np
    import pyarrow as pa

    class Runs:  # stands for a table: hands out the function that deals
        sparkSession = type("S", (), {"sparkContext": type("C", (), {"broadcast": lambda self, x: type("B", (), {"value": x})()})()})()

        def select(self, *columns):
            return self

        def mapInArrow(self, deal, schema):
            return deal

    rng = np.random.default_rng(1)
    names = [b".", *sorted({b"w%d" % i for i in range(400)})]
    columns = phrases._suffixes(rng.integers(0, len(names), 6000).astype(np.int32), 5)
    *columns, f = phrases.sorted_suffixes(columns, np.ones(len(columns[0]), np.int64))
    run = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([phrases._words(names)], pa.binary()),
                                      pa.array([phrases._packed(*columns, f)], pa.binary())], ["lang", "words", "suffixes"])
    out = list(phrases._dealt(Runs(), [{"en": {b"w7"}}], 50, 5)(iter([run])))
    assert len(out) == 1 and len(set(out[0].column(0).to_pylist())) == out[0].num_rows > 40
    found = []
    for _, _, words, data in phrases._each(out[0]):
        used, (*own, counts, root) = phrases._read_words(words), phrases._unpacked(data)
        assert used == sorted(set(used)) and used[0] == b"."
        found += [(*(used[i] for i in row), n, r) for *row, n, r in zip(*own, counts.tolist(), root.tolist())]
    assert sorted(found) == sorted(
        (*(names[i] for i in row), n, 2 if names[row[0]] == b"w7" else 1) for *row, n in zip(*columns, f.tolist())
        if not (names[row[0]] == b"w7" and row[1] == 0))


def test_rows_are_ordered_past_64_bits():
    import numpy as np

    rng = np.random.default_rng(2)
    for top in (1, 3, 2**20, 2**31 - 1):
        rows = rng.integers(0, top + 1, (6, 500)).astype(np.int32)
        rows[:, 250:] = rows[:, :250]
        *columns, total, extra = phrases.sorted_suffixes(list(rows), np.ones(500, np.int64), (rows[0],))
        want = Counter(map(tuple, rows.T.tolist()))
        assert list(zip(*(c.tolist() for c in columns))) == sorted(want)
        assert total.tolist() == [want[k] for k in sorted(want)] and extra.tolist() == columns[0].tolist()
    assert phrases.sorted_suffixes([np.zeros(0, np.int32)] * 5, np.zeros(0, np.int64))[0].tolist() == []
