import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_TINY
from helpers import CLASHES, DOC_COLUMNS, docs, edge_texts, prose
from ledgerlane.llm import components, ngram


def shingle_set(text, n):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, threshold):
    """(id -> size set, id -> least id) with every pair compared."""
    a, b = threshold
    sets, parent = defaultdict(set), {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, shingle_set(t, n)) for i, t, _ in rows]
    for i, s in items:
        sets[i].add(len(s))
    for k, (i, s) in enumerate(items):
        for j, t in items[:k]:
            if i is not None and j is not None and s and t and b * len(s & t) >= a * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in parent}


def check(spark, rows, n=4, threshold=(85, 100)):
    got = ngram.components(docs(spark, rows), n, threshold).collect()
    sets, comp = brute(rows, n, threshold)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    for r in got:
        assert r.n_shingles in sets[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else comp[r.doc_id]), r


def edits(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_edges(spark):
    check(spark, edge_texts())
    check(spark, edge_texts(), 5, (80, 100))


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_match_brute_force(spark, seed):
    """Chains of edits, with similarities on both sides of the threshold, sizes from one word up."""
    rng = random.Random(seed)
    rows = []
    for family in range(12):
        text = prose(rng, rng.choice([1, 3, 4, 5, 12, 40, 150, 700]), 3000)
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows) * 3 + 1, text, "a"))
            text = edits(rng, text, rng.choice([0, 1, 1, 2, 4]))
    rng.shuffle(rows)
    check(spark, rows)


def test_shared_passage_links_nothing_by_itself(spark):
    rng = random.Random(9)
    passage = prose(rng, 60, 3000)
    check(spark, [(k, passage + " " + prose(rng, 200, 9000), "a") for k in range(30)])


def test_large_group_in_tiles(spark):
    """Groups beyond a tile: by hash first, by all pairs of tiles then."""
    rng, tile = random.Random(4), ngram.TILE
    base = prose(rng, 80, 3000)
    rows = [(k, edits(rng, base, rng.choice([0, 1, 1, 2])), "a") for k in range(60)]
    rows += [(100 + k, edits(rng, base, 12), "a") for k in range(10)]
    ngram.TILE = 7
    try:
        check(spark, rows)
    finally:
        ngram.TILE = tile


def test_bound_never_cuts_a_link():
    """Trees give every pair whose true similarity reaches the threshold, at any folding."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 900))
        base = rng.choice(1 << 62, n, replace=False).astype(np.uint64)
        sets = []
        for _ in range(40):
            keep = base[rng.random(n) > rng.choice([0, 0.02, 0.1, 0.3])]
            more = rng.choice(1 << 62, int(rng.integers(0, max(1, n // 6) + 1))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([keep, more])))
        sets = [s for s in sets if len(s)]
        sizes = np.array([len(s) for s in sets])
        vectors = [ngram.read_vector(ngram.count_vector(s), len(s)) for s in sets]
        found = set(ngram.links(np.arange(len(sets)), sizes, vectors, np.arange(len(sets)), (85, 100), False))
        found |= {(b, a) for a, b in found}
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in found


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(50)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(50)}}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_and_kept_rows(spark):
    check(spark, [])
    rows = edge_texts()
    table = docs(spark, rows)
    kept = ngram.keep_first(table)
    assert kept.columns == [*DOC_COLUMNS, *CLASHES]
    _, comp = brute(rows, 5, (80, 100))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in rows if i is None or comp[i] == i)


def test_table(spark):
    table = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    check(spark, [(r.doc_id, r.text, r.source) for r in table.collect()])
    assert table.filter(F.col("text").isNull()).count() >= 0


def test_group_below_the_threshold_makes_no_pairs():
    """Sets of similarity 0.84 pass the bound of their counts in 256 groups, not that of their sketches."""
    rng = np.random.default_rng(7)
    base = rng.choice(1 << 62, 200).astype(np.uint64)
    sets = []
    for k in range(60):
        own = base.copy()
        own[(np.arange(9) + 9 * k) % 200 if k < 22 else rng.choice(200, 9, replace=False)] = rng.choice(1 << 62, 9)
        sets.append(np.unique(own))
    alike = sum(100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for i, x in enumerate(sets) for y in sets[:i])
    vectors = [ngram.read_vector(ngram.count_vector(s), len(s)) for s in sets]
    found = ngram.links(np.arange(60), np.array([len(s) for s in sets]), vectors, np.arange(60), (85, 100), False)
    points = [ngram.point(v) for v in vectors]
    bound = sum(185 * np.minimum(x, y).sum() >= 85 * (len(vectors[i]) + len(vectors[j]))
                for i, x in enumerate(points) for j, y in enumerate(points[:i]))
    assert alike <= len(found) < 1.2 * alike < bound / 2
