import random
from collections import Counter

import pytest

from conftest import SF_TINY
from helpers import CLASHES, DOC_COLUMNS, docs, edge_texts, prose, words
from ledgerlane.llm import lines


def brute(rows, threshold=(80, 100), least=1):
    """Texts without the lines that an earlier line matches, and which of a text's words are left."""
    a, b = threshold
    seen, out = [], {}
    texts = sorted({(i is None, i or 0, t) for i, t, _ in rows if t}, key=lambda r: r[:2])
    assert len({r[:2] for r in texts}) == len(texts)
    for missing, i, t in texts:
        kept = []
        for line in t.split("\n"):
            s = frozenset(words(line))
            hit = len(s) >= least and any(
                b * len(s & o) >= a * len(s | o) for o in seen if 4 * len(o) <= 5 * len(s) and 4 * len(s) <= 5 * len(o))
            if len(s) >= least:
                seen.append(s)
            if not hit:
                kept.append(line)
        out[None if missing else i] = "\n".join(kept)
    return out


def check(spark, rows):
    want = brute(rows)
    got = lines.dedup(docs(spark, rows), drop_emptied=False)
    assert got.columns == [*DOC_COLUMNS, *CLASHES]
    found = Counter((r.doc_id, r.text) for r in got.collect())
    assert found == Counter((i, want[i] if t else t) for i, t, _ in rows)
    left = lines.dedup(docs(spark, rows))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(
        (i, want[i] if t else t) for i, t, _ in rows if not t or want[i] == t or words(want[i]))


def unique(rows):
    """One text for an id: the order of two texts of one id is by hash."""
    first = {}
    for i, t, s in rows:
        first.setdefault(i, t)
    return [(i, t, s) for i, t, s in rows if first[i] == t]


def test_edges(spark):
    check(spark, unique(edge_texts()))


@pytest.mark.parametrize("seed", range(3))
def test_near_lines_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([2, 3, 4, 5, 9, 20, 60, 150]), 500) for _ in range(25)]

    def line():
        w = rng.choice(pool).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        return rng.choice(["", " "]).join([" ".join(w)]) if rng.random() < 0.9 else ""

    check(spark, [(k * 2, "\n".join(line() for _ in range(rng.randrange(1, 8))), "a") for k in range(40)])


def test_hot_line_and_group_of_near_lines(spark):
    rng = random.Random(1)
    base = prose(rng, 40, 2000).split(" ")
    rows = []
    for k in range(80):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        rows.append((k, "the very common line of all documents\n" + " ".join(w) + "\n" + prose(rng, 12, 9000), "a"))
    check(spark, rows)


def test_empty_table(spark):
    assert lines.dedup(docs(spark, [])).count() == 0
    assert lines.removed_per_document(docs(spark, [])).count() == 0


def test_table(spark):
    table = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    check(spark, [(r.doc_id, r.text, r.source) for r in table.collect()])


def test_no_python_runs(spark):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        lines.dedup(spark.read.parquet(f"{SF_TINY}/documents.parquet")).explain("formatted")
    assert not any(w in out.getvalue() for w in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_short_lines_go_in_the_query_and_the_pipeline(spark, tmp_path):
    """Lines of one or two words: menu entries, and scripts that set no blanks."""
    import corpus_pipeline
    from ledgerlane.llm.queries import op10_lines
    rng = random.Random(7)
    short = ["Read more", "more Read", "Share this", "Home", "\u4eca\u5929\u5929\u6c14\u5f88\u597d", "Read", "a b c", "a b d", "a b c d", "a b c d e"]
    rows = [(k, "\n".join(rng.choice([*short, prose(rng, 12, 300)]) for _ in range(rng.randrange(1, 6))), "a") for k in range(60)]
    want = brute(rows)
    assert any(not words(t) for t in want.values())
    table = docs(spark, rows, clash=False)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in op10_lines(spark, str(tmp_path)).collect()} == want
    left = corpus_pipeline.line_dedup(spark, table, SF_TINY).collect()
    assert {r.doc_id: r.text for r in left} == {i: t for i, t in want.items() if words(t)}


def test_removed_lines_are_counted_where_all_go(spark):
    rows = [(1, "one line of five words", "a"), (2, "one line of five words", "a"), (3, None, "a"), (4, "", "a"),
            (5, "one line of five words\none line of five words", "a"), (6, "a line of its own\none line of five words", "a"),
            (7, "one line of five words\n", "a")]
    got = lines.removed_per_document(docs(spark, rows))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == {
        1: (1, 0, rows[0][1]), 2: (1, 1, ""), 3: (1, 0, None), 4: (1, 0, ""), 5: (2, 2, ""),
        6: (2, 1, "a line of its own"), 7: (2, 1, "")}


def test_rounds_part_the_prefix_words(spark):
    """Each prefix word of each line is dealt in one round, so that the disk holds one round's buckets."""
    from pyspark.sql import functions as F

    rows = [(k, 5, [k, -7 * k, 3], k * 11) for k in range(40)] + [(99, 2, None, 0)]
    firsts = spark.createDataFrame(rows, "lid long, n int, prefix array<int>, map long").withColumn(
        "place", F.struct(F.col("lid").alias("doc_id")))
    dealt = [[(r.lid, r.pos, r.key) for r in lines._dealt(firsts, k).collect()] for k in range(lines.ROUNDS)]
    assert sorted(sum(dealt, [])) == sorted((k, i, w) for k, _, p, _ in rows for i, w in enumerate(p or []))
    assert lines.ROUNDS > 1 and max(map(len, dealt)) < 120


def test_unrelated_long_lines_are_told_apart_before_their_words_are_read(spark, monkeypatch):
    """Long lines share prefix words, but few pairs of them pass the bound by word maps."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.sample([f"w{i}x" for i in range(900)], 150)), "a") for k in range(60)]
    rows += [(100 + k, " ".join(rows[k][1].split(" ")[:-8]), "a") for k in range(5)]
    asked, matched = [], lines._matched

    def counted(pairs, *more):
        asked.append(pairs.count())
        return matched(pairs, *more)

    monkeypatch.setattr(lines, "_matched", counted)
    left = lines.dedup(docs(spark, rows, clash=False))
    assert {r.doc_id for r in left.collect()} == set(range(60))
    assert 5 <= sum(asked) <= 20
