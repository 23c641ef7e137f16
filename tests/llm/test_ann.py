import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlane.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {c: F.lit(1) for c in ("shard", "block", "vector", "score", "rank", "query_id", "label")})


def brute(rows, k=20):
    fine = [(i, np.asarray(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % 20 == 0:
            near = {(-float(v @ q), j) for j, v in fine if j != i and len(v) == len(q)}
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def check(spark, rows, recall=0.9, **options):
    got = {}
    for r in sorted(ann.search(table(spark, rows), F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows)
    assert set(got) == {q for q, near in want.items() if near}
    hit = total = 0
    for q, near in got.items():
        true = dict(want[q])
        assert [r["rank"] for r in near] == list(range(1, len(near) + 1)) and len(near) == len(true)
        order = [(-r.score, r.vec_id) for r in near]
        assert order == sorted(order) and q not in {r.vec_id for r in near}
        vectors = {i: np.asarray(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v}
        for r in near:
            if sum(i == r.vec_id for i, _ in rows) == 1 and sum(i == q for i, _ in rows) == 1:
                assert abs(r.score - float(vectors[r.vec_id] @ vectors[q])) < 1e-9
        hit += len({r.vec_id for r in near} & set(true))
        total += len(true)
    assert total == 0 or hit / total >= recall


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (20, [0.0, 2.0]), (4, None), (5, []),
            (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (40, None), (60, [nan, 0.0]),
            (10, [1.0, 2.0, 3.0]), (80, [3.0, 2.0, 1.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [100.0, 100.0])]
    check(spark, rows, recall=1.0)


def test_empty_table_and_lone_query(spark):
    check(spark, [])
    check(spark, [(0, [1.0, 2.0])])


def test_copies_and_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal(16).tolist()
    rows = [(i, v) for i in range(100)] + [(100 + i, rng.standard_normal(16).tolist()) for i in range(200)]
    got = ann.search(table(spark, rows), F.col("vec_id") == 40, shard_rows=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


@pytest.mark.parametrize("scale", [0, 1])
def test_recall_with_many_shards_and_unequal_norms(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(32) * np.exp(scale * rng.standard_normal() / 2)).tolist()) for i in range(1500)]
    check(spark, rows, shard_rows=400, query_rows=30)


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check(spark, rows)
