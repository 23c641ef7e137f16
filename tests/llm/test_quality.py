import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import CLASHES, DOC_COLUMNS, docs, edge_texts
from ledgerlane.llm import quality


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    got = quality.score(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), model).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    seen = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in seen]) >= 0.9
    assert np.mean([b for a, b in seen if a == 1]) >= 0.95  # clean documents stay


def test_no_label_of_the_held_out_fold_is_learnt(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert all(quality.fold_of(r.doc_id) != 2 for r in quality.training_ids(labels).collect())
    few = quality.training_ids(labels, per_class=10).collect()
    assert Counter(r.label for r in few) == {0: 10, 1: 10}


def test_edges(spark, model):
    rows = edge_texts()
    got = quality.score(docs(spark, rows), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[2]) == 1 and by[1] == by[2] and by[4] == by[5]  # equal texts; null and empty
    kept = quality.keep_good(docs(spark, rows), model)
    assert kept.columns == [*DOC_COLUMNS, *CLASHES]
    want = Counter(i for i, t, _ in rows if i is not None for s in [next(iter(by[i]))] if s >= 0.7)
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_without_labels_or_rows(spark, model):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs(spark, edge_texts()), none) is None
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (None, 0, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs(spark, edge_texts()), one) is None
    got = quality.score(docs(spark, edge_texts()), None).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 0)}
    assert quality.keep_good(docs(spark, edge_texts()), None).count() == len(edge_texts())
    assert quality.score(docs(spark, []), model).count() == 0


def test_score_ignores_everything_but_the_text(spark, model):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(50)
    moved = table.withColumns({"doc_id": F.col("doc_id") + 10 ** 6, "lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    a = [r.score for r in quality.score(table, model).orderBy("doc_id").collect()]
    assert a == [r.score for r in quality.score(moved, model).orderBy("doc_id").collect()]


def test_many_rows_of_one_labelled_id_weigh_as_one(spark, model):
    table, labels = (spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("documents", "labels"))
    ids = quality.training_ids(labels).filter(F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 1)
    hot = table.join(ids.filter("label = 1").orderBy("doc_id").limit(1).select("doc_id"), "doc_id").select(table.columns)
    assert hot.count() == 1
    many = quality.fit(table.union(hot.crossJoin(spark.range(300)).select(table.columns)), labels)
    assert (many.good, many.bad) == (model.good, model.bad)
    assert np.allclose(many.curve, model.curve) and np.allclose(many.scale, model.scale)
