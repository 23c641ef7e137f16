from collections import Counter

import numpy as np

import corpus_pipeline
from conftest import SF_TINY
from helpers import CLASHES, DOC_COLUMNS, docs, edge_texts
from ledgerlane.llm.queries import QUERIES


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names)


def test_stages_on_the_table(spark, tmp_path):
    before = docs_ = spark.read.parquet(f"{SF_TINY}/documents.parquet")
    counts = [before.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, SF_TINY)
        assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs_ = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs_.count())
        if name != "source_mix":
            assert docs_.select("doc_id").distinct().count() == counts[-1] <= counts[-2]
        assert counts[-1] > 0
    mixed = Counter(r.doc_id for r in docs_.select("doc_id").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, SF_TINY).collect()
    ends = Counter(r.doc_id for r in packed if np.frombuffer(bytes(r.ids), "<u4")[-1] == 0 and r.start + r.length == r.doc_tokens)
    assert ends == mixed


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF_TINY)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset", "ids"} <= set(rows.columns)


def test_stages_stand_edge_rows_and_no_rows(spark, tmp_path):
    for rows, at in ((edge_texts(), "edge"), ([], "none")):
        now = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF_TINY)
            if name != "packing":
                assert out.columns == [*DOC_COLUMNS, *CLASHES]
            out.write.parquet(f"{tmp_path}/{at}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{at}-{name}")
