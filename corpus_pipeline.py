"""From documents to packed training sequences: quality, line dedup, near duplicates, mixing, packing.

Each stage takes what its predecessor kept, written as Parquet in between, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlane.llm import lines, mix, ngram, pack, quality
from ledgerlane.llm.common import staged, table
from ledgerlane.llm.queries import vocabulary_path

#: No stage is SQL end to end (compression, token ids): the stages are tested by brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier line; documents go that lose all their words."""
    return lines.dedup(docs, least=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more."""
    return ngram.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids: a row per piece, with its ids."""
    return pack.pack_documents(docs, vocabulary_path())


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
