"""Helpers shared by the operators: staged tables, word columns, fresh column names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.session import ship  # noqa: F401

#: White space of the word rule: blank, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``, or,
    where the session names none (tests), a folder beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are removed at its end, but for those staged to ``last``, which
    belong to the block around it: what is read later must be written, in full, to such a table first."""
    outer, paths = _PASSING.get(), []
    _PASSING.set((*outer, paths))
    try:
        yield
    finally:
        _PASSING.set(outer)
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, label: str, last: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives
    lost executors, and gives the planner the true size. ``passing`` removes it, or else the folder's owner."""
    spark = df.sparkSession
    path, was = staged_path(spark, label), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # once written, what was shuffled for it may go
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    owners = _PASSING.get()[:-1] if last else _PASSING.get()
    if owners:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Tables written within the block pass rows to Python in batches of so many at most: long rows, such as texts,
    then take little memory on either side. The session gets its own setting back."""
    was = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, was)


def local_path(uri: str) -> str:
    """``file:`` URIs in any of their spellings as a plain path; other URIs unchanged."""
    return "/" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df`` (which compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Words of a text: maximal runs without white space; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dense_array(counts: DataFrame, size: int) -> DataFrame:
    """One row, one column ``cells``: the counts (idx, n) of a table of fixed ``size`` as an array,
    0 where idx has none. Built from blocks of 1024 cells."""
    spark = counts.sparkSession
    every = spark.range(size).join(counts.select(F.col("idx").cast("long").alias("id"), "n"), "id", "left")
    blocks = (every.select("id", F.coalesce("n", F.lit(0)).alias("n"))
              .groupBy(F.floor(F.col("id") / 1024).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("part")))
    return blocks.agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "part"))),
        lambda b: F.transform(b["part"], lambda x: x["n"]))).alias("cells"))
