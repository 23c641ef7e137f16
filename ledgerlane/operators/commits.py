"""Several tables that become visible together, or not at all.

A batch's tables are written to folders of an attempt of their own, and one small file then says
which attempt the batch consists of. Readers join the tables with these commits, so that they never see
a batch of which a table is missing, nor two attempts of one batch: an attempt that failed half-way
stays out of sight, a repeated one finds the batch committed and does nothing, and where two attempts commit
at once the older one holds. Nothing is renamed or overwritten, so object stores serve as well.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BATCH, ATTEMPT = "batch", "attempt"
COMMIT = StructType([StructField(BATCH, LongType()), StructField(ATTEMPT, StringType())])


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt) of the committed batches under ``root``."""
    path = f"{root}/_commits"
    rows = (spark.read.schema(COMMIT).parquet(path) if exists(spark, path)
            else spark.createDataFrame([], COMMIT))
    return rows.groupBy(BATCH).agg(F.min(ATTEMPT).alias(ATTEMPT))


def is_committed(spark: SparkSession, root: str, batch: int) -> bool:
    return bool(commits(spark, root).filter(F.col(BATCH) == batch).take(1))


def write_together(tables: dict[str, DataFrame], root: str, batch: int) -> bool:
    """Write the tables of a batch and commit them as one; false if the batch was committed before."""
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, root, batch):
        return False
    attempt = f"a{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/{BATCH}={batch}/{ATTEMPT}={attempt}")
    commit = spark.range(1).select(F.lit(batch).cast("long").alias(BATCH), F.lit(attempt).alias(ATTEMPT))
    commit.coalesce(1).write.mode("append").parquet(f"{root}/_commits")
    return True


def read_committed(spark: SparkSession, root: str, name: str, schema: StructType | None = None,
                   with_batch: bool = False) -> DataFrame:
    """The committed rows of a table. The join prunes the folders of other attempts. ``schema``: where
    no batch may have been written yet."""
    path = f"{root}/{name}"
    if schema is not None and not exists(spark, path):
        rows = spark.createDataFrame([], StructType([*schema.fields, *COMMIT.fields]))
    else:
        reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, *COMMIT.fields]))
        rows = reader.parquet(path).withColumn(BATCH, F.col(BATCH).cast("long"))
    seen = rows.join(commits(spark, root), [BATCH, ATTEMPT], "left_semi")
    return seen.drop(ATTEMPT) if with_batch else seen.drop(BATCH, ATTEMPT)
