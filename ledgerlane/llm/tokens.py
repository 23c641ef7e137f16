"""Token ids in ORC files: stripes of run-length coded integers, row indexes, Bloom filters.

``write_tokens`` deals the documents by range of their id, so that the files, in the order
of their shard number, hold them in ascending order (null ids first). Each row keeps its
place within its shard; ``read_tokens`` adds what the shards before it hold. Stripes are
read in parallel, and a filter on ``doc_id`` skips stripes and row groups by their
statistics and Bloom filters.

Null texts count as empty: just the end id. Rows with equal ids stay apart, in any order.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import ship, small_batches
from ledgerlane.llm.tokenizer import encoder

SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, ids array<int>"
_FLUSH_IDS = 250_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 0, shards: int | None = None,
                 stripe_bytes: int = 64 << 20, index_stride: int = 10_000) -> None:
    """Encode every text, append ``end_id``, write ORC under ``path``. ``shards``: number of
    files at least asked for; by default the session's shuffle partitions."""
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            ids: list = []
            starts: list[int] = []
            parts: list[bytes] = []
            sizes: list[int] = []
            held = 0

            def rows() -> pa.RecordBatch:
                values = pa.Array.from_buffers(pa.int32(), held, [None, pa.py_buffer(b"".join(parts))])
                offsets = pa.array([0, *sizes], pa.int64()).to_numpy().cumsum().astype("int32")
                return pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                ], ["shard", "doc_id", "local_start", "n_tokens", "ids"])

            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = enc.encode(text.as_py()) + end
                ids.append(doc_id.as_py())
                starts.append(start)
                parts.append(data)
                sizes.append(len(data) // 4)
                start += sizes[-1]
                held += sizes[-1]
                if held >= _FLUSH_IDS:
                    yield rows()
                    ids, starts, parts, sizes, held = [], [], [], [], 0
            if ids:
                yield rows()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                         F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]  # equal ids may be dealt apart
    dealt = source.repartitionByRange(shards, *order) if shards else source.repartitionByRange(*order)
    with small_batches(docs.sparkSession):
        (dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, SCHEMA)
            .write.option("orc.compress", "ZSTD").option("orc.stripe.size", str(stripe_bytes))
            .option("orc.create.index", "true").option("orc.row.index.stride", str(index_stride))
            .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
            .orc(path))


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows (shard, doc_id, local_start, n_tokens, ids); ``where`` is pushed to the files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if where is None else rows.filter(where)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_start): ids in the shards before. One row per file meets in the window."""
    totals = (spark.read.schema(SCHEMA).orc(path).groupBy("shard")
              .agg(F.sum("n_tokens").alias("total")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shard_start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            data = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            n = pa.array(offsets[1:] - offsets[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), n, pa.array(crc, pa.int64())],
                ["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("shard", "doc_id", "local_start", "ids").mapInArrow(
        digest, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(spark, path), "shard").select(
        "doc_id", (F.col("local_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
