"""Session construction and the few cluster-facing helpers every job shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings every job relies on. AQE re-plans joins and partition counts at
# runtime; skew-join splitting keeps one hot SKU or order from owning a task.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # transformWithState needs the RocksDB state store.
    STATE_STORE: ROCKSDB,
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "ledgerlane", extra: dict | None = None) -> SparkSession:
    """A session for tests, the bench and local runs. On a cluster, pass the
    cluster's master and a partition count sized to the data instead."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g"))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever store the session names: a query
    takes its settings when it starts. The session may be anyone's, so it gets its own back."""
    was = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, was)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, for checkpoints and intermediate
    tables: ``spark.checkpoint.dir``, else a folder in the session's warehouse (which a
    cluster shares too). There is no machine-local fallback."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return f"{warehouse.rstrip('/')}/_ledgerlane"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique location in the shared folder. Whoever owns that folder removes old ones:
    results are read from them lazily, so the library can't."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions_for(df: DataFrame, partition_bytes: int = 128 << 20, least: int | None = None) -> int:
    """Partition count for a split of ``df``: one per ``partition_bytes`` of what the planner
    expects to read, and at least ``least``, by default the session's shuffle partitions, which also hold
    where the planner knows no size (it then says the largest number there is)."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if planned >= 1 << 62:
        return max(own, least or 0)
    return max(own if least is None else least, -(-planned // partition_bytes))


def cores(spark: SparkSession) -> int:
    """How many tasks run at once, as the cluster says."""
    return spark.sparkContext.defaultParallelism


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context, so that functions
    which run there find it whatever path they were started with."""
    context = spark.sparkContext
    if getattr(context, "_ledgerlane_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlane-"), "ledgerlane.zip")  # the driver serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(package)))
    context.addPyFile(archive)
    context._ledgerlane_shipped = True
