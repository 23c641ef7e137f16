"""T1 in a program that is started elsewhere: workers can't import the package by path."""

import os
import subprocess
import sys
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import ROOT, SF_TINY

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from ledgerlane.session import build_session
from ledgerlane.streaming.catalog import s_live_window_revenue
spark = build_session("local[2]", 2, extra={"spark.checkpoint.dir": sys.argv[3]})
row = s_live_window_revenue(spark, sys.argv[2]).first()
print("RESULT", row.total_revenue, row.event_count)
"""


def test_live_window_runs_from_another_folder(scratch):
    program = os.path.join(scratch, "program.py")
    with open(program, "w") as f:
        f.write(PROGRAM)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, program, ROOT, SF_TINY, f"file://{scratch}/shared"], cwd=scratch, env=env,
                          capture_output=True, text=True, timeout=400)
    assert "RESULT 40621.1 1000" in done.stdout, done.stderr[-2000:]


DEFAULT_STORE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from ledgerlane.streaming.catalog import s_live_window_revenue
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", sys.argv[3]).getOrCreate())
row = s_live_window_revenue(spark, sys.argv[2]).first()
print("RESULT", row.total_revenue, row.event_count, spark.conf.get("spark.sql.streaming.stateStore.providerClass").split(".")[-1])
"""


def test_live_window_runs_in_a_session_with_the_default_state_store(scratch):
    program = os.path.join(scratch, "program.py")
    with open(program, "w") as f:
        f.write(DEFAULT_STORE)
    events = os.path.join(scratch, "sf")
    os.mkdir(events)
    pq.write_table(pa.table({
        "event_id": [1, 2, 3], "ts": pa.array([datetime(2024, 1, 1)] * 3, pa.timestamp("us")), "user_id": [1, None, 3],
        "event_type": ["click", "error", None], "value": [1.25, 7.0, 2.5], "props": [None, "{}", "{}"]}),
        os.path.join(events, "events.parquet"))
    done = subprocess.run([sys.executable, program, ROOT, events, f"file://{scratch}/shared"], cwd=scratch,
                          capture_output=True, text=True, timeout=400)
    assert "RESULT 3.75 3 HDFSBackedStateStoreProvider" in done.stdout, done.stderr[-2000:]
