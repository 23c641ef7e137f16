"""Plan shapes that the design depends on at scale (read from explain)."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from ledgerlane.operators import metrics
from ledgerlane.plans.catalog import BATCH_QUERIES
from ledgerlane.sources import fixtures as fx


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


BATCH = sorted(BATCH_QUERIES)


@pytest.mark.parametrize("name", BATCH)
def test_no_pairwise_joins(spark, name):
    txt = plan_text(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in txt
    assert "BroadcastNestedLoopJoin" not in txt


def test_placement_prunes_and_pre_aggregates(spark):
    txt = plan_text(entry.queries()["placement_decisions"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", txt)
    assert schemas, txt
    for s in schemas:   # only the used columns reach the scans
        used = {"l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"}   # line number: unknown SKUs
        assert len(s.split(",")) <= 4 or {c.split(":")[0] for c in s.split(",")} == used, s
    assert "partial_sum" in txt and "partial_count" in txt   # map-side combine
    assert "BroadcastHashJoin" in txt                          # bounded stock table
    assert "PushedFilters: [IsNotNull(l_quantity)" in txt or "IsNotNull(l_quantity)" in txt


def test_changelog_has_no_global_window_over_rows(spark):
    """The per-event plan reads staged rows and joins a broadcast offsets
    table; the only window runs over per-partition totals."""
    ev = fx.order_events(spark, SF_SMALL)
    txt = plan_text(metrics.revenue_running(ev))
    assert "BroadcastHashJoin" in txt
    main_scan = re.search(r"\(1\) Scan parquet.*?ReadSchema: struct<([^>]*)>", txt, re.S)
    assert main_scan and "_lp_part" in main_scan.group(1)
    assert "running-totals" in txt


def test_window_revenue_is_one_shuffle(spark):
    txt = plan_text(entry.queries()["revenue_tumbling_30s"](spark, SF_SMALL))
    assert len(re.findall(r"Arguments: hashpartitioning", txt)) == 1
    assert "Expand" not in txt


def test_codec_queries_stay_narrow(spark):
    for name in ["decode_order_events", "encode_order_events", "processed_messages"]:
        txt = plan_text(entry.queries()[name](spark, SF_SMALL))
        # no keyed shuffle (a round-robin spread of a single-split file is allowed)
        assert "hashpartitioning" not in txt and "rangepartitioning" not in txt, name
        assert "Python" not in txt and "ArrowEval" not in txt, name


def test_no_broadcast_hint_in_placement(spark):
    """The planner alone picks the stock join: without a threshold nothing is broadcast."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = spark.conf.get(keys[0])
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        txt = plan_text(entry.queries()["placement_decisions"](spark, SF_SMALL))
    finally:
        spark.conf.set(keys[0], before)
        spark.conf.unset(keys[1])
    assert "BroadcastHashJoin" not in txt and "SortMergeJoin" in txt


def test_published_json_is_built_before_the_explode(spark):
    txt = plan_text(entry.queries()["published_events"](spark, SF_SMALL))
    sections = dict(re.findall(r"\n\(\d+\) (\w+)[^\n]*\n(.*?)(?=\n\n\(|\Z)", txt, re.S))
    assert "StructsToJson" not in sections["Generate"]
    before, after = txt.rsplit(") Generate\n", 1)
    assert "StructsToJson" in before and "StructsToJson" not in after   # Spark's name for to_json at run time


def test_changelog_partitions_follow_the_input(spark):
    from ledgerlane.session import partitions_for
    ev = fx.order_events(spark, SF_SMALL)
    assert partitions_for(ev) == 8
    assert partitions_for(ev, partition_bytes=1 << 10) > 8


def test_lines_are_summed_up_in_partitions_that_follow_the_input(spark, monkeypatch):
    """Placement's sums per order and SKU: one shuffle of the lines, in as many partitions as the lines need."""
    from ledgerlane.operators import placement
    from ledgerlane.session import partitions_for
    lines = spark.range(4000).selectExpr("id AS order_key", "concat('s', id % 7) AS sku_code",
                                         "CAST(1.5 AS decimal(18,2)) AS price", "1 AS quantity")
    stock = spark.createDataFrame([(f"s{k}", k) for k in range(7)], "sku_code string, quantity int")
    monkeypatch.setattr(placement, "LINE_PARTITION_BYTES", 1 << 10)
    sums = plan_text(placement.order_totals(lines, stock))
    parts = partitions_for(lines, 1 << 10, least=spark.sparkContext.defaultParallelism)
    assert parts > 40 and f"hashpartitioning(order_key#X, sku_code#X, {parts})" in re.sub(r"#\d+L?", "#X", sums)
    assert partitions_for(lines, 1 << 30, least=3) == 3
    rows = placement.order_totals(lines, stock).agg(F.count(F.lit(1)).alias("n"), F.sum("total_value").alias("v")).first()
    assert (rows.n, float(rows.v)) == (4000, 1.5 * sum(1 for k in range(4000) if k % 7))
