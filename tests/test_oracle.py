"""Every registered query against its DuckDB SQL at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_compare import compare, duck
from ledgerlane.plans.catalog import BATCH_QUERIES
from ledgerlane.streaming.catalog import STREAM_QUERIES

NAMES = sorted({**BATCH_QUERIES, **STREAM_QUERIES})


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    result = compare(df, con, entry.oracle_sql()[name])
    assert result["ok"], result


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_key", "order_number", "order_email", "order_status",
                          "total_order_value"]
    assert df.count() == 1500


@pytest.mark.parametrize("name", ["placement_decisions", "revenue_running", "revenue_tumbling_30s",
                                  "timed_order_events", "stream_revenue_tumbling_30s"])
def test_driver_like_session_settings(spark, con, name):
    """Default partition count and a non-UTC session zone change nothing."""
    saved = {k: spark.conf.get(k) for k in ["spark.sql.shuffle.partitions",
                                            "spark.sql.session.timeZone"]}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        result = compare(entry.queries()[name](spark, SF_SMALL), con, entry.oracle_sql()[name])
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert result["ok"], result
