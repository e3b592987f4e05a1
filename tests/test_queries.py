"""Queries against their SQL on the small tables; ``compare.py`` does the same for all of them at any scale."""

import glob
import os

import compare
import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
QUICK = (
    "binance_spot_trades", "gateio_perp_trades", "records_outcome", "futures_daily", "csv_rejects", "gateio_spot_depth_levels", "futures_trades", "classify_counts",
    "channel_ids", "channel_collisions", "registry_config", "enrich_left_defaults", "valid_timestamps", "book_long",
    "book_asof", "book_snapshots", "topics_sent", "batch_commits", "partition_bounds", "degraded_replay", "latency_last", "sequence_gaps",
    "book_at_times", "deep_book_levels", "csv_orderbook", "bucketed_join",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_its_sql():
    from tidebook.plans.queries import QUERIES

    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, db, name):
    frame = contract.queries()[name](spark, SF_DIR)
    result = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert compare.rows(frame.columns, frame.collect()) == compare.rows(names, result.fetchall())


def test_topics_gather_no_table_at_the_driver(spark):
    frame = contract.queries()["topics_sent"](spark, SF_DIR)
    assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert contract.entry(spark).count() > 0
