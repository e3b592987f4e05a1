"""Queries that SQL can express, against their SQL."""

import glob
import os

import compare
import duckdb
import pytest

from tidebook.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    result = db.execute(oracles.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert compare.rows(frame.columns, frame.collect()) == compare.rows(names, result.fetchall())
