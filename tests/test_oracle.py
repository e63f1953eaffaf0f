"""Every query with SQL equals it on DuckDB; the others return rows."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as e
from solvelake.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = ORACLES.get(name)
    if sql is None:
        assert QUERIES[name](spark, SMALL).columns
    else:
        oracle.compare(spark, con, QUERIES[name], sql, SMALL)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_entry_reads_rows(spark):
    df = e.entry(spark)
    assert df.columns == ["team_id", "score", "time"]
    assert df.count() > 0
