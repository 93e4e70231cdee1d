"""Layer 1: every SQL-checkable query against its DuckDB oracle (order-insensitive)."""

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402
from tabsieve.plans.inputs import TABLES

from scripts_compare import digest  # noqa: E402

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLES[key]).fetchdf()
    assert len(got) == len(want)
    assert sorted(got.columns) == sorted(want.columns)
    assert digest(got)[0] == digest(want)[0]


def test_every_query_has_callable():
    assert set(ORACLES) <= set(QUERIES)
