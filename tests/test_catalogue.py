"""Every registered query against the SQL of another engine, on the smallest data."""

import os

import duckdb
import pytest

from mnemo.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df, columns):
    plain = df[columns].astype(object)
    plain = plain.where(plain.notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v))
    return plain.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, other, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = other.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(want.columns)
        assert rows(got, columns).equals(rows(want, columns))
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())


# Of the derived tables only memories have columns that the files hold as such; tests/test_store.py has the reads of stored tables.
@pytest.mark.parametrize("name", ["mem_by_namespace", "mem_by_scope_entity"])
def test_filters_reach_the_scan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan.split("FileScan")[1]
