"""Every registered query against its DuckDB oracle (or, without one, a smoke run)."""

import duckdb
import pytest

import __spark_entry__ as E
from quarry.plans.tables import SCHEMAS
from tools.oracle_check import rows_of

from .conftest import SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()
HEAVY = {"cv_forest", "cv_boosted", "tune_grid", "sampled_shapley"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in SCHEMAS:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.sql(ORACLE[name]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - HEAVY))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == len(SCHEMAS["orders"])
    assert df.columns == ["column_name", "position", "dtype", "kind", "n_rows", "missing_rate", "is_constant"]
