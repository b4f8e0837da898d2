"""Physical-plan checks: no pairing of all rows with all rows anywhere, and scans read
only the columns a query uses (column pruning reaches the Parquet reader)."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SMALL

QUERIES = E.queries()
# fitted models and queries that run many jobs before their last plan exists (tests/test_oracle.py runs them)
SKIP = {"cv_forest", "cv_boosted", "tune_grid", "cv_logistic", "sampled_shapley", "stream_drift", "forest_attribution",
        "final_importance", "chain_verdict", "version_history", "audit_store_cascade"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_all_pairs_join(spark, name):
    text = plan_text(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def read_schemas(text: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


@pytest.mark.parametrize("name,table_cols", [
    ("auc_binary", {"l_quantity", "l_discount", "l_tax", "l_returnflag"}),
    ("regression_report", {"l_quantity", "l_extendedprice"}),
    ("slices_regression", {"o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus"}),
])
def test_scans_are_pruned(spark, name, table_cols):
    df = QUERIES[name](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    fields = [set(re.findall(r"(\w+):", s)) for s in read_schemas(text)]
    assert fields, text
    assert any(f == table_cols for f in fields), fields
    for f in fields:
        assert len(f) <= 6, f
