"""Paths that only many columns, many categories or odd names reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import drift, evaluate, explain, prep, sessions
from quarry.sources import files


def test_correlated_pairs_of_300_columns_with_gaps(spark):
    k, n = 300, 400
    rnd = np.random.RandomState(2)
    x = rnd.normal(size=(n, 6)) @ rnd.normal(size=(6, k)) + rnd.normal(size=(n, k)) + rnd.normal(size=k) * 1e4
    x[rnd.rand(n, k) < 0.2] = np.nan
    x[:, 7] = 3.25  # constant
    x[:, 9] = np.nan  # missing
    names = ["it's", "a`b".replace("`", "´"), *[f"c{i}" for i in range(2, k)]]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"x{i} double" for i in range(k))).toDF(*names).repartition(5)
    got = explain.correlated_pairs(df, names).collect()
    assert len(got) == k * (k - 1) // 2
    at = {n_: i for i, n_ in enumerate(names)}
    rnd2 = random.Random(0)
    for r in rnd2.sample(got, 3000) + [r for r in got if {r["feature_a"], r["feature_b"]} & {"c7", "c9", "it's"}]:
        i, j = at[r["feature_a"]], at[r["feature_b"]]
        assert i < j and r["pair_index"] == i * (2 * k - i - 1) // 2 + j - i - 1
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        if both.sum() < 2 or a.std() == 0 or b.std() == 0:
            assert r["corr"] is None and not r["above_limit"]
        else:
            c = np.corrcoef(a, b)[0, 1]
            assert abs(r["corr"] - c) < 2e-6 and r["above_limit"] == (abs(c) > explain.CORR_LIMIT)


def test_correlated_pairs_of_few_columns_and_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert explain.correlated_pairs(df, ["a"]).count() == 0
    assert [r["corr"] for r in explain.correlated_pairs(df, ["a", "b"]).collect()] == [None]
    assert [r["corr"] for r in explain.correlated_pairs(df.filter("a > 9"), ["a", "b"]).collect()] == [None]


def test_dictionary_of_many_categories(spark):
    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("v"), F.pmod(F.col("id") * 7919, F.lit(n))).alias("it's"),
                               F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("few"), F.col("id").alias("value"))
    cats = prep.category_index(df, ["it's", "few"])
    assert cats.widths == {"it's": n, "few": 1}
    own = cats.index.filter(F.col("column_name") == "it's").orderBy("value").select("index").collect()
    assert [r["index"] for r in own] == list(range(n))
    ask = df.limit(50).unionByName(spark.createDataFrame([("new", "hot", -1), (None, None, -2)], df.schema))
    out = prep.onehot_long(ask, cats, ["it's", "few"], ["value"])
    assert out.columns == ["value", "column_name", "value", "onehot_index", "width"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 104
    place = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(n)))}
    for _, col, value, hot, width in rows:
        assert width == cats.widths[col] and hot == (place.get(value) if col == "it's" else 0 if value == "hot" else None)


def test_more_than_five_pairs_are_listed(spark):
    from quarry.plans import gate_plans
    assert not hasattr(gate_plans, "MAX_PAIRS_LISTED")
    base = [float(i) for i in range(50)]
    df = spark.createDataFrame([(v, 2 * v, 3 * v + 1, -v, float(int(v) % 7)) for v in base], "a double, b double, c double, d double, e double")
    assert explain.correlated_pairs(df, list("abcde")).filter("above_limit").count() == 6


@pytest.mark.parametrize("limit", [5, 20_000])
def test_scores_that_are_no_numbers_count_as_missing(spark, monkeypatch, limit):
    monkeypatch.setattr(evaluate, "DISTINCT_SCORES_PER_BUCKET", limit)
    rows = [(i % 2, float(i % 40) + 3 * (i % 2)) for i in range(400)]
    odd = rows + [(1, math.nan), (0, math.nan), (1, None), (None, 3.0), (1, math.inf), (0, -math.inf)]
    kept = rows + [(1, math.inf), (0, -math.inf)]

    def auc(r):
        df = spark.createDataFrame(r, "y int, s double")
        return evaluate.auc(df, F.col("y"), F.col("s")).collect()[0]
    assert auc(odd) == auc(kept)
    assert evaluate.pr_curve(spark.createDataFrame(odd, "y int, s double"), F.col("y"), F.col("s")).filter(F.isnan("threshold")).count() == 0


def test_whole_numbers_keep_their_digits(spark):
    rows = [("9223372036854775807", "9223372036854775808", "12345678901234567890123456789012345678", "1" * 39, "12", "1.5"),
            ("1234567890123456789", "-1", "7", "2", "-9223372036854775808", "9999999999999999999")]
    df = spark.createDataFrame(rows, "i string, w string, x string, d string, j string, f string")
    path = files.write_dataset(df, files.scratch_path(spark, "digits") + ".csv", "csv")
    got = files.load_dataset(spark, path)
    assert dict(got.dtypes) == {"i": "bigint", "w": "decimal(38,0)", "x": "decimal(38,0)", "d": "double", "j": "bigint", "f": "double"}
    assert {str(r["i"]) for r in got.collect()} == {r[0] for r in rows} and {str(r["x"]) for r in got.collect()} == {r[2] for r in rows}


def test_any_column_name_passes(spark):
    rnd = np.random.RandomState(1)
    names = ["it's", 'a"b', "x y", "d.e"]
    df = spark.createDataFrame([(int(i % 3), *map(float, rnd.normal(size=4))) for i in range(200)],
                               "g int, a double, b double, c double, d double").toDF("g", *names)
    assert {r["column_name"] for r in drift.psi(df, df, names).collect()} == set(names)
    assert explain.correlated_pairs(df, names).count() == 6
    flags = sessions.session_flags(df.withColumn("it's", F.lit(None).cast("double")), "g")
    assert "it's" in {r["feature"] for r in flags.collect()}
    plan = prep.fit_prep(df, names)
    assert {r["feature"] for r in prep.plan_rows(df, plan).collect()} == set(names)
    assert prep.transform(df, plan, ["g"]).count() == 200
