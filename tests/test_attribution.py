"""Attributions against listing all subsets, on trees, ensembles and other models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from quarry.operators import attribution as A
from quarry.operators import models

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.RandomState(1)
    rows = [(i, *map(float, rnd.randint(0, 9, 3)), rnd.choice(["x", "y", "z", "u"])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, t string")
    df = StringIndexer(inputCol="t", outputCol="d", stringOrderType="alphabetAsc").fit(df).transform(df)
    df = df.withColumn("y", F.col("a") * F.col("b") - 3 * F.col("c") + F.when(F.col("t").isin("x", "z"), F.col("a") * 2).otherwise(0))
    df = df.withColumn("label", (F.col("y") > 8).cast("double"))
    # d carries its categories, so trees split it by sets
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).cache()


def subsets_value(paths, x, known):
    return sum(p.value * math.prod(
        float(c.holds(np.array([x[f]]))[0]) if f in known else c.share for f, c in zip(p.features, p.conditions)) for p in paths)


def shapley(value, m):
    out = []
    for j in range(m):
        rest = [i for i in range(m) if i != j]
        out.append(sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (value({*s, j}) - value(set(s)))
                       for k in range(m) for s in itertools.combinations(rest, k)))
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "forest_class", "boosted_class"])
def test_tree_attributions_equal_enumeration(spark, data, kind):
    est = {"tree": DecisionTreeRegressor(labelCol="y", maxDepth=6), "forest": RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=4, seed=2),
           "boosted": GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=2),
           "forest_class": RandomForestClassifier(numTrees=5, maxDepth=4, seed=2),
           "boosted_class": GBTClassifier(maxIter=4, maxDepth=3, seed=2)}[kind]
    model = est.fit(data)
    paths = A.tree_paths(model)
    rows = data.orderBy("id").limit(25)
    shap = {}
    for r in A.tree_shap(rows, model, "id", FEATURES).collect():
        shap.setdefault(r["id"], {})[r["feature"]] = r["shap"]
    pred = model.transform(rows)
    out = {"forest_class": vector_to_array("probability")[1] if kind == "forest_class" else None,
           "boosted_class": vector_to_array("rawPrediction")[1] if kind == "boosted_class" else None}.get(kind)
    pred = pred.withColumn("out", out if out is not None else F.col("prediction"))
    if kind != "boosted_class":
        assert any(c.allowed is not None for p in paths for c in p.conditions)
    for r in pred.select("id", "out", *FEATURES).collect():
        x = [r[f] for f in FEATURES]
        want = shapley(lambda s: subsets_value(paths, x, s), 4)
        got = [shap[r["id"]][f] for f in FEATURES]
        assert np.allclose(got, want, atol=1e-9)
        assert np.isclose(sum(got), r["out"] - A.expected_value(paths), atol=1e-9)
        assert np.isclose(subsets_value(paths, x, {0, 1, 2, 3}), r["out"], atol=1e-9)


def test_a_tree_without_splits_and_no_rows(spark, data):
    flat = DecisionTreeRegressor(labelCol="one", maxDepth=3).fit(data.withColumn("one", F.lit(5.0)))
    assert {r["shap"] for r in A.tree_shap(data.limit(3), flat, "id", FEATURES).collect()} == {0.0}
    assert A.expected_value(A.tree_paths(flat)) == 5.0
    assert A.tree_shap(data.filter("id < 0"), flat, "id", FEATURES).count() == 0


def test_kernel_attributions_equal_enumeration(spark, data):
    model = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(data)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    raw = data.select("id", *FEATURES)
    back = raw.orderBy("id").limit(7)
    bg = [[r[f] for f in FEATURES] for r in back.collect()]
    got = {}
    for r in A.kernel_shap(lambda df: model.transform(assemble.transform(df)), raw.filter("id in (50, 51)"), back, FEATURES, "id",
                           "prediction").collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["shap"]
    from pyspark.ml.linalg import Vectors
    for r in raw.filter("id in (50, 51)").collect():
        x = [r[f] for f in FEATURES]
        seen = {}

        def value(s):
            k = frozenset(s)
            if k not in seen:
                seen[k] = np.mean([model.predict(Vectors.dense([x[i] if i in k else b[i] for i in range(4)])) for b in bg])
            return seen[k]
        assert np.allclose([got[r["id"]][f] for f in FEATURES], shapley(value, 4), atol=1e-8)
    with pytest.raises(ValueError, match="more than 5"):
        A.kernel_shap(lambda df: df, raw, back, FEATURES, "id", "prediction", max_background=5)
    with pytest.raises(ValueError, match="empty"):
        A.kernel_shap(lambda df: df, raw, back.filter("id < 0"), FEATURES, "id", "prediction")


@pytest.mark.parametrize("m", [1, 2, 5, 13])
def test_kernel_solution_is_exact_on_additive_games(m):
    z, w = A.coalitions(m)
    assert m > A.ALL_COALITIONS or len(z) == 2 ** m - 2
    phi = np.linspace(-2, 3, m)
    y = np.append(z @ phi, phi.sum())
    assert np.allclose(A.kernel_solution(z, w) @ y, phi)


def test_final_fit_prepares_like_cross_validation_and_names_categories(spark):
    rows = [(float(i % 7) if i % 5 else None, ["red", "blue", None, "it's"][i % 4], float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, c string, y double")
    m = models.fit_final(df, "y", ["x"], ["c"], "random_forest", "regression", {"n_estimators": 5, "max_depth": 3})
    assert m.names == ["x", "x__missing", "c_blue", "c_it's", "c_red"]
    assert len(m.names) == m.estimator.numFeatures == m.prepared(df.limit(1)).select("features").first()[0].size
    rows = {r["feature"]: r for r in models.importance_rows(spark, models.importances(m)).collect()}
    assert set(rows) == set(m.names) and abs(sum(r["share"] for r in rows.values()) - 1) < 1e-5
    for task, name in (("classification", "logistic"), ("regression", "ridge")):
        f = models.fit_final(df, "c" if task == "classification" else "y", ["x"], [], name, task)
        assert f.transform(df.select("x")).filter("prediction IS NULL").count() == 0
