"""The chain from table to verdict: learnable and random targets, both kinds of task, framing's own features."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.operators import chain

from .conftest import SMALL


def test_both_verdicts_occur(spark):
    rows = E.queries()["chain_verdict"](spark, SMALL).collect()
    steps = {(r["task"], r["next_step"]) for r in rows}
    assert ("tax", "halt") in steps and any(t == "charge" and s != "halt" for t, s in steps)
    by = {r["task"]: r for r in rows}
    assert by["charge"]["beats_baseline"] and not by["tax"]["beats_baseline"] and by["charge"]["dominant_feature"] == "l_quantity"


def test_binary_classification_with_framed_features(spark):
    rnd = np.random.RandomState(3)
    n = 400
    x = rnd.normal(size=(n, 2))
    y = np.where(x[:, 0] + 0.5 * rnd.normal(size=n) > 0, "yes", "no")
    rows = [(i, float(x[i, 0]) if i % 11 else None, float(x[i, 1]), rnd.choice(["r", "g", None]), str(y[i]) if i % 50 else None, f"s{i % 2}") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c string, y string, s string")
    v = chain.run(df, "y", "classification", ["k"], {"logistic": {"C": 1.0}}, ["s"])
    m = v.metrics.collect()[0]
    assert v.selected == "logistic" and m["holdout_v"] > 0.8 and m["cv_mean_v"] > 0.8 and 0 < m["ece_v"] < 0.5
    assert m["dominant_share_t"] == "a" and m["failed_slices_v"] == 0 and m["beats_baseline_v"] == 1
    gate = v.gate.collect()[0]
    assert gate["beats_baseline"] and not gate["halt"]
    assert [r["next_step"] for r in v.next_steps([0, 3]).orderBy("retries").collect()] == (
        ["explainability"] * 2 if gate["pass_gate"] else ["model_strategy", "human_review"])
    dummies = v.candidates.filter("is_dummy").agg(F.max("cv_mean")).first()[0]
    assert 0.4 < dummies < 0.65 and {r["code"] for r in v.flags.collect()} <= {"DOMINANT_FEATURE", "HIGH_CALIBRATION_ERROR", "OVERFITTING_WARN"}
