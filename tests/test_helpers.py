"""Brute-force checks of the distributed helpers on small fixtures (all code paths)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import ranks
from quarry.functions.columns import HASH_SPACE
from quarry.operators import evaluate


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    # a third of the rows share one value (a hot key), the rest spread with many ties
    vals = [5.0] * 3000 + [float(rnd.randint(0, 400)) / 4 for _ in range(6000)]
    rows = [(i, v, rnd.randint(0, 1)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "k long, v double, y int").repartition(7), vals, rows


@pytest.mark.parametrize("max_window", [50, 1 << 20])
def test_exact_quantiles_match_numpy(skewed, max_window):
    df, vals, _ = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = ranks.exact_quantiles(df, {"v": F.col("v")}, probs, max_window=max_window, accuracy=100)
    for p in probs:
        assert got[("v", p)] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_lex_thresholds_with_hot_value(skewed):
    df, vals, rows = skewed
    n = len(rows)
    order = sorted(((v, k) for k, v, _ in rows))
    want = {r: order[r] for r in (0, 1500, 2999, 3000, n - 1)}
    got = ranks.lex_thresholds(df, F.col("v"), F.col("k"), list(want), n, max_window=64, accuracy=100)
    for r, (v, k) in want.items():
        assert got[r] == (v, k)


def test_hash_rank_bins_exact_and_partition_free(spark, skewed):
    df, _, rows = skewed
    a = ranks.hash_rank_bins(df, ["y"], ["k"], seed=5, fractions_bp=[2000, 5000], out_col="b")
    b = ranks.hash_rank_bins(df.repartition(3, "v"), ["y"], ["k"], seed=5, fractions_bp=[2000, 5000], out_col="b")
    ra = sorted((r.k, r.b) for r in a.select("k", "b").collect())
    rb = sorted((r.k, r.b) for r in b.select("k", "b").collect())
    assert ra == rb
    pdf = a.toPandas()
    for y, g in pdf.groupby("y"):
        n = len(g)
        assert (g.b == 0).sum() == math.ceil(n * 0.2)
        assert (g.b <= 1).sum() == math.ceil(n * 0.5)


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("per_bucket", [10**9, 7])
def test_auc_exact_with_and_without_buckets(skewed, monkeypatch, per_bucket):
    df, _, rows = skewed
    monkeypatch.setattr(evaluate, "DISTINCT_SCORES_PER_BUCKET", per_bucket)
    got = evaluate.auc(df, F.col("y"), F.col("v")).first()["auc"]
    sample = rows[::7]
    small = df.filter(F.col("k") % 7 == 0)
    got_small = evaluate.auc(small, F.col("y"), F.col("v")).first()["auc"]
    assert got_small == pytest.approx(_brute_auc([r[2] for r in sample], [r[1] for r in sample]), abs=1e-12)
    assert 0.0 <= got <= 1.0


def test_auc_of_constant_score_is_half(spark):
    df = spark.createDataFrame([(i % 2, 0.3) for i in range(100)], "y int, s double")
    assert evaluate.auc(df, F.col("y"), F.col("s")).first()["auc"] == 0.5


def test_ece_bins_edges_follow_linspace():
    edges = evaluate._edges_ece()
    assert edges == list(np.linspace(0, 1, 11))


def test_portable_hash_in_range(spark):
    from quarry.functions.columns import phash
    v = spark.range(1000).select(phash(["id"], 42).alias("h")).agg(F.min("h"), F.max("h")).first()
    assert 0 <= v[0] and v[1] < HASH_SPACE


def test_driver_and_distributed_bins_agree_with_ties(spark):
    # every key appears 10 times: cuts land inside tied (hash, key) runs
    rows = [(i % 997, i % 3) for i in range(9970)]
    df = spark.createDataFrame(rows, "k long, y long").repartition(5)
    kw = dict(seed=9, fractions_bp=[1000, 3333, 9000], out_col="b")
    fast = ranks._hash_rank_bins_driver(df, ["y"], ["k"], 9, [1000, 3333, 9000], "b", "ceil")
    dist = ranks._hash_rank_bins_distributed(df, ["y"], ["k"], **kw)
    a = sorted(tuple(r) for r in fast.groupBy("k", "y", "b").count().collect())
    b = sorted(tuple(r) for r in dist.groupBy("k", "y", "b").count().collect())
    assert a == b


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=30, max_size=400),
       st.sampled_from([0.0, 0.13, 0.25, 0.5, 0.77, 1.0]))
def test_exact_quantile_property(spark, vals, p):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(3)
    got = ranks.exact_quantiles(df, {"v": F.col("v")}, [p], max_window=8, accuracy=50)[("v", p)]
    assert got == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_hard_vote_auc_equals_exact_auc(spark):
    from quarry.operators.baselines import hard_vote_auc
    rnd = random.Random(11)
    classes = ["a", "b", "c"]
    rows = [(i % 5, rnd.choice(classes), rnd.choice(classes)) for i in range(3000)]
    df = spark.createDataFrame(rows, "fold int, y string, vote string")
    got = {r.fold: r.score for r in hard_vote_auc(df, "fold", "y", {"m": "vote"}, classes).collect()}
    long = df.select("fold", F.explode(F.array(*[
        F.struct(F.lit(c).alias("k"), (F.col("y") == c).cast("int").alias("yk"), (F.col("vote") == c).cast("double").alias("sk"))
        for c in classes])).alias("r")).select("fold", "r.*")
    exact = evaluate.auc(long, F.col("yk"), F.col("sk"), ["fold", "k"]).groupBy("fold").agg(F.avg("auc").alias("a"))
    for r in exact.collect():
        assert got[r.fold] == pytest.approx(r.a, abs=1e-12)


def test_median_between_two_hot_values_collects_no_window(spark, monkeypatch):
    df = spark.range(10_000).select((F.col("id") % 2).cast("double").alias("v")).repartition(3)

    def refuse(*_):
        raise AssertionError("a window of all rows would be collected")

    monkeypatch.setattr(ranks.F, "collect_list", refuse)
    assert ranks.exact_quantiles(df, {"v": F.col("v")}, [0.5], max_window=50, accuracy=100)[("v", 0.5)] == 0.5


def test_rank_by_counts_splits_windows_of_many_values(spark):
    df = spark.range(900).select((F.col("id") % 300).alias("v")).repartition(3)
    for k in (0, 1, 449, 450, 899):
        assert ranks._value_by_counts(df, F.col("v"), None, None, 0, k, 20) == (k // 3, k // 3 * 3)
