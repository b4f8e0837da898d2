"""The distributed isotonic fit against the plain one, in small ranges, with ties, weights and missing rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import calibrate


def plain(points):
    """(score, value) by the largest over starts of the smallest mean over ends."""
    x = sorted({s for s, *_ in points})
    t = np.array([sum(y * w for s, y, w in points if s == v) for v in x])
    n = np.array([sum(w for s, _, w in points if s == v) for v in x])
    out = []
    for i in range(len(x)):
        out.append(max(min(t[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, len(x))) for a in range(i + 1)))
    return x, out


def cases():
    rnd = np.random.RandomState(4)
    noisy = [(round(float(s), 2), float(rnd.rand() < s), 1.0) for s in rnd.rand(400)]
    saw = [(float(i), float(i % 10), 1.0 + i % 3) for i in range(90)]
    rising = [(float(i), float(i), 1.0) for i in range(60)]
    falling = [(float(i), float(-i), 2.0) for i in range(60)]
    return {"noisy": noisy, "saw": saw, "rising": rising, "falling": falling, "one": [(0.5, 1.0, 1.0)], "ties": [(1.0, 0.0, 1.0), (1.0, 1.0, 3.0)] * 40}


@pytest.mark.parametrize("name", sorted(cases()))
def test_ranges_of_any_size_give_the_plain_fit(spark, monkeypatch, name):
    monkeypatch.setattr(calibrate, "RANGE", 7)
    pts = cases()[name]
    df = spark.createDataFrame(pts + [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.1, None, 1.0), (0.2, 1.0, 0.0)],
                               "s double, y double, w double")
    blocks = calibrate.isotonic(df, "s", "y", "w")
    own = sorted(blocks.collect(), key=lambda r: r["lo"])
    assert all(a["value"] < b["value"] and a["hi"] < b["lo"] for a, b in zip(own, own[1:]))
    x, want = plain(pts)
    ask = [*x, *(v + 0.003 for v in x), -99.0, 999.0]
    test = spark.createDataFrame([(v, i) for i, v in enumerate(ask)] * 2 + [(None, -1), (float("nan"), -2)], "s double, calibrated int")
    got = {}
    for r in calibrate.apply_isotonic(blocks, test, "s").collect():
        got.setdefault(r["s"] if r["s"] is None or r["s"] == r["s"] else "nan", set()).add(r["calibrated"])
    assert got.pop(None) == {None} and got.pop("nan") == {None} and all(len(v) == 1 for v in got.values())
    assert np.allclose([got[v].pop() for v in ask], np.interp(ask, x, want), atol=1e-12)


def test_empty_fits(spark):
    none = spark.createDataFrame([], "s double, y int")
    blocks = calibrate.isotonic(none, "s", "y")
    assert blocks.count() == 0
    rows = spark.createDataFrame([(0.5,)], "s double")
    assert calibrate.apply_isotonic(blocks, rows, "s").collect()[0]["calibrated"] is None
    assert calibrate.apply_isotonic(blocks, rows.filter("s > 9"), "s").count() == 0


def test_platt_is_the_smoothed_logistic_fit(spark):
    rnd = np.random.RandomState(1)
    s = rnd.normal(size=500)
    y = (rnd.rand(500) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)] + [(None, 1), (float("nan"), 0), (0.0, None)], "s double, y int")
    m = calibrate.platt(df, "s", "y")
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.zeros(2)
    design = np.column_stack([s, np.ones(500)])
    for _ in range(30):
        q = 1 / (1 + np.exp(-design @ ab))
        ab += np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]), design.T @ (t - q))
    assert np.allclose([m.coefficients[0], m.intercept], ab, atol=1e-5)
    out = calibrate.apply_platt(m, df, "s").filter(F.col("s").isNull() | F.isnan("s")).collect()
    assert [r["calibrated"] for r in out] == [None, None]
