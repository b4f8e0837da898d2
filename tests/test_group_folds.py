"""Whole groups, balanced rows, heavy and light groups, missing groups, ties."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import folds


def folded(spark, sizes, kind="long"):
    rows = [(g,) for g, n in sizes for _ in range(n)]
    df = spark.createDataFrame(rows, f"g {kind}").repartition(4)
    out = folds.group_folded(df, "g").groupBy("g", "fold").count().collect()
    where = {}
    for r in out:
        assert r["g"] not in where  # a group is in one fold
        where[r["g"]] = r["fold"]
    assert {r["g"]: r["count"] for r in out} == {g: n for g, n in sizes}
    loads = Counter()
    for g, n in sizes:
        loads[where[g]] += n
    return where, [loads[f] for f in range(folds.N_FOLDS)]


@pytest.mark.parametrize("seed", [1, 2])
def test_light_groups_fill_the_folds(spark, seed):
    rnd = random.Random(seed)
    sizes = [(g, rnd.randint(1, 9)) for g in range(20_000)]
    _, loads = folded(spark, sizes)
    assert max(loads) - min(loads) <= 0.01 * sum(loads)


def test_uneven_heavy_groups_are_made_up_by_light_ones(spark):
    # three groups of 15 % each; the light rest fills the other folds first
    sizes = [(-1, 9000), (-2, 9000), (-3, 9000)] + [(g, 1 + g % 5) for g in range(11_000)]
    where, loads = folded(spark, sizes)
    assert len({where[g] for g in (-1, -2, -3)}) == 3
    assert max(loads) - min(loads) <= 0.05 * sum(loads) / folds.N_FOLDS


def test_a_group_larger_than_a_fold(spark):
    sizes = [(0, 40_000)] + [(g, 2) for g in range(1, 30_001)]
    where, loads = folded(spark, sizes)
    rest = [n for f, n in enumerate(loads) if f != where[0]]
    assert loads[where[0]] == 40_000 and max(rest) - min(rest) <= 0.01 * sum(rest)


def test_missing_groups_and_text_groups(spark):
    sizes = [(None, 300)] + [(f"it's {g}", 10 + g % 3) for g in range(200)]
    where, loads = folded(spark, sizes, "string")
    assert max(loads) - min(loads) <= 0.05 * sum(loads) and set(where.values()) == set(range(5))


def test_empty_one_group_and_fewer_groups_than_folds(spark):
    empty = spark.createDataFrame([], "g long, fold string")
    assert folds.group_folded(empty.drop("fold"), "g").count() == 0
    _, loads = folded(spark, [(7, 3)])
    assert sorted(loads) == [0, 0, 0, 0, 3]
    where, _ = folded(spark, [(1, 5), (2, 4), (3, 4)])
    assert where == {1: 0, 2: 1, 3: 2}  # the largest first, each to the emptiest fold


def test_light_groups_need_no_join(spark):
    df = spark.range(60_000).select((F.col("id") % 30_000).alias("g"))
    plan = folds.group_folded(df, "g")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("loads,rest", [([0, 0, 0], 10), ([50, 0, 0], 20), ([9, 5, 0], 7), ([3, 3, 3], 0)])
def test_fill_reaches_one_level(loads, rest):
    took = folds.fill(loads, rest)
    assert sum(took) <= rest and rest - sum(took) < len(loads)
    after = [a + b for a, b in zip(loads, took) if b]
    assert not after or max(after) == min(after)
