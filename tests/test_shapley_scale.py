"""Sampled Shapley values score each coalition once; training tables are dealt over all cores."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarry.functions.materialize import LEAST_ROWS, pin, spread
from quarry.operators import models


class Formula:
    """Stands for a fitted model: a column expression; counts the rows it is asked for."""

    def __init__(self, text: str):
        self.text, self.scored = text, 0

    def transform(self, df):
        self.scored += df.count()
        return df.withColumn("prediction", F.expr(self.text))


def values(spark, text, rows, base, permutations=8):
    names = ["a", "b", "c"]
    model = Formula(text)
    explain = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out = models.sampled_shapley(model, explain, spark.createDataFrame(base, "a double, b double, c double"), names, "id",
                                 "prediction", permutations)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["shap"]
    return got, model.scored


def test_values_add_up_and_no_coalition_is_scored_twice(spark):
    rows = [(1, 1.0, 2.0, 3.0), (2, -1.0, 0.5, 4.0), (3, 0.0, 0.0, 0.0)]
    base = [(0.5, 1.0, 2.0), (2.0, -3.0, 1.0), (1.0, 1.0, 1.0)]
    got, scored = values(spark, "a * b + c * c + a", rows, base)
    mean = sum(a * b + c * c + a for a, b, c in base) / len(base)
    for key, a, b, c in rows:
        assert sum(got[key].values()) == pytest.approx(a * b + c * c + a - mean, abs=1e-5)
        assert got[key]["c"] == pytest.approx(c * c - sum(x[2] ** 2 for x in base) / len(base), abs=1e-5)  # no interaction
    assert scored <= len(base) + len(rows) * (6 * len(base) + 1)  # 96 a row with a score for each prefix


def test_many_permutations_come_near_the_exact_values(spark):
    rows, base = [(7, 2.0, 3.0, 5.0)], [(1.0, 1.0, 1.0), (0.0, 4.0, 2.0)]
    got, _ = values(spark, "a * b * c", rows, base, permutations=4000)

    def worth(known):
        return sum(((2.0 if 0 in known else a) * (3.0 if 1 in known else b) * (5.0 if 2 in known else c)) for a, b, c in base) / 2
    for j, name in enumerate("abc"):
        gains = [worth(o[:o.index(j) + 1]) - worth(o[:o.index(j)]) for o in itertools.permutations(range(3))]
        assert got[7][name] == pytest.approx(sum(gains) / 6, abs=0.5)


def test_rows_of_one_part_are_dealt_out(spark):
    one = pin(spark.range(4 * LEAST_ROWS).coalesce(1))
    out = spread(one)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3 * LEAST_ROWS
    assert out.agg(F.sum("id"), F.count("id")).first() == one.agg(F.sum("id"), F.count("id")).first()
    small = pin(spark.range(LEAST_ROWS).coalesce(1))
    assert spread(small) is small
    assert len(spread(small, most=LEAST_ROWS // 8).groupBy(F.spark_partition_id()).count().collect()) == 8
