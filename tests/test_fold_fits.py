"""What the folds' fits share: one pass for all preparations, one for the scores, parts of even size."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.functions.materialize import LEAST_ROWS, pin
from quarry.operators import evaluate, folds, models, prep


def table(spark, n):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 5).cast("int").alias("fold"), F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"),
        F.exp((F.col("id") * 13 % 29) / 4.0).alias("z"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("v"), F.col("id") * 3 % 4)).alias("c"),
        (F.col("id") * 2.0 + 1).alias("y"))


def test_all_parts_are_prepared_as_each_alone(spark):
    df = pin(table(spark, 400))
    inside = [F.col("fold") != i for i in range(5)] + [F.col("fold") < 2, F.col("fold") < 0]
    for got, part in zip(prep.fit_parts(df, inside, ["x", "z"], ["c"]), inside):
        want = prep.fit_prep(df.filter(part), ["x", "z"], ["c"])
        assert got.categorical == want.categorical
        for a, b in zip(got.numeric, want.numeric):
            assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in vars(b).items()} == vars(a)


def test_folds_share_their_passes(spark, monkeypatch):
    calls = []
    plain = prep.fit_parts
    monkeypatch.setattr(prep, "fit_parts", lambda df, parts, *a: calls.append(len(parts)) or plain(df, parts, *a))
    df = table(spark, 300)
    out = models.tune(df, "c", ["z"], [], "logistic", "classification", [{"C": 1.0}, {"C": 0.1}]).collect()
    assert len(out) == 2 and sum(r["best"] for r in out) == 1
    assert calls == [5]  # ten fits, by fold and grid point, before


def test_fits_use_all_cores(spark):
    one = table(spark, 4 * LEAST_ROWS).coalesce(1)
    data = models.fit_folds(one, "y", ["x"], [], "regression").data
    sizes = [r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3 * LEAST_ROWS and sum(sizes) == 4 * LEAST_ROWS


def test_final_fits_use_all_cores(spark, monkeypatch):
    """the table of a final fit is dealt out too, however few parts its file has."""
    sizes, plain = [], models.Pipeline.fit

    def fit(self, data):
        sizes.extend(r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect())
        return plain(self, data)
    monkeypatch.setattr(models.Pipeline, "fit", fit)
    one = pin(table(spark, 4 * LEAST_ROWS).coalesce(1))
    models.fit_final(one, "y", ["x"], ["c"], "random_forest", "regression", {"n_estimators": 2, "max_depth": 2})
    assert len(sizes) > 1 and max(sizes) < 3 * LEAST_ROWS and sum(sizes) == 4 * LEAST_ROWS


def test_scores_are_computed_once(spark):
    n = evaluate.DISTINCT_SCORES_PER_BUCKET + 5000
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(n).select(F.lit(0).alias("fold"), (F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("s"))
    pred = df.mapInArrow(count, df.schema).select("fold", "label", F.lit(0.0).alias("prediction"), array_to_vector(
        F.array(-F.col("s"), F.col("s"))).alias("probability"))
    got = models._score(pred, "classification", 2).first()
    assert got["score"] == pytest.approx(0.5 + 1 / n)
    assert seen.value == n
