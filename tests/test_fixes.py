"""Cases that the sample tables do not hold: exact limits, missing values, ties, odd names, quoted cells."""

from pyspark.sql import functions as F

from quarry.operators import baselines, drift, evaluate, folds, framing, models, profile, risk
from quarry.sources import files


def test_limits_are_compared_before_rounding(spark):
    df = spark.range(4_000_000).select(F.col("id"), F.when(F.col("id") >= 2_000_001, F.col("id")).alias("half"))
    codes = {(r["code"], r["feature"]) for r in risk.risk_flags_pre(df, "id").collect()}
    assert (risk.HIGH_MISSING_RATE, "half") in codes  # 0.50000025 of the rows


def test_column_names_may_hold_quotes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], ["it's", "b\"c"])
    assert {r["column_name"] for r in profile.profile_columns(df).collect()} == {"it's", 'b"c'}
    assert {r["column_name"] for r in framing.leakage_scores(df, "it's").collect()} == {'b"c'}


def test_outlier_counts_do_not_mix_up_columns(spark):
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 3).alias("n_a"))
    got = {r["column_name"]: r["q1"] for r in profile.tukey_outliers(df).collect()}
    assert got["n_a"] is None and got["a"] is not None


def test_rows_without_a_time_only_train(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 4 > 0, F.timestamp_seconds(F.col("id"))).alias("t"))
    got = folds.time_series_folds(df, folds.epoch_micros("t"), "id").collect()
    assert {r["fold"] for r in got if r["t"] is None} == {-1} and {r["fold"] for r in got} == {-1, 0, 1, 2, 3, 4}
    split = folds.time_holdout(df, folds.epoch_micros("t"), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 51, "test": 9}


def test_missing_slice_is_scored_by_auc(spark):
    rows = [(None if i % 2 else "x", i % 4 // 2, i % 4 // 2, float(i % 4 // 2)) for i in range(48)]
    df = spark.createDataFrame(rows, "s string, y int, p int, score double")
    got = {r["slice_value"]: r["metric"] for r in evaluate.slices_classification(df, "y", "p", "score", ["s"]).collect()}
    assert got == {None: "auc", "x": "auc"}


def test_one_candidate_wins_a_tie(spark):
    cv = spark.createDataFrame([("dummy_mean", 0.1, 0.0), ("forest", 0.9, 0.0), ("boosted", 0.9, 0.0)],
                               "candidate string, cv_mean double, cv_std double").withColumn("scorer", F.lit("r2"))
    got = [r["candidate"] for r in baselines.baseline_gate(cv, "regression").filter("selected").collect()]
    assert got == ["boosted"]


def test_strategies_and_types_follow_the_facts(spark):
    want = {("regression", None, None): "KFold", ("classification", None, None): "StratifiedKFold",
            ("regression", None, "t"): "TimeSeriesSplit", ("timeseries", None, None): "TimeSeriesSplit",
            ("classification", "g", "t"): "GroupKFold"}
    assert {k: framing.cv_strategy(*k) for k in want} == want
    df = spark.createDataFrame([(i, float(i), str(i % 2)) for i in range(200)], ["n", "x", "c"])
    assert [framing.frame(df, target=t).problem_type for t in ("x", "c", "gone")] == ["regression", "classification", "classification"]
    assert framing.frame(df, "please forecast this", target="x").problem_type in ("timeseries", "regression")


def test_band_is_decided_on_the_exact_value(spark):
    psi = spark.createDataFrame([(drift.PSI_DRIFT - 1e-8,)], ["psi"])
    assert psi.select(drift.band(F.col("psi")).alias("b")).first()["b"] == "moderate"


def test_cross_validation_knows_a_class_of_one_fold(spark):
    rows = [(i, float(i % 7), "c" if i < 4 else "ab"[i % 2], i % 5 if i >= 4 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y string, fold int")
    got = models.cross_validate(df, "y", ["x"], [], "logistic", "classification").collect()
    assert len(got) == 5 and all(r["score"] is not None for r in got)


def test_time_ordered_training_sees_the_past_only(spark):
    # the target jumps in the last fold: only a model that has seen it could score well there
    rows = [(i, float(i % 10), (i % 10) * (1.0 if i < 100 else -1.0), i // 20 - 1) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    got = {r["fold"]: r["score"] for r in models.cross_validate(df, "y", ["x"], [], "ridge", "regression", time_ordered=True).collect()}
    assert got[3] > 0.9 and got[4] < -1


def test_quoted_cells_survive_a_round_trip(spark):
    rows = [(1, 'x, "q", y'), (2, "two\nlines"), (3, '"')]
    df = spark.createDataFrame(rows, "n long, s string")
    path = files.write_dataset(df, files.scratch_path(spark, "quoted") + ".csv")
    back = files.load_dataset(spark, path, multi_line=True)
    assert back.schema["n"].dataType.simpleString() == "bigint"
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_missing_class_is_a_class_on_both_paths(spark):
    for n in (4, 100):  # few classes: cuts on the driver; many: the distributed form
        df = spark.range(40 * n).select("id", F.when(F.col("id") % n > 0, F.col("id") % n).alias("c"))
        per = folds.stratified_split(df, "c", ["id"]).groupBy("c").agg(F.count_if(F.col("split") == "test").alias("t"))
        assert {r["t"] for r in per.collect()} == {8}


def test_class_of_one_row_falls_back_to_a_random_split(spark):
    df = spark.range(100).select("id", F.when(F.col("id") == 5, "rare").otherwise("common").alias("c"))
    got = folds.stratified_split(df, "c", ["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"test": 20, "train": 80}


def test_auc_over_buckets_equals_the_plain_window(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") * 7919 % 1009 / 1009).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    one = evaluate.auc(df, F.col("y"), F.col("s")).first()["auc"]
    monkeypatch.setattr(evaluate, "DISTINCT_SCORES_PER_BUCKET", 50)
    assert abs(evaluate.auc(df, F.col("y"), F.col("s")).first()["auc"] - one) < 1e-12


def codes(flags):
    return {(r["stage"], r["level"], r["code"]) for r in flags.collect()}


def test_every_rule_before_training_fires(spark):
    rows = [(i % 3, None if i % 10 else 1.0, 7, i % 2, float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, gone double, same long, y long, `leak` double").withColumnRenamed("a", " ")
    got = codes(risk.risk_flags_pre(df, "y"))
    assert got >= {("profile", risk.CRITICAL, risk.MISSING_COLUMN_NAMES), ("profile", risk.WARNING, risk.HIGH_DUPLICATE_RATIO),
                   ("profile", risk.WARNING, risk.TINY_DATASET), ("profile", risk.WARNING, risk.HIGH_MISSING_RATE),
                   ("profile", risk.INFO, risk.CONSTANT_COLUMN), ("profile", risk.WARNING, risk.CLASS_IMBALANCE),
                   ("pre_training", risk.CRITICAL, risk.TINY_DATASET), ("framing", risk.CRITICAL, risk.LEAKAGE_SUSPECTED),
                   ("pre_training", risk.CRITICAL, risk.LEAKAGE_SUSPECTED)}
    halted = codes(risk.risk_flags_pre(df.select("gone", F.lit(1).alias("y")), "y"))
    assert halted >= {("pre_training", risk.CRITICAL, risk.CONSTANT_COLUMN), ("pre_training", risk.CRITICAL, risk.HIGH_MISSING_RATE)}
    calm = codes(risk.risk_flags_pre(df, "y", [risk.APPROVE_TINY, risk.APPROVE_LEAKAGE]))
    assert not {c for s, _, c in calm if s == "pre_training"}


def test_every_rule_after_training_fires(spark):
    cols = ("cv_mean_v double, cv_std_v double, holdout_v double, dominant_share_v double, dominant_share_t string, "
            "failed_slices_v double, failed_slices_t string, correlated_pairs_v double, correlated_pairs_t string, "
            "ece_v double, beats_baseline_v double")
    bad = spark.createDataFrame([(0.9, 0.5, 0.2, 0.95, "x", 2.0, "c=v", 1.0, "a~b", 0.5, 0.0)], cols)
    got = {r["code"] for r in risk.post_training_flags(bad, "classification").collect()}
    assert got == {risk.UNSTABLE_CV, risk.DOMINANT_FEATURE, risk.OVERFITTING_FAIL, risk.SLICE_FAILURE, "CORRELATED_FEATURES",
                   risk.HIGH_CALIBRATION_ERROR}
    gap = (risk.GAP_WARN + risk.GAP_FAIL) / 2
    near = spark.createDataFrame([(1.0, 0.0, 1.0 - gap, 0.1, "x", 0.0, "", 0.0, "", 0.0, 1.0)], cols)
    assert {r["code"] for r in risk.post_training_flags(near, "regression").collect()} == {risk.OVERFITTING_WARN}
    good = spark.createDataFrame([(0.995, 0.0, 0.9999, 0.1, "x", 0.0, "", 0.0, "", 0.0, 1.0)], cols)
    assert {r["code"] for r in risk.post_training_flags(good, "classification").collect()} == {risk.SUSPICIOUS_AUC}
    assert [r["pass_gate"] for m in (bad, good) for r in risk.pass_gate(m, "classification").collect()] == [False, True]


def test_drift_rules_fire(spark):
    base = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("c"), F.lit(1).alias("old"))
    moved = base.select((F.col("x") / 4).alias("x"), F.col("x").cast("string").alias("c2"), F.lit("1").alias("old"))
    assert {c for _, _, c in codes(drift.schema_flags(drift.schema_diff(base, moved)))} == {risk.SCHEMA_DTYPE_MISMATCH}
    assert {c for _, _, c in codes(drift.schema_flags(drift.schema_diff(base, base.drop("c"))))} == {risk.DRIFT_DETECTED}
    scores = drift.psi(base, moved, ["x"])
    assert scores.first()["band"] == "drift" and drift.psi_flags(scores).count() == 1
    some = drift.psi(base, base.select((F.col("x") * 0.75).alias("x")), ["x"]).first()
    assert some["band"] in ("moderate", "drift") and drift.psi(base, base, ["x"]).first()["band"] == "stable"
