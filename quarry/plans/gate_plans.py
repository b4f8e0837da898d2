"""Queries: post-training flags and the pass gate (R12-R15, R19-R23) over the metric rows
of the binary lineitem task (cross-validated and holdout AUC, ECE, slices, attribution
shares, correlated pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.materialize import pin
from ..operators import evaluate, explain, folds, risk
from . import sqlkit
from .eval_plans import LI_BIN_SQL, _auc_sql, _ece_sql, _slices_cls_sql, li_binary
from .explain_plans import CORR_COLS, LI_COEFS, _imp_sql, _pairs_sql
from .quality import LI_HASH, LI_KEY
from .registry import query
from .split_plans import CUTS, _bins_sql

DUMMY_AUC = 0.5  # a most-frequent dummy scores every row alike: ties give exactly one half


NEEDED = LI_KEY + ["label", "score", "prediction", "l_returnflag", "l_linestatus", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax"]


def drawn_lineitem(spark, sf):
    """The binary task's rows with their fold and holdout draws, pinned once (reliable
    checkpoint): every metric below reads this narrow copy instead of re-hashing."""
    li = li_binary(spark, sf).select(*NEEDED)
    li = folds.random_split(folds.kfold(li, LI_KEY, hash_cols=LI_HASH), LI_KEY, hash_cols=LI_HASH)
    return pin(li)


def metric_frame(spark, sf):
    li = drawn_lineitem(spark, sf)
    per_fold = evaluate.auc(li, F.col("label"), F.col("score"), ["fold"])
    cv = per_fold.agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s"))
    test = li.filter(F.col("split") == "test")
    train = li.filter(F.col("split") == "train")
    hold = evaluate.auc(test, F.col("label"), F.col("score"))
    ece = evaluate.ece_bins(test, "label", prob="score").agg(F.first("ece").alias("e"))
    sl = evaluate.slices_classification(test, "label", "prediction", "score", ["l_returnflag", "l_linestatus"]) \
        .filter(~F.col("pass_gate")).agg(
            F.count(F.lit(1)).alias("k"),
            F.concat_ws(", ", F.sort_array(F.collect_list(F.concat_ws("=", "slice_column", "slice_value")))).alias("names"))
    means = explain.background_means(train, list(LI_COEFS))
    imp = explain.global_importance(explain.linear_shap(test, LI_COEFS, means, LI_KEY), LI_COEFS) \
        .agg(F.max("importance_share").alias("s"), F.max_by("feature", "importance_share").alias("f"))
    pairs = explain.correlated_pairs(li, CORR_COLS).filter("above_limit").agg(
        F.count(F.lit(1)).alias("k"),
        F.sort_array(F.collect_list(F.struct("pair_index", F.concat_ws("~", "feature_a", "feature_b").alias("p")))).alias("ps"))
    m = risk.metric
    return risk.metrics_row({
        "cv_mean": m(cv, "cv_mean", F.col("m")),
        "cv_std": m(cv, "cv_std", F.col("s")),
        "beats_baseline": m(cv, "beats_baseline", (F.col("m") > DUMMY_AUC * 1.05).cast("double")),
        "holdout": m(hold, "holdout", F.col("auc")),
        "ece": m(ece, "ece", F.col("e")),
        "failed_slices": m(sl, "failed_slices", F.col("k"), F.col("names")),
        "dominant_share": m(imp, "dominant_share", F.col("s"), F.col("f")),
        "correlated_pairs": m(pairs, "correlated_pairs", F.col("k"),
                              F.array_join(F.transform("ps", lambda x: x["p"]), ", ")),
    })


def _metrics_sql():
    folded = "SELECT * EXCLUDE (_bin), _bin AS fold FROM (" + _bins_sql(LI_BIN_SQL, LI_KEY, 43, CUTS,
                                                                      hash_cols=LI_HASH) + ")"
    split = _bins_sql(LI_BIN_SQL, LI_KEY, 42, [2000], hash_cols=LI_HASH)
    test = f"SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ({split}) WHERE _bin = 0"
    return f"""cv AS (SELECT avg(auc) AS m, stddev_pop(auc) AS s FROM ({_auc_sql(folded, 'label', 'score', ['fold'])})),
ho AS (SELECT auc AS h FROM ({_auc_sql(test, 'label', 'score')})),
ec AS (SELECT first(ece) AS e FROM ({_ece_sql(test, 'label', 'score')})),
sl AS (SELECT count(*) AS k, coalesce(string_agg(slice_column || '=' || slice_value, ', ' ORDER BY slice_column || '=' || slice_value), '') AS names
       FROM ({_slices_cls_sql(test, ['l_returnflag', 'l_linestatus'])}) WHERE NOT pass_gate),
im AS (SELECT max(importance_share) AS s, arg_max(feature, importance_share) AS f FROM ({_imp_sql()})),
pr AS (SELECT count(*) AS k, coalesce(string_agg(feature_a || '~' || feature_b, ', ' ORDER BY pair_index), '') AS ps
       FROM ({_pairs_sql()}) WHERE above_limit),
mt AS (SELECT cv.m AS cv_mean, cv.s AS cv_std, ho.h AS holdout, ec.e AS ece, sl.k AS nfail, sl.names AS fail_names,
              im.s AS dom, im.f AS dom_f, pr.k AS npairs, pr.ps AS pairs, (cv.m > 0.5 * 1.05) AS beats,
              (cv.m - ho.h) / greatest(abs(cv.m), 1e-5) AS gap FROM cv, ho, ec, sl, im, pr)"""


def _flags_sql():
    def sel(stage, level, code, feature, desc, appr, cond):
        return (f"SELECT '{stage}' AS stage, '{level}' AS level, '{code}' AS code, CAST({feature} AS VARCHAR) AS feature, "
                f"CAST({desc} AS VARCHAR) AS description, {appr} AS requires_approval FROM mt WHERE {cond}")
    parts = [
        sel("post_training", "warning", "UNSTABLE_CV", "NULL", "printf('cv std %.4f above %.2f', cv_std, 0.15)", "false", "cv_std > 0.15"),
        sel("post_training", "warning", "DOMINANT_FEATURE", "dom_f", "printf('importance share %.4f', dom)", "false", "dom > 0.5"),
        sel("evaluation", "critical", "OVERFITTING_FAIL", "NULL", "printf('cv-holdout gap %.4f', gap)", "false", "gap > 0.25"),
        sel("evaluation", "warning", "OVERFITTING_WARN", "NULL", "printf('cv-holdout gap %.4f', gap)", "false", "gap > 0.10 AND gap <= 0.25"),
        sel("evaluation", "critical", "SLICE_FAILURE", "fail_names", "'slices below their gate'", "false", "nfail > 0"),
        sel("explainability", "info", "CORRELATED_FEATURES", "pairs", "'feature pairs with |r| above 0.7'", "false", "npairs > 0"),
        sel("post_training", "critical", "SUSPICIOUS_AUC", "NULL", "printf('holdout AUC %.4f above %.2f', holdout, 0.99)", "true", "holdout > 0.99"),
        sel("evaluation", "critical", "HIGH_CALIBRATION_ERROR", "NULL", "printf('ECE %.4f', ece)", "false", "ece > 0.15"),
    ]
    return f"WITH {_metrics_sql()}\n" + sqlkit.union_all(parts)


@query("risk_flags_post", sql=_flags_sql())
def q_risk_flags_post(spark, sf):
    # the one metric row feeds every rule: computed once (pinned), then filtered per rule
    return risk.post_training_flags(pin(metric_frame(spark, sf)), "classification")


@query("pass_gate", sql=f"""WITH {_metrics_sql()}
SELECT round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(holdout, 6) AS holdout, round(gap, 6) AS rel_gap,
  round(ece, 6) AS ece, beats AS beats_baseline, NOT (gap > 0.25) AS overfit_ok, NOT (nfail > 0) AS slices_ok,
  NOT (ece > 0.15) AS calibration_ok, beats AND NOT (gap > 0.25) AND NOT (nfail > 0) AND NOT (ece > 0.15) AS pass_gate,
  NOT beats AS halt FROM mt""")
def q_pass_gate(spark, sf):
    return risk.pass_gate(metric_frame(spark, sf), "classification")


@query("route_after_eval", sql=f"""WITH {_metrics_sql()},
g AS (SELECT beats AND NOT (gap > 0.25) AND NOT (nfail > 0) AND NOT (ece > 0.15) AS pass_gate, NOT beats AS halt,
             holdout > 0.99 AS suspicious FROM mt)
SELECT r AS retries, CASE WHEN halt THEN 'halt' WHEN suspicious THEN 'human_review'
  WHEN NOT pass_gate AND r < 3 THEN 'model_strategy' WHEN NOT pass_gate THEN 'human_review' ELSE 'explainability' END AS next_step
FROM g, (SELECT unnest(range(0, 4)) AS r)""")
def q_route_after_eval(spark, sf):
    """R25 after evaluation for each retry count 0..3 of the same gate row."""
    from ..operators import sessions
    m = pin(metric_frame(spark, sf))  # the gate and the flags both read the one metric row
    gate = risk.pass_gate(m, "classification").select(
        F.lit(0).alias("session_id"), "pass_gate", "halt",
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("retries"))
    flags = risk.post_training_flags(m, "classification").withColumn("session_id", F.lit(0))
    return sessions.route_after_eval(gate, flags, "session_id", "retries").select("retries", "next_step")
