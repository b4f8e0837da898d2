"""Risk rules (R1-R27) as filters over small metric DataFrames, joined by ``unionByName``.

A flag row is ``(stage, level, code, feature, description, requires_approval)``.  Every
metric frame comes from one aggregate over the data, so the flag query costs a profile
pass, a duplicate pass and a leakage pass whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import framing, profile

# Levels, codes, approval names and thresholds of the rules.
CRITICAL, WARNING, INFO = "critical", "warning", "info"
MISSING_COLUMN_NAMES = "MISSING_COLUMN_NAMES"
HIGH_DUPLICATE_RATIO = "HIGH_DUPLICATE_RATIO"
TINY_DATASET = "TINY_DATASET"
HIGH_MISSING_RATE = "HIGH_MISSING_RATE"
CONSTANT_COLUMN = "CONSTANT_COLUMN"
CLASS_IMBALANCE = "CLASS_IMBALANCE"
LEAKAGE_SUSPECTED = "LEAKAGE_SUSPECTED"
UNSTABLE_CV = "UNSTABLE_CV"
SUSPICIOUS_AUC = "SUSPICIOUS_AUC"
DOMINANT_FEATURE = "DOMINANT_FEATURE"
SCHEMA_DTYPE_MISMATCH = "SCHEMA_DTYPE_MISMATCH"
DRIFT_DETECTED = "DRIFT_DETECTED"
OVERFITTING_FAIL = "OVERFITTING_FAIL"
OVERFITTING_WARN = "OVERFITTING_WARN"
SLICE_FAILURE = "SLICE_FAILURE"
HIGH_CALIBRATION_ERROR = "HIGH_CALIBRATION_ERROR"

APPROVE_TINY = "tiny_dataset_proceed"
APPROVE_LEAKAGE = "leakage_feature_drop"
APPROVE_AUC = "suspicious_auc"
APPROVE_SCHEMA = "schema_drift_retrain"
# one mapping between pending codes and the approval that clears them
APPROVAL_FOR_CODE = {
    TINY_DATASET: APPROVE_TINY,
    LEAKAGE_SUSPECTED: APPROVE_LEAKAGE,
    SUSPICIOUS_AUC: APPROVE_AUC,
    SCHEMA_DTYPE_MISMATCH: APPROVE_SCHEMA,
    DRIFT_DETECTED: APPROVE_SCHEMA,
    MISSING_COLUMN_NAMES: "missing_column_names_ack",
}

DUPLICATE_LIMIT = 0.2
TINY_ROWS = 100
MISSING_LIMIT = 0.5
CV_STD_LIMIT = 0.15
AUC_LIMIT = 0.99
DOMINANT_LIMIT = 0.5
PSI_DRIFT = 0.2
GAP_FAIL = 0.25
GAP_WARN = 0.10
ECE_LIMIT = 0.15
SEVERITY = {INFO: 1, WARNING: 2, CRITICAL: 3}

FLAG_COLUMNS = ["stage", "level", "code", "feature", "description", "requires_approval"]


def flag(rows: DataFrame, stage: str, level: str, code: str, feature: Column | None, description: Column,
         approval: bool) -> DataFrame:
    return rows.select(
        F.lit(stage).alias("stage"), F.lit(level).alias("level"), F.lit(code).alias("code"),
        (feature if feature is not None else F.lit(None)).cast("string").alias("feature"),
        description.cast("string").alias("description"), F.lit(approval).alias("requires_approval"),
    )


def union_flags(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def risk_flags_pre(df: DataFrame, target: str | None, approvals: Sequence[str] = ()) -> DataFrame:
    """R1-R11 on one table: profile, duplicate and leakage passes, then filters."""
    approvals = set(approvals)
    prof = profile.profile_columns(df, rounded=False)
    dup = profile.duplicate_ratio(df, rounded=False)
    n_row = prof.filter(F.col("position") == 0)
    out = [
        # R1 (blank header; the pending gate needs an acknowledgement)
        flag(prof.filter(F.trim("column_name") == ""), "profile", CRITICAL, MISSING_COLUMN_NAMES, None,
             F.lit("a column header is blank"), True),
        # R2
        flag(dup.filter(F.col("duplicate_ratio") > DUPLICATE_LIMIT), "profile", WARNING, HIGH_DUPLICATE_RATIO,
             None, F.format_string("duplicate share %.4f above %.2f", "duplicate_ratio", F.lit(DUPLICATE_LIMIT)),
             False),
        # R3
        flag(n_row.filter(F.col("n_rows") < TINY_ROWS), "profile", WARNING, TINY_DATASET, None,
             F.format_string("%d rows, fewer than %d", "n_rows", F.lit(TINY_ROWS)), False),
        # R4
        flag(prof.filter(F.col("missing_rate") > MISSING_LIMIT), "profile", WARNING, HIGH_MISSING_RATE,
             F.col("column_name"), F.format_string("missing share %.4f", "missing_rate"), False),
        # R5
        flag(prof.filter("is_constant"), "profile", INFO, CONSTANT_COLUMN, F.col("column_name"),
             F.lit("no variation"), False),
    ]
    if target is not None and target in df.columns:
        # The reference looks only at the table size here
        out.append(flag(n_row.filter(F.col("n_rows") < TINY_ROWS), "profile", WARNING, CLASS_IMBALANCE,
                        F.lit(target), F.lit("class balance of a tiny table needs a review"), False))
    if APPROVE_TINY not in approvals:  # R7
        out.append(flag(n_row.filter(F.col("n_rows") < TINY_ROWS), "pre_training", CRITICAL, TINY_DATASET, None,
                        F.format_string("%d rows: too few to train on", "n_rows"), True))
    if target is not None and target in df.columns:
        leak = framing.leakage_scores(df, target).filter("suspect") \
            .agg(F.sort_array(F.collect_list("column_name")).alias("names")).filter(F.size("names") > 0)
        # R8 (framing: first suspect) and R9 (pre-training: all suspects, unless approved)
        out.append(flag(leak, "framing", CRITICAL, LEAKAGE_SUSPECTED, F.col("names")[0],
                        F.concat(F.lit("possible target leakage: "), F.concat_ws(", ", "names")), True))
        if APPROVE_LEAKAGE not in approvals:
            out.append(flag(leak, "pre_training", CRITICAL, LEAKAGE_SUSPECTED, F.concat_ws(", ", "names"),
                            F.concat(F.lit("possible target leakage: "), F.concat_ws(", ", "names")), True))
        # Target with at most one distinct non-missing value
        tcol = F.col(f"`{target}`")
        tgt = df.agg(F.count(tcol).alias("c"), F.min(tcol).alias("lo"), F.max(tcol).alias("hi")) \
            .filter((F.col("c") == 0) | (F.col("lo") == F.col("hi")))
        out.append(flag(tgt, "pre_training", CRITICAL, CONSTANT_COLUMN, F.lit(target),
                        F.lit("target has at most one value: nothing to learn, halt"), False))
    # Every feature (not the target) more than half missing
    feats = prof.filter(F.col("column_name") != F.lit(target or ""))
    allmiss = feats.agg(F.count(F.lit(1)).alias("k"), F.every(F.col("missing_rate") > MISSING_LIMIT).alias("all")) \
        .filter((F.col("k") > 0) & F.col("all"))
    out.append(flag(allmiss, "pre_training", CRITICAL, HIGH_MISSING_RATE, None,
                    F.lit("every feature is more than half missing, halt"), False))
    return union_flags(out)



def metrics_row(parts: dict[str, DataFrame]) -> DataFrame:
    """One wide metric row from long (metric, value, text) frames: union, then pivot on
    the known metric names (no join between the one-row frames)."""
    long = union_flags(list(parts.values()))
    return long.groupBy().pivot("metric", sorted(parts)).agg(F.first("value").alias("v"), F.first("text").alias("t"))


def metric(df: DataFrame, name: str, value: Column | None = None, text: Column | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("metric"),
                     (value if value is not None else F.lit(None)).cast("double").alias("value"),
                     (text if text is not None else F.lit(None)).cast("string").alias("text"))


def post_training_flags(m: DataFrame, problem_type: str, approvals: Sequence[str] = ()) -> DataFrame:
    """R13-R15, R19-R22 over the wide metric row (columns ``<metric>_v`` / ``<metric>_t``)."""
    approvals = set(approvals)
    cv_mean, cv_std, hold = F.col("cv_mean_v"), F.col("cv_std_v"), F.col("holdout_v")
    gap = (cv_mean - hold) / F.greatest(F.abs(cv_mean), F.lit(1e-5))
    out = [
        flag(m.filter(cv_std > CV_STD_LIMIT), "post_training", WARNING, UNSTABLE_CV, None,
             F.format_string("cv std %.4f above %.2f", cv_std, F.lit(CV_STD_LIMIT)), False),
        flag(m.filter(F.col("dominant_share_v") > DOMINANT_LIMIT), "post_training", WARNING, DOMINANT_FEATURE,
             F.col("dominant_share_t"), F.format_string("importance share %.4f", F.col("dominant_share_v")), False),
        flag(m.filter(gap > GAP_FAIL), "evaluation", CRITICAL, OVERFITTING_FAIL, None,
             F.format_string("cv-holdout gap %.4f", gap), False),
        flag(m.filter((gap > GAP_WARN) & (gap <= GAP_FAIL)), "evaluation", WARNING, OVERFITTING_WARN, None,
             F.format_string("cv-holdout gap %.4f", gap), False),
        flag(m.filter(F.col("failed_slices_v") > 0), "evaluation", CRITICAL, SLICE_FAILURE, F.col("failed_slices_t"),
             F.lit("slices below their gate"), False),
        flag(m.filter(F.col("correlated_pairs_v") > 0), "explainability", INFO, "CORRELATED_FEATURES",
             F.col("correlated_pairs_t"), F.lit("feature pairs with |r| above 0.7"), False),
    ]
    if problem_type == "classification":
        if APPROVE_AUC not in approvals:
            out.append(flag(m.filter(hold > AUC_LIMIT), "post_training", CRITICAL, SUSPICIOUS_AUC, None,
                            F.format_string("holdout AUC %.4f above %.2f", hold, F.lit(AUC_LIMIT)), True))
        out.append(flag(m.filter(F.col("ece_v") > ECE_LIMIT), "evaluation", CRITICAL, HIGH_CALIBRATION_ERROR, None,
                        F.format_string("ECE %.4f", F.col("ece_v")), False))
    return union_flags(out)


def pass_gate(m: DataFrame, problem_type: str) -> DataFrame:
    """R12 + R23: baseline beaten, no overfitting failure, no slice failure, calibrated."""
    cv_mean, hold = F.col("cv_mean_v"), F.col("holdout_v")
    gap = (cv_mean - hold) / F.greatest(F.abs(cv_mean), F.lit(1e-5))
    base = F.col("beats_baseline_v") == 1
    overfit_ok = ~(gap > GAP_FAIL)
    slices_ok = ~(F.col("failed_slices_v") > 0)
    calib_ok = ~(F.col("ece_v") > ECE_LIMIT) if problem_type == "classification" else F.lit(True)
    from ..functions.columns import r6
    return m.select(r6(cv_mean).alias("cv_mean"), r6(F.col("cv_std_v")).alias("cv_std"), r6(hold).alias("holdout"),
                    r6(gap).alias("rel_gap"), r6(F.col("ece_v")).alias("ece"), base.alias("beats_baseline"),
                    overfit_ok.alias("overfit_ok"), slices_ok.alias("slices_ok"), calib_ok.alias("calibration_ok"),
                    (base & overfit_ok & slices_ok & calib_ok).alias("pass_gate"),
                    (~base).alias("halt"))
