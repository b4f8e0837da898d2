"""Corruption matrix -> expected flag, and invariants of splits, folds and PSI."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import corrupt, drift, folds, framing, prep, profile, risk
from quarry.plans.tables import load
from quarry.sources import files

from .conftest import SMALL


def codes(flags):
    return {(r.code, r.level) for r in flags.select("code", "level").collect()}


def test_missing_column_names_flagged(spark):
    df = corrupt.missing_column_names(load(spark, SMALL, "region"))
    assert df.columns[0] == ""
    assert ("MISSING_COLUMN_NAMES", "critical") in codes(risk.risk_flags_pre(df, "r_name"))


def test_blank_csv_header_survives_loading(spark):
    df = corrupt.missing_column_names(load(spark, SMALL, "region"))
    path = files.write_dataset(df, files.scratch_path(spark, "blank") + ".csv", "csv")
    back = files.load_dataset(spark, path)
    assert back.columns[0] == ""


def test_duplicates_at_030_raise_flag_and_025_stay_silent(spark):
    cust = load(spark, SMALL, "customer")
    hi = corrupt.duplicate_rows(cust, ["c_custkey"], 0.30)
    lo = corrupt.duplicate_rows(cust, ["c_custkey"], 0.25)
    assert hi.count() == 150 + 45 and lo.count() == 150 + 37
    assert ("HIGH_DUPLICATE_RATIO", "warning") in codes(risk.risk_flags_pre(hi, "c_mktsegment"))
    assert ("HIGH_DUPLICATE_RATIO", "warning") not in codes(risk.risk_flags_pre(lo, "c_mktsegment"))


def test_leakage_inject_flags_both_columns(spark):
    part = corrupt.target_leakage_inject(load(spark, SMALL, "part"), "p_retailprice")
    suspects = framing.leakage_suspects(part, "p_retailprice")
    assert {"leakage_val", "p_retailprice_outcome"} <= set(suspects)
    assert suspects == sorted(suspects) and "p_retailprice" not in suspects


def test_dtype_change_is_schema_mismatch(spark):
    o = load(spark, SMALL, "orders")
    diff = drift.schema_diff(o, corrupt.dtype_change(o, "o_totalprice"))
    assert ("SCHEMA_DTYPE_MISMATCH", "critical") in codes(drift.schema_flags(diff))


def test_column_order_keeps_fingerprint(spark):
    o = load(spark, SMALL, "orders")
    r = corrupt.changed_column_order(o)
    assert drift.fingerprint(o) == drift.fingerprint(r)
    assert drift.fingerprint(o, ordered=True) != drift.fingerprint(r, ordered=True)


def test_null_burst_goes_to_median_with_indicator(spark):
    ev = corrupt.null_burst(load(spark, SMALL, "events"), "value", ["event_id"], 0.4)
    assert ev.filter(F.col("value").isNull()).count() == 400
    model = prep.fit_prep(ev, ["value"])
    assert model.numeric[0].imputation == "median_with_indicator"


def test_unseen_category_is_all_zero(spark):
    o = load(spark, SMALL, "orders").select("o_orderkey", "o_orderpriority")
    bad = corrupt.unseen_categories(o, "o_orderpriority", ["o_orderkey"])
    m = prep.category_index(o, ["o_orderpriority"])
    long = prep.onehot_long(bad, m, ["o_orderpriority"], ["o_orderkey"])
    unseen = long.filter(F.col("value") == corrupt.UNSEEN_LABEL)
    assert unseen.count() == 5 and unseen.filter(F.col("onehot_index").isNotNull()).count() == 0


def test_extreme_outliers_raise_share(spark):
    li = load(spark, SMALL, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    before = profile.tukey_outliers(li, ["l_extendedprice"]).first()["outlier_share"]
    after = profile.tukey_outliers(corrupt.extreme_outliers(li, "l_extendedprice", key), ["l_extendedprice"]).first()
    assert after["outlier_share"] > before


def test_psi_of_frame_with_itself_is_zero(spark):
    ev = load(spark, SMALL, "events")
    res = drift.psi(ev, ev, ["value", "user_id", "event_type"]).collect()
    assert all(r.psi == 0.0 for r in res)


def test_split_is_disjoint_and_complete(spark):
    o = load(spark, SMALL, "orders")
    s = folds.stratified_split(o, "o_orderpriority", ["o_orderkey"])
    assert s.count() == o.count()
    assert s.select("o_orderkey").distinct().count() == o.count()


def test_group_never_spans_folds(spark):
    li = load(spark, SMALL, "lineitem")
    g = folds.group_kfold(li, "l_orderkey")
    assert g.groupBy("l_orderkey").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0


def test_time_folds_are_ordered_blocks(spark):
    o = load(spark, SMALL, "orders")
    f = folds.time_series_folds(o, folds.epoch_micros("o_orderdate"), "o_orderkey").toPandas()
    f = f.sort_values(["o_orderdate", "o_orderkey"]).reset_index(drop=True)
    assert list(f.fold) == sorted(f.fold)
    t = len(f) // 6
    assert (f.fold == 0).sum() == t and (f.fold == -1).sum() == len(f) - 5 * t
