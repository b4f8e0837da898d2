"""Queries: preparation plan and transform (X2, X5-X9, X13), one-hot long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.materialize import pin
from ..operators import corrupt, folds, prep
from . import sqlkit
from .registry import query
from .tables import load

PREP_NUMERIC = ["user_id", "value", "hour"]
BURSTS = [("user_id", 0.03, 101), ("value", 0.2, 102), ("hour", 0.4, 103)]


def events_prepared(spark, sf):
    ev = load(spark, sf, "events").withColumn("hour", F.hour("ts"))
    for col, frac, seed in BURSTS:
        ev = corrupt.null_burst(ev, col, ["event_id"], frac, seed)
    # read by every fitting pass below: draw once, pin (reliable checkpoint)
    return pin(folds.stratified_split(ev, "event_type", ["event_id"]))


def _events_sql():
    src = "SELECT *, hour(ts) AS hour FROM events"
    for col, frac, seed in BURSTS:
        src = sqlkit.null_burst(src, col, ["event_id"], frac, seed)
    r, n = sqlkit.rank_over(["event_id"], 42, ["event_type"]), sqlkit.count_over(["event_type"])
    return (f"SELECT * EXCLUDE (_r, _n), CASE WHEN _r < (_n * 2000 + 9999) // 10000 THEN 'test' ELSE 'train' END AS split "
            f"FROM (SELECT *, {r} AS _r, {n} AS _n FROM ({src}))")


def _fit_sql():
    """Per column: decisions, fill value and the standardisation of the transformed column."""
    parts = []
    for c in PREP_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        st = (f"SELECT count(*) AS n, count({x}) AS cnt, min({x}) AS mn, skewness({x}) AS sk, avg({x}) AS av, "
              f"quantile_cont({x}, 0.5) AS med FROM train")
        dec = (f"SELECT *, (n - cnt) / n AS rate, ((n - cnt) / n > 0.05 AND (n - cnt) / n <= 0.30) AS knn, "
               f"(mn >= 0 AND sk IS NOT NULL AND abs(sk) > 1.5) AS lg FROM ({st})")
        dec = f"SELECT *, (knn OR rate > 0) AS ind, CASE WHEN knn THEN av ELSE med END AS fill FROM ({dec})"
        f = f"(CASE WHEN d.lg THEN ln(1 + coalesce({x}, d.fill)) ELSE coalesce({x}, d.fill) END)"
        g = f"(CASE WHEN d.lg THEN ln(1 + CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END) ELSE CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END END)"
        parts.append(f"""d_{c} AS ({dec}),
s_{c} AS (SELECT d.*, avg({f}) AS mu, stddev_pop({f}) AS sd, avg({g}) AS imu, stddev_pop({g}) AS isd
          FROM train, d_{c} d GROUP BY ALL)""")
    return ",\n".join(parts)


def _plan_sql():
    rows = []
    for c in PREP_NUMERIC:
        imp = "CASE WHEN knn THEN 'knn_imputer_5' WHEN ind THEN 'median_with_indicator' ELSE 'median' END"
        sc = "CASE WHEN lg THEN 'log1p_and_standard' ELSE 'standard' END"
        rows.append(f"SELECT '{c}' AS feature, '{c}' AS source_column, 'numeric' AS kind, round(rate, 6) AS missing_rate, "
                    f"{imp} AS imputation, round(fill, 6) AS fill_value, round(sk, 6) AS skewness, {sc} AS scaling, "
                    f"round(mu, 6) AS mean, round(sd, 6) AS std, n::BIGINT AS n_train FROM s_{c}")
        rows.append(f"SELECT '{c}__missing', '{c}', 'indicator', round(rate, 6), 'none', CAST(NULL AS DOUBLE), "
                    f"CAST(NULL AS DOUBLE), {sc}, round(imu, 6), round(isd, 6), n::BIGINT FROM s_{c} WHERE ind")
    return (f"WITH ev AS ({_events_sql()}), train AS (SELECT * FROM ev WHERE split = 'train'),\n{_fit_sql()}\n"
            + sqlkit.union_all(rows))


@query("prep_fit_plan", sql=_plan_sql())
def q_prep_fit_plan(spark, sf):
    ev = events_prepared(spark, sf)
    train = ev.filter(F.col("split") == "train")
    model = prep.fit_prep(train, PREP_NUMERIC)
    return prep.plan_rows(train, model)


def _transform_sql():
    sel = ["t.event_id"]
    for c in PREP_NUMERIC:
        x = f"CAST(t.{c} AS DOUBLE)"
        d = f"s_{c}"
        f = f"(CASE WHEN {d}.lg THEN ln(1 + coalesce({x}, {d}.fill)) ELSE coalesce({x}, {d}.fill) END)"
        g = (f"(CASE WHEN {d}.lg THEN ln(1 + CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END) "
             f"ELSE CASE WHEN {x} IS NULL THEN 1.0 ELSE 0.0 END END)")
        sel.append(f"round(({f} - {d}.mu) / CASE WHEN {d}.sd = 0 OR {d}.sd IS NULL THEN 1.0 ELSE {d}.sd END, 6) AS {c}")
        sel.append(f"round(({g} - {d}.imu) / CASE WHEN {d}.isd = 0 OR {d}.isd IS NULL THEN 1.0 ELSE {d}.isd END, 6) AS {c}__missing")
    frm = ", ".join(f"s_{c}" for c in PREP_NUMERIC)
    return (f"WITH ev AS ({_events_sql()}), train AS (SELECT * FROM ev WHERE split = 'train'),\n{_fit_sql()}\n"
            f"SELECT {', '.join(sel)} FROM ev t, {frm} WHERE t.split = 'test'")


@query("prep_transform", sql=_transform_sql())
def q_prep_transform(spark, sf):
    ev = events_prepared(spark, sf)
    train = ev.filter(F.col("split") == "train")
    model = prep.fit_prep(train, PREP_NUMERIC)
    out = prep.transform(ev.filter(F.col("split") == "test"), model, keep=["event_id"])
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "event_id"])


OH_COLS = ["o_orderpriority", "o_orderstatus"]


def orders_for_onehot(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", *OH_COLS)
    c = corrupt.unseen_categories(o, "o_orderpriority", ["o_orderkey"])
    return o, corrupt.null_burst(c, "o_orderstatus", ["o_orderkey"], 0.1, 7)


@query("onehot_long", sql=f"""WITH fit AS (SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders),
c6 AS ({sqlkit.leading_rows("SELECT * FROM fit", "o_orderkey", "o_orderpriority", "'UNSEEN_CAT_XYZ'")}),
app AS ({sqlkit.null_burst("SELECT * FROM c6", "o_orderstatus", ["o_orderkey"], 0.1, 7)}),
md AS (SELECT o_orderstatus AS m FROM fit WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
imp AS (SELECT app.* REPLACE (coalesce(o_orderstatus, md.m) AS o_orderstatus) FROM app, md),
cats AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS cp, list_sort(list(DISTINCT o_orderstatus)) AS cs FROM fit)
SELECT o_orderkey, 'o_orderpriority' AS column_name, o_orderpriority AS value,
       CAST(nullif(list_position(cp, o_orderpriority), 0) - 1 AS INT) AS onehot_index, len(cp)::INT AS width FROM imp, cats
UNION ALL
SELECT o_orderkey, 'o_orderstatus', o_orderstatus, CAST(nullif(list_position(cs, o_orderstatus), 0) - 1 AS INT), len(cs)::INT
FROM imp, cats""")
def q_onehot_long(spark, sf):
    fit, app = orders_for_onehot(spark, sf)
    modes = prep.most_frequent(fit, ["o_orderstatus"])
    app = app.withColumn("o_orderstatus", F.coalesce("o_orderstatus", F.lit(modes["o_orderstatus"])))
    out = prep.onehot_long(app, prep.category_index(fit, OH_COLS), OH_COLS, ["o_orderkey"])
    return out.withColumns({c: F.col(c).cast("int") for c in ("onehot_index", "width")})
