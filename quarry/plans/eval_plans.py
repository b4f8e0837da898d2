"""Queries: evaluation metrics (E1-E14) on rule-based predictions over the given tables.

Scores are plain arithmetic of columns (no exp/log), so every engine computes the same
doubles and the oracle can compare exact curves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from . import sqlkit
from .registry import query
from .tables import load

CLASSES = ["A", "N", "R"]

# the rule-based "models" (same text for Spark and the oracle)
LI_BINARY = {
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "score": "(l_discount / 0.1 + l_tax / 0.08 + l_quantity / 50.0) / 3.0",
}
LI_RAW = {"A": "(1.0 + l_discount * 10.0)", "N": "(1.0 + l_tax * 12.5)", "R": "(1.0 + l_quantity / 50.0)"}
LI_SUM = " + ".join(LI_RAW.values())
LI_PROBS = {k: f"({v} / ({LI_SUM}))" for k, v in LI_RAW.items()}
LI_PRED_FLAG = (f"CASE WHEN {LI_PROBS['A']} >= {LI_PROBS['N']} AND {LI_PROBS['A']} >= {LI_PROBS['R']} THEN 'A' "
                f"WHEN {LI_PROBS['N']} >= {LI_PROBS['R']} THEN 'N' ELSE 'R' END")
PART_PRED = "900.0 + (p_partkey % 1000) / 10.0"
LI_PRICE_PRED = "l_quantity * 950.0"
ORDERS_PRED = "150000.0 + (o_custkey % 1000) * 200.0"


def li_binary(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select("*", F.expr(LI_BINARY["label"]).alias("label"), F.expr(LI_BINARY["score"]).alias("score")) \
        .withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def li_multi(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select("*", *[F.expr(v).alias(f"p_{k}") for k, v in LI_PROBS.items()],
                     F.expr(LI_PRED_FLAG).alias("pred_flag"))


LI_BIN_SQL = f"SELECT *, {LI_BINARY['label']} AS label, {LI_BINARY['score']} AS score FROM lineitem"
LI_MULTI_SQL = ("SELECT *, " + ", ".join(f"{v} AS p_{k}" for k, v in LI_PROBS.items())
                + f", {LI_PRED_FLAG} AS pred_flag FROM lineitem")


def _confusion_sql(src, y, p):
    return f"""WITH t AS ({src}), k AS (SELECT CAST({y} AS VARCHAR) AS actual, CAST({p} AS VARCHAR) AS predicted, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT actual AS c FROM k UNION SELECT predicted FROM k)
SELECT a.c AS actual, b.c AS predicted, coalesce(k.n, 0)::BIGINT AS n FROM c a, c b
LEFT JOIN k ON k.actual = a.c AND k.predicted = b.c"""


@query("confusion_long", sql=_confusion_sql(LI_MULTI_SQL, "l_returnflag", "pred_flag"))
def q_confusion_long(spark, sf):
    return evaluate.confusion_long(li_multi(spark, sf), "l_returnflag", "pred_flag")


def _report_sql(src, y, p):
    cm = _confusion_sql(src, y, p)
    return f"""WITH cm AS ({cm}),
per AS (SELECT actual AS class_label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n END) AS tp FROM cm GROUP BY actual),
pr AS (SELECT predicted AS class_label, sum(n) AS n_predicted FROM cm GROUP BY predicted),
r AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per JOIN pr USING (class_label)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r),
tot AS (SELECT sum(tp) / sum(support) AS accuracy, sum(support * f1) / sum(support) AS f1_weighted FROM f)
SELECT class_label, support::BIGINT AS support, n_predicted::BIGINT AS n_predicted, tp::BIGINT AS tp,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted FROM f, tot"""


@query("class_report", sql=_report_sql(LI_MULTI_SQL, "l_returnflag", "pred_flag"))
def q_class_report(spark, sf):
    return evaluate.class_report(li_multi(spark, sf), "l_returnflag", "pred_flag")


def _curve_sql(src, y, s, groups=()):
    g = ", ".join(groups)
    gsel = f"{g}, " if groups else ""
    part = f"PARTITION BY {g} " if groups else ""
    return f"""(SELECT {gsel}score, pos, neg, sum(pos) OVER (PARTITION BY {g or '1'}) AS P, sum(neg) OVER (PARTITION BY {g or '1'}) AS N,
  coalesce(sum(pos) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
  coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
 FROM (SELECT {gsel}CAST({s} AS DOUBLE) AS score, sum({y}) AS pos, sum(1 - {y}) AS neg FROM ({src})
       WHERE {s} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL))"""


def _auc_sql(src, y, s, groups=()):
    g = ", ".join(groups)
    gsel = f"{g}, " if groups else ""
    return (f"SELECT {gsel}first(P)::BIGINT AS P, first(N)::BIGINT AS N, CASE WHEN first(P) > 0 AND first(N) > 0 THEN "
            f"sum(pos * (neg_below + neg / 2.0)) / (first(P) * first(N)) END AS auc FROM {_curve_sql(src, y, s, groups)}"
            + (f" GROUP BY {g}" if groups else ""))


@query("auc_binary", sql=f"SELECT P, N, round(auc, 6) AS auc FROM ({_auc_sql(LI_BIN_SQL, 'label', 'score')})")
def q_auc_binary(spark, sf):
    a = evaluate.auc(li_binary(spark, sf), F.col("label"), F.col("score"))
    return a.select(F.col("P").cast("bigint").alias("P"), F.col("N").cast("bigint").alias("N"), evaluate.r6(F.col("auc")).alias("auc"))


def _ovr_long_sql():
    parts = [f"SELECT '{k}' AS class_label, CASE WHEN l_returnflag = '{k}' THEN 1 ELSE 0 END AS y, p_{k} AS s FROM ({LI_MULTI_SQL})"
             for k in CLASSES]
    return sqlkit.union_all(parts)


@query("auc_ovr", sql=f"""WITH a AS ({_auc_sql(_ovr_long_sql(), 'y', 's', ['class_label'])})
SELECT class_label, round(auc, 6) AS auc FROM a
UNION ALL SELECT '__macro__', round(CASE WHEN bool_and(auc IS NOT NULL) THEN avg(auc) ELSE 0.5 END, 6) FROM a""")
def q_auc_ovr(spark, sf):
    m = li_multi(spark, sf)
    long = m.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("class_label"), (F.col("l_returnflag") == k).cast("int").alias("y"),
                 F.col(f"p_{k}").alias("s")) for k in CLASSES])).alias("r")).select("r.*")
    a = evaluate.auc(long, F.col("y"), F.col("s"), ["class_label"])
    per = a.select("class_label", evaluate.r6(F.col("auc")).alias("auc"))
    macro = a.agg(F.when(F.every(F.col("auc").isNotNull()), F.avg("auc")).otherwise(F.lit(0.5)).alias("auc")) \
        .select(F.lit("__macro__").alias("class_label"), evaluate.r6(F.col("auc")).alias("auc"))
    return per.unionByName(macro)


@query("pr_curve", sql=f"""SELECT score AS threshold,
  round(CASE WHEN (P + N) - (pos_below + neg_below) > 0 THEN (P - pos_below) / ((P + N) - (pos_below + neg_below)) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN P > 0 THEN (P - pos_below) / P ELSE 0.0 END, 6) AS recall FROM {_curve_sql(LI_BIN_SQL, 'label', 'score')}
UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr_curve(spark, sf):
    return evaluate.pr_curve(li_binary(spark, sf), F.col("label"), F.col("score"))


def _ece_sql(src, y, p):
    edges = evaluate._edges_ece()
    b = " + ".join(f"(conf > {e!r})::INT" for e in edges[1:-1])
    arr = "[" + ", ".join(repr(e) for e in edges) + "]"
    return f"""WITH t AS (SELECT CASE WHEN {p} >= 0.5 THEN {p} ELSE 1.0 - {p} END AS conf,
                  CASE WHEN (CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END) = {y} THEN 1.0 ELSE 0.0 END AS acc FROM ({src})),
b AS (SELECT conf, acc, {b} AS bin FROM t),
n AS (SELECT count(*) AS _n FROM t),
per AS (SELECT bin, count(*) AS n, avg(conf) AS mean_conf, avg(acc) AS accuracy FROM b WHERE conf > 0 GROUP BY bin),
s AS (SELECT per.*, n / _n AS share FROM per, n)
SELECT bin::INT AS bin, round({arr}[bin + 1], 6) AS lo, round({arr}[bin + 2], 6) AS hi, n::BIGINT AS n, round(share, 6) AS share,
       round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy,
       round(sum(share * abs(mean_conf - accuracy)) OVER (), 6) AS ece FROM s"""


@query("ece_bins", sql=_ece_sql(LI_BIN_SQL, "label", "score"))
def q_ece_bins(spark, sf):
    return evaluate.ece_bins(li_binary(spark, sf), "label", prob="score")


def _erfc_sql(x):
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = repr(coef[-1])
    for c in reversed(coef[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    ans = f"({t} * exp(-abs({x}) * abs({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def _regression_sql(table, src, y, p):
    e = f"(CAST({y} AS DOUBLE) - CAST({p} AS DOUBLE))"
    den = f"(stddev_pop(CAST({p} AS DOUBLE)) * stddev_pop({e} * {e}))"
    r = f"(CASE WHEN {den} = 0 THEN NULL ELSE covar_pop(CAST({p} AS DOUBLE), {e} * {e}) / {den} END)"
    return f"""SELECT '{table}' AS table_name, n::BIGINT AS n, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
  round(CASE WHEN sst > 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2, round(lm, 6) AS bp_lm,
  round(coalesce({_erfc_sql('sqrt(lm / 2.0)')}, 1.0), 6) AS bp_p_value
FROM (SELECT *, CASE WHEN n >= 5 AND r IS NOT NULL THEN n * r * r END AS lm FROM (
  SELECT count(*) AS n, avg({e} * {e}) AS mse, avg(abs({e})) AS mae, sum({e} * {e}) AS sse,
         var_pop(CAST({y} AS DOUBLE)) * count(*) AS sst, {r} AS r
  FROM ({src}) WHERE {y} IS NOT NULL AND {p} IS NOT NULL))"""


@query("regression_report", sql=sqlkit.union_all([
    _regression_sql("part", f"SELECT *, {PART_PRED} AS pred FROM part", "p_retailprice", "pred"),
    _regression_sql("lineitem", f"SELECT *, {LI_PRICE_PRED} AS pred FROM lineitem", "l_extendedprice", "pred"),
]))
def q_regression_report(spark, sf):
    part = load(spark, sf, "part").withColumn("pred", F.expr(PART_PRED))
    li = load(spark, sf, "lineitem").withColumn("pred", F.expr(LI_PRICE_PRED))
    return reduce(DataFrame.unionByName, [
        evaluate.regression_report(part, "p_retailprice", "pred").withColumn("table_name", F.lit("part")),
        evaluate.regression_report(li, "l_extendedprice", "pred").withColumn("table_name", F.lit("lineitem")),
    ])


def _slices_cls_sql(src, slices):
    long = sqlkit.union_all([f"SELECT '{c}' AS slice_column, CAST({c} AS VARCHAR) AS slice_value, label, prediction, score FROM ({src})"
                             for c in slices])
    return f"""WITH long AS ({long}),
st AS (SELECT slice_column, slice_value, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc,
              min(label) = max(label) AS single FROM long GROUP BY ALL),
a AS ({_auc_sql('SELECT * FROM long', 'label', 'score', ['slice_column', 'slice_value'])}),
j AS (SELECT st.*, a.auc, CASE WHEN st.single OR a.auc IS NULL THEN 'accuracy' ELSE 'auc' END AS metric
      FROM st LEFT JOIN (SELECT slice_column, slice_value, auc FROM a) a USING (slice_column, slice_value) WHERE n >= 10)
SELECT slice_column, slice_value, n::BIGINT AS n, metric, round(CASE WHEN metric = 'auc' THEN auc ELSE acc END, 6) AS score,
       (CASE WHEN metric = 'auc' THEN auc ELSE acc END) >= 0.55 AS pass_gate FROM j"""


LI_SLICES = ["l_returnflag", "l_linestatus"]


@query("slices_classification", sql=_slices_cls_sql(
    f"SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ({LI_BIN_SQL})", LI_SLICES))
def q_slices_classification(spark, sf):
    return evaluate.slices_classification(li_binary(spark, sf), "label", "prediction", "score", LI_SLICES)


MULTI_SLICES = ["l_linestatus", "l_linenumber"]


def _slices_multi_sql():
    src = f"SELECT *, CAST(l_linenumber AS VARCHAR) AS _ln FROM ({LI_MULTI_SQL})"
    long = sqlkit.union_all([f"SELECT '{c}' AS slice_column, CAST({c} AS VARCHAR) AS slice_value, l_returnflag AS y, "
                             f"CASE WHEN l_returnflag = pred_flag THEN 1.0 ELSE 0.0 END AS hit, "
                             + ", ".join(f"p_{k}" for k in CLASSES) + f" FROM ({src})" for c in MULTI_SLICES])
    each = sqlkit.union_all([f"SELECT slice_column, slice_value, '{k}' AS k, CASE WHEN y = '{k}' THEN 1 ELSE 0 END AS is_k, p_{k} AS s "
                             f"FROM ({long})" for k in CLASSES])
    return f"""WITH a AS (SELECT slice_column, slice_value, CASE WHEN bool_and(auc IS NOT NULL) THEN avg(auc) END AS auc
  FROM ({_auc_sql(each, 'is_k', 's', ['slice_column', 'slice_value', 'k'])}) GROUP BY ALL),
st AS (SELECT slice_column, slice_value, count(*) AS n, avg(hit) AS acc, min(y) = max(y) AS single FROM ({long}) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT st.*, CASE WHEN single OR auc IS NULL THEN acc ELSE auc END AS val FROM st LEFT JOIN a USING (slice_column, slice_value))
SELECT slice_column, slice_value, n::BIGINT AS n, CASE WHEN single THEN 'accuracy' ELSE 'auc' END AS metric, round(val, 6) AS score,
       val >= 0.55 AS pass_gate FROM v"""


@query("slices_multiclass", sql=_slices_multi_sql())
def q_slices_multiclass(spark, sf):
    return evaluate.slices_multiclass(li_multi(spark, sf), "l_returnflag", "pred_flag", {k: f"p_{k}" for k in CLASSES}, MULTI_SLICES)


ORDER_SLICES = ["o_orderpriority", "o_orderstatus"]


def _slices_reg_sql(src, y, p, slices):
    long = sqlkit.union_all([f"SELECT '{c}' AS slice_column, CAST({c} AS VARCHAR) AS slice_value, "
                             f"CAST({y} AS DOUBLE) AS y, CAST({p} AS DOUBLE) AS p FROM ({src})" for c in slices])
    return f"""SELECT slice_column, slice_value, n::BIGINT AS n, 'r2' AS metric, round(r2, 6) AS score, r2 >= -0.5 AS pass_gate FROM (
  SELECT slice_column, slice_value, count(*) AS n,
         CASE WHEN var_pop(y) * count(*) > 0 THEN 1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))
              WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END AS r2
  FROM ({long}) GROUP BY ALL) WHERE n >= 10"""


@query("slices_regression", sql=_slices_reg_sql(f"SELECT *, {ORDERS_PRED} AS pred FROM orders", "o_totalprice", "pred",
                                                ORDER_SLICES))
def q_slices_regression(spark, sf):
    o = load(spark, sf, "orders").withColumn("pred", F.expr(ORDERS_PRED))
    return evaluate.slices_regression(o, "o_totalprice", "pred", ORDER_SLICES)


def _ece_multi_sql():
    edges = evaluate._edges_ece()
    b = " + ".join(f"(conf > {e!r})::INT" for e in edges[1:-1])
    arr = "[" + ", ".join(repr(e) for e in edges) + "]"
    pa, pn, pr = (f"p_{k}" for k in CLASSES)
    # first maximum wins (class order A, N, R)
    arg = f"CASE WHEN {pa} = conf THEN 'A' WHEN {pn} = conf THEN 'N' ELSE 'R' END"
    return f"""WITH m AS (SELECT *, greatest({pa}, {pn}, {pr}) AS conf FROM ({LI_MULTI_SQL})),
t AS (SELECT conf, CASE WHEN {arg} = l_returnflag THEN 1.0 ELSE 0.0 END AS acc FROM m),
b AS (SELECT conf, acc, CASE WHEN conf > 0 THEN {b} ELSE -1 END AS bin FROM t),
per AS (SELECT bin, count(*) AS n, avg(conf) AS mean_conf, avg(acc) AS accuracy FROM b GROUP BY bin),
s AS (SELECT per.*, n / sum(n) OVER () AS share FROM per)
SELECT bin::INT AS bin, round({arr}[bin + 1], 6) AS lo, round({arr}[bin + 2], 6) AS hi, n::BIGINT AS n, round(share, 6) AS share,
       round(mean_conf, 6) AS mean_conf, round(accuracy, 6) AS accuracy,
       round(sum(share * abs(mean_conf - accuracy)) OVER (), 6) AS ece FROM s WHERE bin >= 0"""


@query("ece_multiclass", sql=_ece_multi_sql())
def q_ece_multiclass(spark, sf):
    """E8, multiclass: argmax class (first on ties) and its probability as confidence."""
    return evaluate.ece_bins(li_multi(spark, sf), "l_returnflag", prob_cols=[f"p_{k}" for k in CLASSES],
                             classes=CLASSES)
