"""Queries: linear attributions (H1), global importance (H4, H5, T10), correlated pairs
(H6) and representative cases (H7-H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.materialize import pin
from ..operators import explain, folds
from . import sqlkit
from .eval_plans import LI_BIN_SQL, PART_PRED, li_binary
from .quality import LI_HASH, LI_KEY
from .registry import query
from .split_plans import _bins_sql
from .tables import load

# the linear rule model of the binary lineitem task, as coefficients
LI_COEFS = {"l_discount": 1 / 0.3, "l_tax": 1 / 0.24, "l_quantity": 1 / 150}
_K = ", ".join(LI_KEY)


def li_split(spark, sf):
    """Holdout draw over the columns the attributions use, pinned once (read twice)."""
    li = load(spark, sf, "lineitem").select(*LI_KEY, *[c for c in LI_COEFS if c not in LI_KEY])
    return pin(folds.random_split(li, LI_KEY, hash_cols=LI_HASH))


def shap_long(spark, sf):
    s = li_split(spark, sf)
    means = explain.background_means(s.filter(F.col("split") == "train"), list(LI_COEFS))
    return explain.linear_shap(s.filter(F.col("split") == "test"), LI_COEFS, means, LI_KEY)


def _shap_sql():
    s = _bins_sql("SELECT * FROM lineitem", LI_KEY, 42, [2000], hash_cols=LI_HASH)
    m = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in LI_COEFS)
    parts = [f"SELECT {_K}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {c!r} * (CAST({f} AS DOUBLE) - m_{f}) AS shap FROM t, m"
             for f, c in LI_COEFS.items()]
    return f"WITH s AS ({s}), m AS (SELECT {m} FROM s WHERE _bin <> 0), t AS (SELECT * FROM s WHERE _bin = 0)\n" \
        + sqlkit.union_all(parts)


@query("linear_shap", sql=f"SELECT {_K}, feature, round(value, 6) AS value, round(shap, 6) AS shap FROM ({_shap_sql()})")
def q_linear_shap(spark, sf):
    return shap_long(spark, sf).select(*LI_KEY, "feature", r6(F.col("value")).alias("value"), r6(F.col("shap")).alias("shap"))


def _imp_sql():
    imp = " ".join(f"WHEN '{f}' THEN {abs(c)!r}" for f, c in LI_COEFS.items())
    return f"""SELECT feature, round(mean_abs_shap, 6) AS mean_abs_shap, shap_rank::INT AS shap_rank, round(importance, 6) AS importance,
  round(importance / sum(importance) OVER (), 6) AS importance_share, importance / sum(importance) OVER () > 0.5 AS is_dominant
FROM (SELECT feature, avg(abs(shap)) AS mean_abs_shap, CASE feature {imp} END AS importance,
             row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS shap_rank
      FROM ({_shap_sql()}) GROUP BY feature)"""


@query("global_importance", sql=_imp_sql())
def q_global_importance(spark, sf):
    return explain.global_importance(shap_long(spark, sf), LI_COEFS)


CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql():
    parts = []
    k = 0
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            x = f"(CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END)"
            y = f"(CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END)"
            den = f"(stddev_pop({x}) * stddev_pop({y}))"
            r = f"(CASE WHEN {den} = 0 THEN NULL ELSE covar_pop({x}, {y}) / {den} END)"
            parts.append(f"SELECT {k}::INT AS pair_index, '{a}' AS feature_a, '{b}' AS feature_b, round({r}, 6) AS corr, "
                         f"coalesce(abs({r}) > 0.7, false) AS above_limit FROM lineitem")
            k += 1
    return sqlkit.union_all(parts)


@query("correlated_pairs", sql=_pairs_sql())
def q_correlated_pairs(spark, sf):
    return explain.correlated_pairs(load(spark, sf, "lineitem"), CORR_COLS)


def li_cases_input(spark, sf):
    return li_binary(spark, sf).withColumn(
        "prob_pred", F.when(F.col("prediction") == 1, F.col("score")).otherwise(1.0 - F.col("score")))


def _cases_cls_sql():
    t = (f"SELECT *, CASE WHEN prediction = 1 THEN score ELSE 1.0 - score END AS prob_pred, label = prediction AS ok "
         f"FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ({LI_BIN_SQL}))")
    pick = f"SELECT {_K}, label, prediction, prob_pred FROM t"
    return f"""WITH t AS ({t}),
c AS ({pick} WHERE ok ORDER BY -prob_pred, {_K} LIMIT 1),
b AS ({pick} ORDER BY abs(prob_pred - 0.5), {_K} LIMIT 1),
f AS ({pick} WHERE NOT ok ORDER BY -prob_pred, {_K} LIMIT 1)
SELECT 'highest_confidence_correct' AS case_name, * FROM c UNION ALL SELECT 'borderline', * FROM b
UNION ALL SELECT 'failure_case', * FROM (SELECT * FROM f UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f))"""


@query("cases_classification", sql=_cases_cls_sql())
def q_cases_classification(spark, sf):
    d = li_cases_input(spark, sf)
    return explain.cases_classification(d, LI_KEY, "label", "prediction", "prob_pred")


@query("cases_regression", sql=f"""WITH t AS (SELECT p_partkey, p_retailprice, {PART_PRED} AS pred,
  abs(CAST(p_retailprice AS DOUBLE) - ({PART_PRED})) AS abs_error FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY abs_error, p_partkey) - 1 AS rk, count(*) OVER () AS n FROM t),
picks AS (SELECT 'highest_confidence_correct' AS case_name, p_partkey FROM r WHERE rk = 0
          UNION ALL SELECT 'borderline', p_partkey FROM r WHERE rk = n // 2
          UNION ALL SELECT 'failure_case', p_partkey FROM (SELECT p_partkey FROM t ORDER BY -abs_error, p_partkey LIMIT 1))
SELECT case_name, p_partkey, p_retailprice, round(pred, 6) AS pred, round(abs_error, 6) AS abs_error FROM picks JOIN t USING (p_partkey)""")
def q_cases_regression(spark, sf):
    part = load(spark, sf, "part").withColumn("pred", F.expr(PART_PRED))
    c = explain.cases_regression(part, "p_partkey", "p_retailprice", "pred")
    return c.select("case_name", "p_partkey", "p_retailprice", r6(F.col("pred")).alias("pred"),
                    r6(F.col("abs_error")).alias("abs_error"))


def _case_table_sql():
    split = _bins_sql("SELECT * FROM lineitem", LI_KEY, 42, [2000], hash_cols=LI_HASH)
    t = (f"SELECT *, CASE WHEN prediction = 1 THEN score ELSE 1.0 - score END AS prob_pred, label = prediction AS ok "
         f"FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ({LI_BIN_SQL})) "
         f"WHERE ({_K}) IN (SELECT ({_K}) FROM ({split}) WHERE _bin = 0)")
    pick = f"SELECT {_K}, label, prediction, prob_pred FROM t"
    return f"""WITH t AS ({t}),
c AS ({pick} WHERE ok ORDER BY -prob_pred, {_K} LIMIT 1),
b AS ({pick} ORDER BY abs(prob_pred - 0.5), {_K} LIMIT 1),
f AS ({pick} WHERE NOT ok ORDER BY -prob_pred, {_K} LIMIT 1),
cases AS (SELECT 'highest_confidence_correct' AS case_name, * FROM c UNION ALL SELECT 'borderline', * FROM b
          UNION ALL SELECT 'failure_case', * FROM (SELECT * FROM f UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f))),
sh AS ({_shap_sql()})
SELECT cases.case_name, {', '.join('cases.' + k for k in LI_KEY)}, cases.label, cases.prediction,
       round(cases.prob_pred, 6) AS prob_pred, sh.feature, round(sh.value, 6) AS value, round(sh.shap, 6) AS shap
FROM cases JOIN sh USING ({_K})"""


@query("case_table", sql=_case_table_sql())
def q_case_table(spark, sf):
    """H9: the three cases of the holdout rows joined to their attributions."""
    s = li_split(spark, sf)
    means = explain.background_means(s.filter(F.col("split") == "train"), list(LI_COEFS))
    test = s.filter(F.col("split") == "test")
    d = li_cases_input(spark, sf).join(test.select(*LI_KEY), LI_KEY, "left_semi")
    cases = explain.cases_classification(d, LI_KEY, "label", "prediction", "prob_pred")
    t = explain.case_table(cases, explain.linear_shap(test, LI_COEFS, means, LI_KEY), LI_KEY)
    return t.select("case_name", *LI_KEY, "label", "prediction", r6(F.col("prob_pred")).alias("prob_pred"),
                    "feature", r6(F.col("value")).alias("value"), r6(F.col("shap")).alias("shap"))
