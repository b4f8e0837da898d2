"""Queries: class balance (M5, M6, Z2), candidates (M7), dummy CV + gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import phash_sql
from ..functions.materialize import pin
from ..operators import baselines, folds
from . import sqlkit
from .eval_plans import PART_PRED, _auc_sql
from .registry import query
from .split_plans import CUTS, _bins_sql
from .tables import load

BALANCE = [("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("lineitem", "l_returnflag")]


def _balance_sql(table, target):
    return f"""SELECT '{table}' AS table_name, class_label, n::BIGINT AS n, round(n / tot, 6) AS share,
  round(tot / (k * n), 6) AS balanced_weight, round(mx / mn, 6) AS imbalance_ratio,
  (k >= 2 AND mx / mn > 10) AS is_imbalanced, (mn / tot < 0.10) AS minority_under_10pct
FROM (SELECT *, sum(n) OVER () AS tot, count(*) OVER () AS k, max(n) OVER () AS mx, min(n) OVER () AS mn
      FROM (SELECT CAST({target} AS VARCHAR) AS class_label, count(*) AS n FROM {table} WHERE {target} IS NOT NULL GROUP BY 1))"""


@query("class_balance", sql=sqlkit.union_all([_balance_sql(t, c) for t, c in BALANCE]))
def q_class_balance(spark, sf):
    return reduce(DataFrame.unionByName, [
        baselines.class_balance(load(spark, sf, t), c).withColumn("table_name", F.lit(t)) for t, c in BALANCE])


CAND_TABLES = [("orders", "classification"), ("part", "regression"), ("region", "classification"),
               ("supplier", "regression")]


def _cand_sql(table, ptype):
    idx = 0 if ptype == "classification" else 1
    vals = ", ".join(f"('{c[idx]}', {c[2]}, {c[3]})" for c in baselines.CANDIDATES)
    ok = ", ".join(f"'{c[idx]}'" for c in baselines.CANDIDATES[:3])
    return f"""SELECT '{table}' AS table_name, v.candidate, v.tier::INT AS tier, v.min_rows::BIGINT AS min_rows, n.n_rows::BIGINT AS n_rows,
  CASE WHEN n.n_rows < 100 THEN v.candidate IN ({ok}) ELSE n.n_rows >= v.min_rows END AS eligible
FROM (VALUES {vals}) v(candidate, tier, min_rows), (SELECT count(*) AS n_rows FROM {table}) n"""


@query("candidates", sql=sqlkit.union_all([_cand_sql(t, p) for t, p in CAND_TABLES]))
def q_candidates(spark, sf):
    return reduce(DataFrame.unionByName, [
        baselines.candidates(load(spark, sf, t), p).withColumn("table_name", F.lit(t)) for t, p in CAND_TABLES])


ORDERS_RULE = ("CASE WHEN o_orderstatus = 'F' THEN '1-URGENT' WHEN o_orderstatus = 'O' THEN '3-MEDIUM' "
               "ELSE '5-LOW' END")


def _gate_sql(cv, ptype):
    need = "d * 1.05" if ptype == "classification" else "greatest(d + 0.05, 0.05)"
    return f"""SELECT candidate, scorer, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, is_dummy, beats_baseline,
  CASE WHEN bool_or(beats_baseline) OVER () THEN beats_baseline AND cv_mean = max(CASE WHEN beats_baseline THEN cv_mean END) OVER ()
       ELSE cv_mean = max(cv_mean) OVER () END AS selected
FROM (SELECT *, (NOT is_dummy AND cv_mean > {need}) AS beats_baseline FROM (
  SELECT *, starts_with(candidate, 'dummy') AS is_dummy,
         coalesce(max(CASE WHEN starts_with(candidate, 'dummy') THEN cv_mean END) OVER (), 0.0) AS d FROM ({cv})))"""


def _cls_cv_sql():
    t = (f"SELECT o_orderkey, CAST(o_orderpriority AS VARCHAR) AS y, {ORDERS_RULE} AS rule, _bin AS fold FROM ("
         + _bins_sql("SELECT * FROM orders", ["o_orderkey"], 43, CUTS) + ")")
    u = f"({phash_sql(['o_orderkey'], 42)} / 268435456.0)"
    return f"""WITH t AS ({t}),
cnt AS (SELECT fold, y, count(*) AS n FROM t GROUP BY ALL),
tot AS (SELECT y, sum(n) AS N FROM cnt GROUP BY y),
tr AS (SELECT f.fold, tot.y, tot.N - coalesce(cnt.n, 0) AS tn FROM (SELECT unnest(range(0, 5)) AS fold) f CROSS JOIN tot
       LEFT JOIN cnt ON cnt.fold = f.fold AND cnt.y = tot.y),
cdf AS (SELECT fold, y, sum(tn) OVER (PARTITION BY fold ORDER BY y ROWS UNBOUNDED PRECEDING) / sum(tn) OVER (PARTITION BY fold) AS p FROM tr),
s AS (SELECT t.*, (SELECT c.y FROM cdf c WHERE c.fold = t.fold AND c.p > {u} ORDER BY c.y LIMIT 1) AS strat FROM t),
long AS (SELECT s.fold, 'dummy_most_frequent' AS candidate, k.y AS class_label, (s.y = k.y)::INT AS yk, 0.0 AS sk FROM s, tot k
   UNION ALL SELECT s.fold, 'dummy_stratified', k.y, (s.y = k.y)::INT, (s.strat = k.y)::INT::DOUBLE FROM s, tot k
   UNION ALL SELECT s.fold, 'rule_model', k.y, (s.y = k.y)::INT, (s.rule = k.y)::INT::DOUBLE FROM s, tot k),
a AS ({_auc_sql('SELECT * FROM long', 'yk', 'sk', ['fold', 'candidate', 'class_label'])}),
fs AS (SELECT fold, candidate, CASE WHEN bool_and(auc IS NOT NULL) THEN avg(auc) ELSE 0.5 END AS score FROM a GROUP BY ALL)
SELECT candidate, 'roc_auc_ovr' AS scorer, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM fs GROUP BY candidate"""


def _reg_cv_sql():
    t = (f"SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS y, {PART_PRED} AS rule, _bin AS fold FROM ("
         + _bins_sql("SELECT * FROM part", ["p_partkey"], 43, CUTS) + ")")
    return f"""WITH t AS ({t}),
sm AS (SELECT fold, count(y) AS n, sum(y) AS s FROM t GROUP BY fold),
fit AS (SELECT fold, ((SELECT sum(s) FROM sm) - s) / ((SELECT sum(n) FROM sm) - n) AS mean_,
               (SELECT quantile_cont(t2.y, 0.5) FROM t t2 WHERE t2.fold <> sm.fold) AS median_ FROM sm),
d AS (SELECT t.*, fit.mean_, fit.median_ FROM t JOIN fit USING (fold)),
long AS (SELECT fold, 'dummy_mean' AS candidate, y, mean_ AS p FROM d UNION ALL SELECT fold, 'dummy_median', y, median_ FROM d
         UNION ALL SELECT fold, 'rule_model', y, rule FROM d),
g AS (SELECT fold, candidate, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(y) AS sst FROM long GROUP BY ALL),
fs AS (SELECT fold, candidate, CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS score FROM g)
SELECT candidate, 'r2' AS scorer, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM fs GROUP BY candidate"""


@query("dummy_scores", sql=sqlkit.union_all([
    f"SELECT 'orders' AS table_name, * FROM ({_gate_sql(_cls_cv_sql(), 'classification')})",
    f"SELECT 'part' AS table_name, * FROM ({_gate_sql(_reg_cv_sql(), 'regression')})",
]))
def q_dummy_scores(spark, sf):
    # folded inputs are read by several passes: pin them once
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.expr(ORDERS_RULE).alias("rule"))
    o = pin(folds.kfold(o, ["o_orderkey"]))
    cls = baselines.dummy_cv_classification(o, "o_orderpriority", ["o_orderkey"], "fold", rule_pred="rule")
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice", F.expr(PART_PRED).alias("rule"))
    p = pin(folds.kfold(p, ["p_partkey"]))
    reg = baselines.dummy_cv_regression(p, "p_retailprice", "fold", rule_pred="rule")
    return baselines.baseline_gate(cls, "classification").withColumn("table_name", F.lit("orders")).unionByName(
        baselines.baseline_gate(reg, "regression").withColumn("table_name", F.lit("part")))
