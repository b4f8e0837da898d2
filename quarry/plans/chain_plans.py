"""Queries: the chain from a table to a verdict, for a target that can be learnt and one that can't."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import chain
from . import sqlkit
from .eval_plans import _slices_reg_sql
from .quality import LI_HASH, LI_KEY
from .registry import query
from .split_plans import CUTS, _bins_sql
from .tables import load

FEATURES = ["l_quantity", "l_discount"]
SLICES = ["l_returnflag", "l_linestatus"]
#: What is predicted from the same two features: a charge that grows with the quantity, and the tax, which doesn't.
TASKS = {"charge": "l_extendedprice + 2000 * l_quantity", "tax": "l_tax"}


def _solve(src: str, by: str, y: str) -> str:
    """(by, mx, sx, mz, sz, my, bx, bz): ridge (alpha 1) on two standardised features, by Cramer's rule."""
    x, z = FEATURES
    group = f"GROUP BY {by}" if by else ""
    key = f"{by}, " if by else ""
    return f"""SELECT {key}mx, sx, mz, sz, my, ((n + 1) * gx - n * r * gz) / ((n + 1) * (n + 1) - n * r * n * r) AS bx,
  ((n + 1) * gz - n * r * gx) / ((n + 1) * (n + 1) - n * r * n * r) AS bz
FROM (SELECT {key}count(*)::DOUBLE AS n, avg({x}) AS mx, stddev_pop({x}) AS sx, avg({z}) AS mz, stddev_pop({z}) AS sz, avg({y}) AS my,
             covar_pop({x}, {z}) / (stddev_pop({x}) * stddev_pop({z})) AS r,
             count(*) * covar_pop({x}, {y}) / stddev_pop({x}) AS gx, count(*) * covar_pop({z}, {y}) / stddev_pop({z}) AS gz
      FROM ({src}) {group})"""


def _chain_ctes(y: str) -> str:
    y = f"({y})"
    x, z = FEATURES
    split = _bins_sql("SELECT * FROM lineitem", LI_KEY, 42, [2000], hash_cols=LI_HASH)
    fold = "SELECT * EXCLUDE (_bin), _bin AS fold FROM (" + _bins_sql(
        f"SELECT * EXCLUDE (_bin) FROM ({split}) WHERE _bin <> 0", LI_KEY, 43, CUTS, hash_cols=LI_HASH) + ")"
    pred = f"my + bx * ({x} - mx) / sx + bz * ({z} - mz) / sz"
    held = f"SELECT te.*, {pred} AS pred FROM te, fin"
    return f"""tr AS ({fold}), te AS (SELECT * EXCLUDE (_bin) FROM ({split}) WHERE _bin = 0),
others AS (SELECT k.fold AS k, tr.* FROM (SELECT unnest(range(0, 5)) AS fold) k JOIN tr ON tr.fold <> k.fold),
fit AS ({_solve("SELECT * FROM others", "k", y)}),
md AS (SELECT k, avg({y}) AS mean_, quantile_cont({y}, 0.5) AS med_ FROM others GROUP BY k),
lg AS (SELECT fold, 'ridge' AS candidate, {y} AS y, {pred} AS p FROM tr JOIN fit ON k = fold
  UNION ALL SELECT fold, 'dummy_mean', {y}, mean_ FROM tr JOIN md ON k = fold
  UNION ALL SELECT fold, 'dummy_median', {y}, med_ FROM tr JOIN md ON k = fold),
sc AS (SELECT fold, candidate, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS score FROM lg GROUP BY ALL),
cv AS (SELECT candidate, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM sc GROUP BY 1),
ba AS (SELECT max(cv_mean) AS d FROM cv WHERE candidate <> 'ridge'),
fin AS ({_solve("SELECT * FROM tr", "", y)}),
ho AS (SELECT 1 - sum(({y} - pred) * ({y} - pred)) / (var_pop({y}) * count(*)) AS h FROM ({held})),
sl AS (SELECT count(*) AS k, coalesce(string_agg(slice_column || '=' || slice_value, ', ' ORDER BY slice_column || '=' || slice_value), '') AS names
       FROM ({_slices_reg_sql(held, y, 'pred', SLICES)}) WHERE NOT pass_gate),
im AS (SELECT greatest(abs(bx), abs(bz)) / (abs(bx) + abs(bz)) AS s, CASE WHEN abs(bx) >= abs(bz) THEN '{x}' ELSE '{z}' END AS f FROM fin),
mt AS (SELECT cv_mean, cv_std, d, cv_mean > greatest(d + 0.05, 0.05) AS beats, h, s, f, k, names,
              (cv_mean - h) / greatest(abs(cv_mean), 1e-5) AS gap FROM cv, ba, ho, sl, im WHERE candidate = 'ridge')"""


def _gate_sql(task: str, y: str) -> str:
    return f"""SELECT * FROM (WITH {_chain_ctes(y)}
SELECT '{task}' AS task, 'ridge' AS selected, round(d, 6) AS best_dummy, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(h, 6) AS holdout,
  round(gap, 4) AS rel_gap, round(s, 4) AS dominant_share, f AS dominant_feature, k::BIGINT AS failed_slices, beats AS beats_baseline,
  beats AND NOT (gap > 0.25) AND NOT (k > 0) AS pass_gate, r::INT AS retries,
  CASE WHEN NOT beats THEN 'halt' WHEN (gap > 0.25 OR k > 0) AND r < 3 THEN 'model_strategy'
       WHEN gap > 0.25 OR k > 0 THEN 'human_review' ELSE 'explainability' END AS next_step
FROM mt, (SELECT unnest([0, 3]) AS r))"""


def verdict(spark, sf, target: str) -> chain.Verdict:
    li = load(spark, sf, "lineitem").select(*LI_KEY, *FEATURES, *SLICES, F.expr(target).alias("target"))
    return chain.run(li, "target", "regression", LI_KEY, {"ridge": {"alpha": 1.0}}, SLICES, FEATURES, LI_HASH)


@query("chain_verdict", sql=sqlkit.union_all([_gate_sql(t, y) for t, y in TASKS.items()]))
def q_chain_verdict(spark, sf):
    """Two tasks run from the table to their next steps."""

    def of(task: str, target: str) -> DataFrame:
        v = verdict(spark, sf, target)
        dummy = v.candidates.filter("is_dummy").agg(F.max("cv_mean").alias("best_dummy"))
        m = v.metrics.select(F.col("dominant_share_v").alias("s"), F.col("dominant_share_t").alias("f"), F.col("failed_slices_v").alias("k"))
        one = [x.withColumn("task", F.lit(task)) for x in (dummy, m, v.gate, v.next_steps([0, 3]))]
        row = reduce(lambda a, b: a.join(b, "task"), one)
        return row.select(
            "task", F.lit(v.selected).alias("selected"), r6(F.col("best_dummy")).alias("best_dummy"), "cv_mean", "cv_std", "holdout",
            F.round("rel_gap", 4).alias("rel_gap"), F.round("s", 4).alias("dominant_share"), F.col("f").alias("dominant_feature"),
            F.col("k").cast("bigint").alias("failed_slices"), "beats_baseline", "pass_gate", "retries", "next_step")

    # the chains are independent: one's single aggregates run beside the other's passes
    with ThreadPoolExecutor(max_workers=len(TASKS)) as pool:
        return reduce(DataFrame.unionByName, pool.map(of, TASKS, TASKS.values()))
