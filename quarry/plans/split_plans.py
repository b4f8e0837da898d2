"""Queries: splits (X3, X4) and folds."""

from __future__ import annotations

from ..functions.columns import phash_sql
from ..operators import corrupt, folds
from . import sqlkit
from .quality import LI_HASH, LI_KEY
from .registry import query
from .sqlkit import count_over, rank_over
from .tables import load


def _bins_sql(src, keys, seed, cuts_bp, partition=(), rounding="ceil", hash_cols=None):
    add = 9999 if rounding == "ceil" else 0
    r, n = rank_over(keys, seed, partition, hash_cols), count_over(partition)
    terms = " + ".join(f"(_r >= (_n * {c} + {add}) // 10000)::INT" for c in cuts_bp)
    return f"SELECT * EXCLUDE (_r, _n), {terms} AS _bin FROM (SELECT *, {r} AS _r, {n} AS _n FROM ({src}))"


@query("stratified_split", sql="SELECT o_orderkey, o_orderpriority, CASE WHEN _bin = 0 THEN 'test' ELSE 'train' END AS split FROM ("
       + _bins_sql("SELECT o_orderkey, o_orderpriority FROM orders", ["o_orderkey"], 42, [2000], ["o_orderpriority"]) + ")")
def q_stratified_split(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return folds.stratified_split(o, "o_orderpriority", ["o_orderkey"])


_LIK = ", ".join(LI_KEY)


@query("random_split", sql=f"SELECT {_LIK}, CASE WHEN _bin = 0 THEN 'test' ELSE 'train' END AS split FROM ("
       + _bins_sql(f"SELECT {_LIK} FROM lineitem", LI_KEY, 42, [2000], hash_cols=LI_HASH) + ")")
def q_random_split(spark, sf):
    return folds.random_split(load(spark, sf, "lineitem").select(*LI_KEY), LI_KEY, hash_cols=LI_HASH)


CUTS = [2000, 4000, 6000, 8000]


@query("folds_kfold", sql="SELECT p_partkey, _bin AS fold FROM ("
       + _bins_sql("SELECT p_partkey FROM part", ["p_partkey"], 43, CUTS) + ")")
def q_folds_kfold(spark, sf):
    return folds.kfold(load(spark, sf, "part").select("p_partkey"), ["p_partkey"])


@query("folds_stratified", sql="SELECT c_custkey, c_mktsegment, _bin AS fold FROM ("
       + _bins_sql("SELECT c_custkey, c_mktsegment FROM customer", ["c_custkey"], 43, CUTS, ["c_mktsegment"]) + ")")
def q_folds_stratified(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return folds.stratified_kfold(c, "c_mktsegment", ["c_custkey"])


def group_folds_ctes(sizes: str, integer: bool = True, k: int = 5) -> str:
    """Recursive CTEs that end in ``gf`` (g, n_rows, fold): the balanced assignment of the groups of ``sizes`` (g, n_rows).

    Groups above 1/10000 of the rows go one by one to the emptiest fold; the rest fills the folds in hash order."""
    h = phash_sql(["g"], folds.FOLD_SEED, integer)
    least = "list_position(loads, list_min(loads))"
    edges = " + ".join(f"(before >= list_sum(shares[1:{j}]))::INT" for j in range(1, k))
    zeros = ", ".join("0" for _ in range(k))
    level = ", ".join(f"(rest + list_sum(list_sort(loads)[1:{m}])) // {m}" for m in range(1, k + 1))
    return f"""sz AS ({sizes}), tot AS (SELECT sum(n_rows)::BIGINT AS total FROM sz),
hv AS (SELECT g, n_rows, row_number() OVER (ORDER BY n_rows DESC, g NULLS FIRST) AS i FROM sz, tot WHERE n_rows * 10000 > total OR g IS NULL),
step AS (SELECT 0::BIGINT AS i, [{zeros}]::BIGINT[] AS loads, -1 AS fold UNION ALL
  SELECT hv.i, list_transform(range(1, {k + 1}), lambda x: loads[x] + CASE WHEN x = {least} THEN hv.n_rows ELSE 0 END), ({least} - 1)::INT
  FROM step JOIN hv ON hv.i = step.i + 1),
fin AS (SELECT loads, total - list_sum(loads) AS rest FROM step, tot ORDER BY i DESC LIMIT 1),
lv AS (SELECT loads, least({level}) AS level FROM fin),
sh AS (SELECT list_transform(loads, lambda x: CASE WHEN level > x THEN level - x ELSE 0 END) AS shares FROM lv),
lt AS (SELECT g, n_rows, coalesce(sum(n_rows) OVER (ORDER BY {h} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM sz, tot WHERE n_rows * 10000 <= total AND g IS NOT NULL),
gf AS (SELECT hv.g, hv.n_rows, step.fold FROM hv JOIN step USING (i) UNION ALL SELECT g, n_rows, {edges} FROM lt, sh)"""


@query("folds_group", sql="WITH RECURSIVE " + group_folds_ctes("SELECT l_orderkey AS g, count(*) AS n_rows FROM lineitem GROUP BY 1")
       + " SELECT g AS l_orderkey, n_rows, fold::INT AS fold FROM gf")
def q_folds_group(spark, sf):
    return folds.group_kfold(load(spark, sf, "lineitem"), "l_orderkey")


@query("folds_group_rows", sql="WITH RECURSIVE t AS (" + sqlkit.null_burst("SELECT p_partkey, p_brand FROM part", "p_brand", ["p_partkey"], 0.1)
       + "), " + group_folds_ctes("SELECT p_brand AS g, count(*) AS n_rows FROM t GROUP BY 1", integer=False)
       + " SELECT p_partkey, p_brand, fold::INT AS fold FROM t JOIN gf ON g IS NOT DISTINCT FROM p_brand")
def q_folds_group_rows(spark, sf):
    """T3 on rows: few large groups, and rows without a group."""
    p = corrupt.null_burst(load(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"], 0.1)
    return folds.group_folded(p, "p_brand")


@query("folds_time", sql="""SELECT o_orderkey, CASE WHEN r < n - 5 * t THEN -1 ELSE (r - (n - 5 * t)) // t END AS fold FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n,
         count(*) OVER () // 6 AS t FROM orders)""")
def q_folds_time(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return folds.time_series_folds(o, folds.epoch_micros("o_orderdate"), "o_orderkey").select("o_orderkey", "fold")
