"""Queries for items the reference documents without code: target encoding inside folds
(Z3), formula-injection scan (Z4), time-ordered holdout (Z6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import folds, prep, profile
from . import sqlkit
from .registry import query
from .split_plans import CUTS, _bins_sql
from .tables import SCHEMAS, load


@query("target_encoding", sql="""WITH t AS (SELECT p_partkey, p_brand, CAST(p_retailprice AS DECIMAL(38,10)) AS y, _bin AS fold FROM ("""
       + _bins_sql("SELECT * FROM part", ["p_partkey"], 43, CUTS) + """)),
per AS (SELECT p_brand, fold, sum(y) AS s, count(y) AS c FROM t GROUP BY ALL),
tot AS (SELECT p_brand, sum(s) AS S_, sum(c) AS C_ FROM per GROUP BY ALL)
SELECT t.p_partkey, t.p_brand, t.fold, round(CASE WHEN tot.C_ - per.c = 0 THEN NULL
       ELSE CAST(tot.S_ - per.s AS DOUBLE) / CAST(tot.C_ - per.c AS DOUBLE) END, 6)
       AS p_brand__te
FROM t JOIN per USING (p_brand, fold) JOIN tot USING (p_brand)""")
def q_target_encoding(spark, sf):
    p = folds.kfold(load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), ["p_partkey"])
    te = prep.target_encode_oof(p, "p_brand", "p_retailprice")
    return te.select("p_partkey", "p_brand", "fold", r6(F.col("p_brand__te")).alias("p_brand__te"))


SCAN_TABLES = ["customer", "part", "orders", "documents", "conversations"]


def _scan_sql(table):
    cols = [c for c, t in SCHEMAS[table] if t == "string"]
    return sqlkit.union_all([
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({c})::BIGINT AS n_cells, "
        f"count_if(substr({c}, 1, 1) IN ('=', '+', '-', '@'))::BIGINT AS n_formula FROM {table}" for c in cols])


@query("formula_cells", sql=sqlkit.union_all([_scan_sql(t) for t in SCAN_TABLES]))
def q_formula_cells(spark, sf):
    return reduce(DataFrame.unionByName, [
        profile.formula_cells(load(spark, sf, t)).withColumn("table_name", F.lit(t)) for t in SCAN_TABLES])


@query("time_holdout", sql="""SELECT o_orderkey, CASE WHEN r >= n - (n * 2000 + 9999) // 10000 THEN 'test' ELSE 'train' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)""")
def q_time_holdout(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return folds.time_holdout(o, folds.epoch_micros("o_orderdate"), "o_orderkey").select("o_orderkey", "split")


def _fp_text(schema) -> str:
    return ",".join(f"{c}:{t}" for c, t in sorted(schema))


def _versions():
    base = SCHEMAS["orders"]
    v1 = [(c, "string" if c == "o_totalprice" else t) for c, t in base]
    v2 = list(reversed(v1))
    return [("v0", base), ("v1", v1), ("v2", v2)]


@query("schema_history", sql=sqlkit.union_all([
    f"SELECT '{v}' AS version, sha256('{_fp_text(s)}') AS fingerprint, {len(s)} AS n_columns, count(*)::BIGINT AS n_rows, "
    + (f"sha256('{_fp_text(s)}') <> sha256('{_fp_text(prev)}')" if prev else "false")
    + f" AS changed, {str(i == 2).lower()} AS latest FROM orders"
    for i, ((v, s), prev) in enumerate(zip(_versions(), [None] + [x[1] for x in _versions()][:-1]))]))
def q_schema_history(spark, sf):
    """A row per schema version (D1 fingerprint, width, rows), changes against the
    previous version, and the latest one by ``max_by`` over the version rows."""
    from ..operators import corrupt, drift
    o = load(spark, sf, "orders")
    v1 = corrupt.dtype_change(o, "o_totalprice")
    frames = [("v0", o), ("v1", v1), ("v2", corrupt.changed_column_order(v1))]
    rows, prev = [], None
    for v, df in frames:
        fp = drift.fingerprint(df)
        rows.append(df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
            F.lit(v).alias("version"), F.lit(fp).alias("fingerprint"), F.lit(len(df.columns)).alias("n_columns"),
            "n_rows", F.lit(prev is not None and fp != prev).alias("changed")))
        prev = fp
    hist = reduce(DataFrame.unionByName, rows)
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0))  # over the version rows only
    return hist.select("version", "fingerprint", "n_columns", "n_rows", "changed",
                       (F.col("version") == F.max("version").over(w)).alias("latest"))
