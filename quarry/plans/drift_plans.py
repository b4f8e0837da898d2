"""Queries: schema identity and diff (D1-D3, C4, C8, R16, R17), PSI."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import corrupt, drift, risk, versions
from ..sources.files import scratch_path
from . import sqlkit
from .registry import query
from .tables import SCHEMAS, kind, load

PSI_NUMERIC = ["event_id", "user_id", "value"]
PSI_CATEGORICAL = ["event_type"]


def orders_changed(spark, sf):
    return corrupt.changed_column_order(corrupt.dtype_change(load(spark, sf, "orders"), "o_totalprice"))


def _schema_rows():
    base = SCHEMAS["orders"]
    cur = [(c, "string" if c == "o_totalprice" else t) for c, t in reversed(base)]
    fp = lambda s: ",".join(f"{c}:{t}" for c, t in sorted(s))
    rows = []
    bt, ct = dict(base), dict(cur)
    for c in sorted(set(bt) | set(ct)):
        b, k = bt.get(c), ct.get(c)
        status = "added" if b is None else "removed" if k is None else "dtype_changed" if b != k else "same"
        n2t = (b is not None and kind(b) == "numeric") and not (k is not None and kind(k) == "numeric")
        rows.append(f"('{c}', {sqlkit_q(b)}, {sqlkit_q(k)}, '{status}', {str(n2t).lower()})")
    return rows, fp(base), fp(cur)


def sqlkit_q(v):
    return "NULL" if v is None else f"'{v}'"


def _schema_sql():
    rows, fb, fc = _schema_rows()
    counts = sqlkit.union_all(f"SELECT '{c}' AS column_name, count({c}) AS n FROM orders" for c, _ in SCHEMAS["orders"])
    return (f"SELECT v.*, n AS baseline_values, n AS current_values, sha256('{fb}') AS baseline_fingerprint, "
            f"sha256('{fc}') AS current_fingerprint FROM (VALUES {', '.join(rows)}) "
            f"v(column_name, baseline_dtype, current_dtype, status, numeric_to_text) JOIN ({counts}) USING (column_name)")


@query("schema_diff", sql=_schema_sql())
def q_schema_diff(spark, sf):
    return drift.schema_diff(load(spark, sf, "orders"), orders_changed(spark, sf))


def events_halves(spark, sf):
    ev = load(spark, sf, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    lo, hi = ev.agg(F.min(us), F.max(us)).first()
    mid = (lo + hi) // 2
    base = ev.filter(us < F.lit(mid))
    cur = corrupt.extreme_outliers(ev.filter(us >= F.lit(mid)), "value", ["event_id"])
    return base, cur


_HALVES = """ev AS (SELECT *, epoch_us(ts) AS _us FROM events),
mid AS (SELECT (min(_us) + max(_us)) // 2 AS m FROM ev),
base AS (SELECT ev.* EXCLUDE (_us) FROM ev, mid WHERE _us < m),
cur0 AS (SELECT ev.* EXCLUDE (_us) FROM ev, mid WHERE _us >= m),
cur AS (SELECT l.* REPLACE (CASE WHEN z._lead = 1 THEN (SELECT (max(value) + 1) * 1000 FROM cur0) ELSE l.value END AS value)
        FROM cur0 l LEFT JOIN (SELECT event_id, 1 AS _lead FROM cur0 ORDER BY event_id LIMIT 5) z USING (event_id))"""


def _psi_tail(cnt: str, method: str) -> str:
    return f"""(SELECT column_name, '{method}' AS method, count(*)::BIGINT AS n_bins,
   round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM (
  SELECT column_name, pe / sum(pe) OVER (PARTITION BY column_name) AS pe, pa / sum(pa) OVER (PARTITION BY column_name) AS pa
  FROM (SELECT column_name, CASE WHEN e / ne = 0 THEN 1e-4 ELSE e / ne END AS pe,
               CASE WHEN a / na = 0 THEN 1e-4 ELSE a / na END AS pa FROM ({cnt}) WHERE ne > 0 AND na > 0))
 GROUP BY column_name)"""


def _psi_numeric_sql(c: str) -> str:
    qs = ", ".join(f"{i / 10}" for i in range(11))
    edges = (f"(SELECT list_concat([q[1] - 1e-5], q[2:len(q) - 1], [q[len(q)] + 1e-5]) AS e FROM "
             f"(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{qs}]))) AS q FROM base))")
    binexpr = (f"CASE WHEN v < e[1] OR v > e[len(e)] THEN -1 ELSE len(list_filter(e[2:len(e) - 1], lambda x: v >= x)) END")
    sides = (f"SELECT 0 AS side, CAST({c} AS DOUBLE) AS v FROM base WHERE {c} IS NOT NULL UNION ALL "
             f"SELECT 1 AS side, CAST({c} AS DOUBLE) AS v FROM cur WHERE {c} IS NOT NULL")
    binned = f"SELECT side, {binexpr} AS bin FROM ({sides}), {edges}"
    counts = f"SELECT bin, count_if(side = 0) AS e, count_if(side = 1) AS a FROM ({binned}) GROUP BY bin"
    tot = f"SELECT sum(e) AS ne, sum(a) AS na FROM ({counts})"
    allb = f"SELECT unnest(range(0, len(e) - 1)) AS bin FROM {edges}"
    full = (f"SELECT '{c}' AS column_name, b.bin, coalesce(k.e, 0) AS e, coalesce(k.a, 0) AS a, t.ne, t.na "
            f"FROM ({allb}) b LEFT JOIN ({counts}) k USING (bin), ({tot}) t")
    return _psi_tail(full, "quantile_bins")


def _psi_categorical_sql(c: str) -> str:
    sides = (f"SELECT 0 AS side, CAST({c} AS VARCHAR) AS v FROM base WHERE {c} IS NOT NULL UNION ALL "
             f"SELECT 1 AS side, CAST({c} AS VARCHAR) AS v FROM cur WHERE {c} IS NOT NULL")
    counts = f"SELECT v, count_if(side = 0) AS e, count_if(side = 1) AS a FROM ({sides}) GROUP BY v"
    full = (f"SELECT '{c}' AS column_name, k.e, k.a, t.ne, t.na FROM ({counts}) k, "
            f"(SELECT sum(e) AS ne, sum(a) AS na FROM ({counts})) t")
    return _psi_tail(full, "categories")


def _band(x):
    return f"CASE WHEN {x} < 0.1 THEN 'stable' WHEN {x} < 0.2 THEN 'moderate' ELSE 'drift' END"


def _psi_sql(parts):
    body = sqlkit.union_all([f"SELECT * FROM {p}" for p in parts])
    return f"WITH {_HALVES}\nSELECT *, {_band('psi')} AS band FROM ({body})"


@query("psi_numeric", sql=_psi_sql([_psi_numeric_sql(c) for c in PSI_NUMERIC]))
def q_psi_numeric(spark, sf):
    base, cur = events_halves(spark, sf)
    return drift.psi(base, cur, PSI_NUMERIC)


@query("psi_categorical", sql=_psi_sql([_psi_categorical_sql(c) for c in PSI_CATEGORICAL]))
def q_psi_categorical(spark, sf):
    base, cur = events_halves(spark, sf)
    return drift.psi(base, cur, PSI_CATEGORICAL)


def _drift_flags_sql():
    rows, fb, fc = _schema_rows()
    changed = sorted(r.split("'")[1] for r in rows if "'dtype_changed'" in r)
    schema_part = (f"SELECT 'drift' AS stage, 'critical' AS level, 'SCHEMA_DTYPE_MISMATCH' AS code, "
                   f"CAST(NULL AS VARCHAR) AS feature, 'dtype changed: {', '.join(changed)}' AS description, "
                   f"true AS requires_approval WHERE sha256('{fb}') <> sha256('{fc}')")
    psi_rows = f"SELECT * FROM ({_psi_sql([_psi_numeric_sql(c) for c in PSI_NUMERIC])}) WHERE psi >= 0.2"
    psi_part = (f"SELECT 'drift' AS stage, 'warning' AS level, 'DRIFT_DETECTED' AS code, CAST(NULL AS VARCHAR) AS feature, "
                f"'distribution shift in: ' || string_agg(printf('%s (PSI=%.3f)', column_name, psi), ', ' "
                f"ORDER BY column_name) AS description, false AS requires_approval FROM ({psi_rows}) HAVING count(*) > 0")
    return sqlkit.union_all([schema_part, psi_part])


@query("drift_flags", sql=_drift_flags_sql())
def q_drift_flags(spark, sf):
    diff = drift.schema_diff(load(spark, sf, "orders"), orders_changed(spark, sf))
    base, cur = events_halves(spark, sf)
    scores = drift.psi(base, cur, PSI_NUMERIC)
    return risk.union_flags([drift.schema_flags(diff), drift.psi_flags(scores)])


# three versions of orders, of different years; the last has its price as text and its columns reversed
VERSION_YEARS = [("v0", 0, 1997), ("v1", 1997, 1999), ("v2", 1999, 9999)]
VERSION_NUMERIC, VERSION_CATEGORIES = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderpriority", "o_orderstatus"]


def _history_sql():
    def rows(i):
        _, lo, hi = VERSION_YEARS[i]
        price = "CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 1.5 ELSE o_totalprice END AS o_totalprice" if i == 1 else "o_totalprice AS o_totalprice"
        return f"SELECT * REPLACE ({price}) FROM orders WHERE year(o_orderdate) >= {lo} AND year(o_orderdate) < {hi}"
    base = SCHEMAS["orders"]
    text = [(c, "string" if c == "o_totalprice" else t) for c, t in base]
    schemas = [base, base, text[::-1]]
    marks = [",".join(f"{c}:{t}" for c, t in sorted(x)) for x in schemas]
    parts = []
    for i, (v, _, _) in enumerate(VERSION_YEARS):
        listed = ", ".join(f"('{c}', {p}::INT, '{t}')" for p, (c, t) in enumerate(schemas[i]))
        psi = "SELECT NULL::VARCHAR AS column_name, NULL::VARCHAR AS method, NULL::BIGINT AS n_bins, NULL::DOUBLE AS psi WHERE false"
        if i:
            body = sqlkit.union_all([f"SELECT * FROM {p}" for p in [*map(_psi_numeric_sql, VERSION_NUMERIC), *map(_psi_categorical_sql, VERSION_CATEGORIES)]])
            psi = f"WITH base AS ({rows(i - 1)}), cur AS ({rows(i)}) {body}"
        changed = str(i > 0 and marks[i] != marks[i - 1]).lower()
        parts.append(f"SELECT '{v}' AS version, {i}::INT AS no, sha256('{marks[i]}') AS fingerprint, {len(base)}::INT AS n_columns, "
                     f"(SELECT count(*) FROM ({rows(i)})) AS n_rows, {changed} AS changed, {str(i == 2).lower()} AS latest, c.column_name, c.position, c.dtype, "
                     f"method, n_bins, psi, CASE WHEN psi IS NOT NULL THEN {_band('psi')} END AS band "
                     f"FROM (VALUES {listed}) c(column_name, position, dtype) LEFT JOIN ({psi}) p USING (column_name)")
    return sqlkit.union_all(parts)


@query("version_history", sql=_history_sql())
def q_version_history(spark, sf):
    """Three versions recorded one after the other, each compared with the stored bins of the one before."""
    path = scratch_path(spark, "versions")
    o = load(spark, sf, "orders")
    dearer = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 1.5).otherwise(F.col("o_totalprice"))
    for v, lo, hi in VERSION_YEARS:
        df = o.filter((F.year("o_orderdate") >= lo) & (F.year("o_orderdate") < hi))
        if v == "v1":
            df = df.withColumn("o_totalprice", dearer)
        if v == "v2":
            df = corrupt.changed_column_order(corrupt.dtype_change(df, "o_totalprice"))
        versions.record(df, path, v)
    return versions.history(spark, path).withColumn("psi", r6(F.col("psi")))
