"""Queries over the profile operators (P1-P8) with corrupted inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrupt, profile
from . import sqlkit
from .registry import query
from .tables import SCHEMAS, load

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
# draws hash this cheap prefix of the key and order ties by the whole key
LI_HASH = ["l_orderkey", "l_linenumber"]


def orders_burst(spark, sf):
    return corrupt.null_burst(load(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], 0.4)


def _profile_sql() -> str:
    src = sqlkit.null_burst("SELECT * FROM orders", "o_totalprice", ["o_orderkey"], 0.4)
    parts = []
    for i, (c, t) in enumerate(SCHEMAS["orders"]):
        from .tables import kind
        m = sqlkit.missing_sql(c, t)
        v = sqlkit.clean_sql(c, t)
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, '{kind(t)}' AS kind, count(*) AS n_rows, "
            f"round(coalesce(avg(CASE WHEN {m} THEN 1.0 ELSE 0.0 END), 0.0), 6) AS missing_rate, "
            f"coalesce((count_if({m}) = count(*)) OR (count_if({m}) = 0 AND min({v}) = max({v})), true) AS is_constant "
            f"FROM t")
    return f"WITH t AS ({src})\n" + sqlkit.union_all(parts)


@query("profile_columns", sql=_profile_sql())
def q_profile_columns(spark, sf):
    return profile.profile_columns(orders_burst(spark, sf))


def lineitem_dups(spark, sf):
    return corrupt.duplicate_rows(load(spark, sf, "lineitem"), LI_KEY, 0.25, hash_cols=LI_HASH)


@query("duplicate_ratio", sql=f"""
WITH t AS ({sqlkit.duplicate_rows("SELECT * FROM lineitem", LI_KEY, 0.25, hash_cols=LI_HASH)}),
g AS (SELECT count(*) AS c FROM t GROUP BY ALL_COLUMNS)
SELECT sum(c)::BIGINT AS n_rows, count(*)::BIGINT AS n_unique, (sum(c) - count(*))::BIGINT AS n_duplicates,
       round(coalesce((sum(c) - count(*)) / sum(c), 0.0), 6) AS duplicate_ratio FROM g
""".replace("GROUP BY ALL_COLUMNS", "GROUP BY " + ", ".join(c for c, _ in SCHEMAS["lineitem"])))
def q_duplicate_ratio(spark, sf):
    return profile.duplicate_ratio(lineitem_dups(spark, sf))


def _kinds_sql(table: str, src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        num = f"regexp_full_match({c}, '{profile.NUMBER_PATTERN}')"
        date = f"(NOT {num} AND regexp_full_match({c}, '{profile.DATE_PATTERN}'))"
        boo = f"lower(trim({c})) IN ('true', 'false')"
        text = f"({c} IS NOT NULL AND NOT {num} AND NOT {boo} AND NOT {date})"
        share = "round(coalesce(count_if({e}) / count({c}), 0.0), 6)"
        kinds = " + ".join(f"(count_if({e}) > 0)::INT" for e in (num, date, boo, text))
        parts.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({c})::BIGINT AS n_values, "
            f"{share.format(e=num, c=c)} AS share_number, {share.format(e=date, c=c)} AS share_datetime, "
            f"{share.format(e=boo, c=c)} AS share_boolean, {share.format(e=text, c=c)} AS share_text, "
            f"({kinds}) > 1 AS is_mixed FROM ({src})")
    return sqlkit.union_all(parts)


@query("mixed_types", sql=sqlkit.union_all([
    _kinds_sql("events", "SELECT * FROM events", ["event_type", "props"]),
    _kinds_sql("part", "SELECT * REPLACE (CAST(p_size AS VARCHAR) AS p_size) FROM part",
               ["p_name", "p_brand", "p_type", "p_size"]),
]))
def q_mixed_types(spark, sf):
    ev = profile.text_kinds(load(spark, sf, "events")).withColumn("table_name", F.lit("events"))
    pt = profile.text_kinds(corrupt.dtype_change(load(spark, sf, "part"), "p_size")) \
        .withColumn("table_name", F.lit("part"))
    return ev.unionByName(pt)


LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem_outliers(spark, sf):
    return corrupt.extreme_outliers(load(spark, sf, "lineitem"), "l_extendedprice", LI_KEY)


def _tukey_sql(table: str, src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{table}' AS table_name, '{c}' AS column_name,
  round(CASE WHEN s.nd >= 4 THEN s.q1 END, 6) AS q1, round(CASE WHEN s.nd >= 4 THEN s.q3 END, 6) AS q3,
  round(CASE WHEN s.nd >= 4 AND s.q3 - s.q1 <> 0 THEN
    (SELECT avg(CASE WHEN {c} < s.q1 - 1.5 * (s.q3 - s.q1) OR {c} > s.q3 + 1.5 * (s.q3 - s.q1) THEN 1.0 ELSE 0.0 END)
     FROM ({src}) WHERE {c} IS NOT NULL) ELSE 0.0 END, 6) AS outlier_share
FROM (SELECT count(DISTINCT {c}) AS nd, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({src})) s""")
    return sqlkit.union_all(parts)


_LI_KEYS = ", ".join(LI_KEY)
_LI_OUT_SQL = ("SELECT l.* REPLACE (CASE WHEN z._lead = 1 THEN (SELECT (max(l_extendedprice) + 1) * 1000 FROM lineitem) "
               "ELSE l.l_extendedprice END AS l_extendedprice) FROM lineitem l LEFT JOIN "
               f"(SELECT {_LI_KEYS}, 1 AS _lead FROM lineitem ORDER BY {_LI_KEYS} LIMIT 5) z "
               f"USING ({_LI_KEYS})")


@query("tukey_outliers", sql=sqlkit.union_all([
    _tukey_sql("events", "SELECT * FROM events", ["value"]),
    _tukey_sql("lineitem", _LI_OUT_SQL, LI_NUMERIC),
]))
def q_tukey_outliers(spark, sf):
    ev = profile.tukey_outliers(load(spark, sf, "events"), ["value"]).withColumn("table_name", F.lit("events"))
    li = profile.tukey_outliers(lineitem_outliers(spark, sf), LI_NUMERIC).withColumn("table_name", F.lit("lineitem"))
    return ev.unionByName(li)
