"""Queries: review sessions (one per nation over its customers): grouped flags, approval
checks (R27), pending gates (R26), confidence (R24), routing (R25), audit filter (S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import HASH_SPACE, phash, phash_sql
from ..operators import sessions
from . import sqlkit
from .registry import query
from .tables import SCHEMAS, load

S = "session_id"
HAS_APPROVAL = int(0.7 * HASH_SPACE)
APPROVED = int(0.8 * HASH_SPACE)
CUST_COLS = [c for c, _ in SCHEMAS["customer"] if c != "c_nationkey"]


def session_inputs(spark, sf):
    cust = load(spark, sf, "customer").withColumnRenamed("c_nationkey", S)
    flags = sessions.session_flags(cust, S)
    nation = load(spark, sf, "nation")
    approvals = nation.filter(phash(["n_nationkey"], 12, nation) < F.lit(HAS_APPROVAL)).select(
        F.col("n_nationkey").alias(S), F.lit("tiny_dataset_proceed").alias("approval_name"),
        (phash(["n_nationkey"], 11, nation) < F.lit(APPROVED)).alias("approved"), F.concat(F.col("n_name"), F.lit(" ok")).alias("reason"))
    sess = nation.select(F.col("n_nationkey").alias(S))
    return flags, approvals, sess


def _flags_sql():
    aggs = ", ".join(
        f"count_if({c} IS NULL) / count(*) AS m_{c}, (count_if({c} IS NULL) = count(*) OR "
        f"(count_if({c} IS NULL) = 0 AND min({c}) = max({c}))) AS k_{c}" for c in CUST_COLS)
    g = f"SELECT c_nationkey AS session_id, count(*) AS _n, {aggs} FROM customer GROUP BY c_nationkey"
    parts = [
        "SELECT session_id, 'profile' AS stage, 'warning' AS level, 'TINY_DATASET' AS code, CAST(NULL AS VARCHAR) AS feature, false AS requires_approval FROM g WHERE _n < 100",
        "SELECT session_id, 'pre_training', 'critical', 'TINY_DATASET', CAST(NULL AS VARCHAR), true FROM g WHERE _n < 100",
    ]
    for c in CUST_COLS:
        parts.append(f"SELECT session_id, 'profile', 'warning', 'HIGH_MISSING_RATE', '{c}', false FROM g WHERE m_{c} > 0.5")
        parts.append(f"SELECT session_id, 'profile', 'info', 'CONSTANT_COLUMN', '{c}', false FROM g WHERE k_{c}")
    return f"g AS ({g}), flags AS ({sqlkit.union_all(parts)})"


APPR_SQL = (f"appr AS (SELECT n_nationkey AS session_id, 'tiny_dataset_proceed' AS approval_name, "
            f"{phash_sql(['n_nationkey'], 11)} < {APPROVED} AS approved, n_name || ' ok' AS reason FROM nation "
            f"WHERE {phash_sql(['n_nationkey'], 12)} < {HAS_APPROVAL})")
MAP_SQL = ("CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sessions.APPROVAL_FOR_CODE.items()) + " END")
CHECK_SQL = f"""req AS (SELECT DISTINCT session_id, code, {MAP_SQL} AS approval_name FROM flags WHERE requires_approval),
chk AS (SELECT req.session_id, req.code, req.approval_name,
          CASE WHEN a.approved IS NULL THEN 'missing' WHEN coalesce(length(trim(a.reason)), 0) < 10 THEN 'invalid'
               WHEN NOT a.approved THEN 'rejected' ELSE 'cleared' END AS status
        FROM req LEFT JOIN appr a USING (session_id, approval_name))"""


@query("session_flags", sql=f"WITH {_flags_sql()} SELECT * FROM flags")
def q_session_flags(spark, sf):
    return session_inputs(spark, sf)[0]


@query("approvals_checked", sql=f"WITH {_flags_sql()}, {APPR_SQL}, {CHECK_SQL} SELECT * FROM chk")
def q_approvals_checked(spark, sf):
    flags, appr, _ = session_inputs(spark, sf)
    return sessions.approvals_checked(flags, appr, S)


@query("pending_gates", sql=f"""WITH {_flags_sql()}, {APPR_SQL}, {CHECK_SQL}
SELECT session_id, code, approval_name FROM req WHERE NOT EXISTS
  (SELECT 1 FROM chk WHERE chk.session_id = req.session_id AND chk.code = req.code AND chk.status = 'cleared')""")
def q_pending_gates(spark, sf):
    flags, appr, _ = session_inputs(spark, sf)
    return sessions.pending_gates(flags, appr, S)


@query("confidence", sql=f"""WITH {_flags_sql()}
SELECT n.n_nationkey AS session_id, CASE max(CASE level WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 END)
  WHEN 3 THEN 'unsafe' WHEN 2 THEN 'uncertain' ELSE 'safe' END AS confidence
FROM nation n LEFT JOIN flags f ON f.session_id = n.n_nationkey GROUP BY n.n_nationkey""")
def q_confidence(spark, sf):
    flags, _, sess = session_inputs(spark, sf)
    return sessions.confidence(flags, sess, S)


@query("next_step", sql=f"""WITH {_flags_sql()}, {APPR_SQL}, {CHECK_SQL},
per AS (SELECT session_id, max((status = 'rejected')::INT) AS rej, max((status <> 'cleared')::INT) AS op FROM chk GROUP BY 1)
SELECT n.n_nationkey AS session_id, CASE WHEN coalesce(per.rej, 0) = 1 THEN 'halt' WHEN coalesce(per.op, 0) = 1 THEN 'human_review'
  ELSE 'preprocessing' END AS next_step FROM nation n LEFT JOIN per ON per.session_id = n.n_nationkey""")
def q_next_step(spark, sf):
    flags, appr, sess = session_inputs(spark, sf)
    return sessions.next_step(flags, appr, sess, S)
