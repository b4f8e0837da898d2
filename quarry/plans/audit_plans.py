"""Queries: the audit store (S7-S9) and review sessions in which every status and verdict occurs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sessions
from ..sources.audit_store import TABLES, AuditStore
from ..sources.files import scratch_path
from . import sqlkit
from .registry import query
from .tables import load

S = "session_id"


def _id(*parts):
    return F.md5(F.concat_ws(":", *[p if not isinstance(p, str) else F.lit(p) for p in parts]))


def audit_rows(spark, sf) -> dict[str, DataFrame]:
    """A session for each nation, dated by its region; its customers are its model runs, segments its decisions."""
    n = load(spark, sf, "nation").select(
        _id("s", F.col("n_nationkey").cast("string")).alias("sid"), "n_nationkey", "n_name",
        F.date_add(F.lit("2026-01-01").cast("date"), F.col("n_regionkey")).alias("run_date"))
    c = load(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    at = F.col("run_date").cast("timestamp_ntz")
    key = F.col("c_custkey").cast("string")
    return {
        "sessions": n.select(F.col("sid").alias("id"), F.lit("owner").alias("user_id"), F.concat(F.col("n_name"), F.lit(".parquet")).alias("dataset_path"),
                             F.lit("balance by segment").alias("problem_statement"), at.alias("created_at"), "run_date"),
        "agent_decisions": c.groupBy("sid", "run_date", "c_mktsegment").agg(F.count(F.lit(1)).alias("k")).select(
            _id("d", F.col("sid"), F.col("c_mktsegment")).alias("id"), F.col("sid").alias(S), F.lit("profiling").alias("agent_name"),
            F.col("c_mktsegment").alias("decision_key"), F.col("k").cast("string").alias("decision_value"), F.lit("rows of the segment").alias("rationale"),
            at.alias("timestamp"), "run_date"),
        "model_runs": c.select(_id("m", key).alias("id"), F.col("sid").alias(S), key.alias("mlflow_run_id"), F.lit("ridge").alias("model_type"),
                               F.lit("{}").alias("hyperparameters"), F.lit("[]").alias("cv_scores"), F.lit("{}").alias("eval_metrics"),
                               (F.col("c_acctbal") > 0).alias("is_selected"), "run_date"),
        "risk_flags": c.filter("c_acctbal < 0").select(
            _id("f", key).alias("id"), F.col("sid").alias(S), F.lit("warning").alias("level"), F.lit("NEGATIVE_BALANCE").alias("code"),
            F.lit("balance below zero").alias("description"), F.lit("c_acctbal").alias("feature"), F.lit(False).alias("resolved"),
            F.lit(None).cast("string").alias("resolution"), "run_date"),
        "human_approvals": n.select(_id("a", F.col("sid")).alias("id"), F.col("sid").alias(S), F.lit("approve_risk").alias("gate_name"),
                                    (F.col("n_nationkey") % 4 != 0).alias("approved"), F.lit("looked at all flags").alias("reason"),
                                    F.lit("owner").alias("approved_by"), at.alias("approved_at"), "run_date"),
    }


_N = """n AS (SELECT *, md5('s:' || n_nationkey) AS sid, DATE '2026-01-01' + n_regionkey::INT AS run_date,
                n_nationkey % 4 = 0 AND n_regionkey <= 2 AS doomed FROM nation),
c AS (SELECT * FROM customer JOIN n ON c_nationkey = n_nationkey)"""
_ROWS = {"sessions": "n", "agent_decisions": "(SELECT DISTINCT sid, run_date, c_mktsegment, doomed FROM c)", "model_runs": "c",
         "risk_flags": "(SELECT * FROM c WHERE c_acctbal < 0)", "human_approvals": "n"}


@query("audit_store_cascade", sql=f"WITH {_N}\n" + sqlkit.union_all([
    f"SELECT '{t}' AS table_name, run_date::VARCHAR AS run_date, count(*) AS n_before, count(*) FILTER (NOT doomed) AS n_after, "
    f"bool_or(doomed) AS rewritten FROM {src} GROUP BY 1, 2" for t, src in _ROWS.items()]))
def q_audit_store_cascade(spark, sf):
    """Sessions whose approval was refused (in the first three regions) go, with all their rows; other run
    dates keep their folders."""
    store = AuditStore(spark, scratch_path(spark, "audit-store"))
    rows = audit_rows(spark, sf)
    first = store.append(rows)
    refused = store.filter_by("human_approvals", approved=False).filter(F.col("run_date") <= F.lit("2026-01-03").cast("date"))
    last = store.delete(refused.select(F.col(S).alias("id")))
    parts = []
    for t in TABLES:
        old, new = store.manifest(first)[t], store.manifest(last)[t]
        moved = [d for d in old if old[d] != new.get(d)]
        n = [store.read(t, v).groupBy("run_date").agg(F.count(F.lit(1)).alias(name)) for v, name in ((first, "n_before"), (last, "n_after"))]
        parts.append(n[0].join(n[1], "run_date", "left").select(
            F.lit(t).alias("table_name"), F.col("run_date").cast("string").alias("run_date"), "n_before",
            F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after"), F.col("run_date").cast("string").isin(moved).alias("rewritten")))
    return reduce(DataFrame.unionByName, parts)


@query("audit_lookup", sql=f"""WITH {_N}
SELECT md5('m:' || c_custkey) AS id, sid AS session_id, c_custkey::VARCHAR AS mlflow_run_id, c_acctbal > 0 AS is_selected, run_date::VARCHAR AS run_date
FROM c WHERE c_custkey = 7 UNION ALL
SELECT md5('m:' || c_custkey), sid, c_custkey::VARCHAR, c_acctbal > 0, run_date::VARCHAR FROM c WHERE n_nationkey = 3 AND c_acctbal > 0""")
def q_audit_lookup(spark, sf):
    """A run by its id, and the selected runs of one session."""
    store = AuditStore(spark, scratch_path(spark, "audit-store"))
    store.append({"model_runs": audit_rows(spark, sf)["model_runs"]})
    ids = spark.range(1).select(_id("m", "7").alias("m"), _id("s", "3").alias("s")).first()
    found = store.get_by_id("model_runs", ids["m"]).unionByName(store.filter_by("model_runs", session_id=ids["s"], is_selected=True))
    return found.select("id", S, "mlflow_run_id", "is_selected", F.col("run_date").cast("string").alias("run_date"))


# eight sessions by customer: one with missing prices, one with a constant status, four tiny ones, two plain ones
_SESSIONS = """o AS (SELECT o_custkey % 8 AS session_id, o_orderkey,
  CASE WHEN o_custkey % 8 = 0 AND o_orderkey % 4 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_custkey % 8 = 1 THEN 'F' ELSE o_orderstatus END AS o_orderstatus
  FROM orders WHERE o_custkey % 8 NOT IN (2, 3, 4, 5) OR o_orderkey <= 400)"""


def review_inputs(spark, sf):
    o = load(spark, sf, "orders").withColumn(S, F.col("o_custkey") % 8)
    o = o.filter(~F.col(S).isin(2, 3, 4, 5) | (F.col("o_orderkey") <= 400)).select(
        S, "o_orderkey", F.when((F.col(S) == 0) & (F.col("o_orderkey") % 4 != 0), None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col(S) == 1, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    sess = o.select(S).distinct()
    given = sess.filter(F.col(S).isin(2, 3, 4)).select(
        S, F.lit("tiny_dataset_proceed").alias("approval_name"), (F.col(S) != 3).alias("approved"),
        F.when(F.col(S) == 4, "  ok  ").otherwise("looked at by the owner").alias("reason"))
    return sessions.session_flags(o, S), given, sess


def _verdict_sql():
    cols = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    aggs = ", ".join(f"count_if({c} IS NULL) / count(*) > 0.5 AS m_{c}, (count_if({c} IS NULL) = count(*) OR "
                     f"(count_if({c} IS NULL) = 0 AND min({c}) = max({c}))) AS k_{c}" for c in cols)
    return f"""WITH {_SESSIONS}, g AS (SELECT session_id, count(*) < 100 AS tiny, {aggs} FROM o GROUP BY 1),
v AS (SELECT session_id, tiny, CASE WHEN tiny THEN 'unsafe' WHEN {' OR '.join('m_' + c for c in cols)} THEN 'uncertain' ELSE 'safe' END AS confidence,
             {' OR '.join('k_' + c for c in cols)} AS constant FROM g),
s AS (SELECT *, CASE WHEN NOT tiny THEN NULL WHEN session_id = 2 THEN 'cleared' WHEN session_id = 3 THEN 'rejected' WHEN session_id = 4 THEN 'invalid' ELSE 'missing' END AS status FROM v)
SELECT session_id, confidence, status, CASE status WHEN 'rejected' THEN 'halt' WHEN 'invalid' THEN 'human_review' WHEN 'missing' THEN 'human_review'
       ELSE 'preprocessing' END AS next_step FROM s"""


@query("session_verdicts", sql=_verdict_sql())
def q_session_verdicts(spark, sf):
    """Sessions of every confidence, approvals of every status, every step after the risk check."""
    flags, given, sess = review_inputs(spark, sf)
    status = sessions.approvals_checked(flags, given, S).select(S, "status")
    steps = sessions.next_step(flags, given, sess, S)
    return sessions.confidence(flags, sess, S).join(status, S, "left").join(steps, S).select(S, "confidence", "status", "next_step")
