"""Queries: file round trips (S1-S3), report sink and reload (S5, S6), audit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrupt, evaluate, explain, sessions
from ..sources import audit, files, report
from . import sqlkit
from .eval_plans import LI_MULTI_SQL, _confusion_sql, li_multi
from .explain_plans import CORR_COLS, _pairs_sql
from .registry import query
from .session_plans import APPR_SQL, CHECK_SQL, S, _flags_sql, session_inputs
from .tables import SCHEMAS, load


def _typed(df, table):
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in SCHEMAS[table]])


@query("csv_roundtrip", sql=sqlkit.null_burst("SELECT * FROM orders", "o_totalprice", ["o_orderkey"], 0.4))
def q_csv_roundtrip(spark, sf):
    src = corrupt.null_burst(load(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], 0.4)
    path = files.write_dataset(src, files.scratch_path(spark, "orders") + ".csv", "csv")
    return _typed(files.load_dataset(spark, path), "orders")


@query("csv_quoted_roundtrip", sql="""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value,
       CASE WHEN props NOT IN ('', 'NA', 'NULL', 'null', 'nan', 'NaN', 'None', 'N/A', 'n/a') THEN props END AS props FROM events""")
def q_csv_quoted_roundtrip(spark, sf):
    """Cells with commas and quotes (JSON in props); the types are those the loader infers."""
    path = files.write_dataset(load(spark, sf, "events"), files.scratch_path(spark, "events") + ".csv", "csv")
    return files.load_dataset(spark, path)


@query("tsv_roundtrip", sql="SELECT * FROM part")
def q_tsv_roundtrip(spark, sf):
    path = files.write_dataset(load(spark, sf, "part"), files.scratch_path(spark, "part") + ".tsv", "tsv")
    return _typed(files.load_dataset(spark, path), "part")


def _report(spark, sf):
    from .quality import orders_burst
    from ..operators import profile, baselines
    return report.build_report({
        "profile": (profile.profile_columns(orders_burst(spark, sf)), "column_name"),
        "class_balance": (baselines.class_balance(load(spark, sf, "orders"), "o_orderpriority"), "class_label"),
        "confusion_matrix": (evaluate.confusion_long(li_multi(spark, sf), "l_returnflag", "pred_flag"), "actual"),
        "correlated_pairs": (explain.correlated_pairs(load(spark, sf, "lineitem"), CORR_COLS), "pair_index"),
    })


@query("report_sections")
def q_report_sections(spark, sf):
    """S5 (rows-only check: the JSON text of doubles differs between engines)."""
    path = report.write_report(_report(spark, sf), files.scratch_path(spark, "report"))
    return spark.read.schema("section string, key string, value_json string").json(path)


@query("report_reload", sql=f"""WITH cm AS ({_confusion_sql(LI_MULTI_SQL, 'l_returnflag', 'pred_flag')}),
pr AS ({_pairs_sql()})
SELECT 'confusion_matrix' AS section, actual AS label_a, predicted AS label_b, CAST(n AS DOUBLE) AS value FROM cm
UNION ALL
SELECT 'correlated_pairs', feature_a, feature_b, corr FROM (SELECT * FROM pr ORDER BY abs(corr) DESC, pair_index LIMIT 10)""")
def q_report_reload(spark, sf):
    """Tables rebuilt from the saved report file alone."""
    path = report.write_report(_report(spark, sf), files.scratch_path(spark, "report"))
    cm = report.read_section(spark, path, "confusion_matrix", "actual string, predicted string, n bigint")
    pr = report.read_section(spark, path, "correlated_pairs",
                             "pair_index int, feature_a string, feature_b string, corr double")
    top = pr.orderBy(F.desc(F.abs("corr")), "pair_index").limit(10)  # a top-10 report: the limit is the feature
    return cm.select(F.lit("confusion_matrix").alias("section"), F.col("actual").alias("label_a"),
                     F.col("predicted").alias("label_b"), F.col("n").cast("double").alias("value")).unionByName(
        top.select(F.lit("correlated_pairs").alias("section"), F.col("feature_a").alias("label_a"),
                   F.col("feature_b").alias("label_b"), F.col("corr").alias("value")))


RUN_DATE = "2026-01-01"


def write_audit(spark, sf):
    flags, appr, sess = session_inputs(spark, sf)
    steps = sessions.next_step(flags, appr, sess, S)
    nation = load(spark, sf, "nation")
    rd = F.to_date(F.lit(RUN_DATE))
    root = files.scratch_path(spark, "audit")
    cust = load(spark, sf, "customer")
    tables = {
        "sessions": nation.select(F.col("n_nationkey").alias(S), F.col("n_name").alias("name"), rd.alias("run_date")),
        "agent_decisions": steps.select(S, F.lit("risk_failure").alias("agent"), F.lit("next_step").alias("decision_key"),
                                        F.to_json(F.struct("next_step")).alias("decision_value"), rd.alias("run_date")),
        "model_runs": cust.groupBy(F.col("c_nationkey").alias(S)).agg(F.count(F.lit(1)).alias("n_rows"))
        .select(S, F.lit("dummy_most_frequent").alias("model"), "n_rows", rd.alias("run_date")),
        "risk_flags": flags.withColumn("run_date", rd),
        "human_approvals": appr.withColumn("run_date", rd),
    }
    for name, df in tables.items():
        audit.append(df, root, name)
    return root, steps, {name: df.schema for name, df in tables.items()}


@query("audit_filter", sql=f"WITH {_flags_sql()} SELECT * FROM flags WHERE level = 'critical' AND code = 'TINY_DATASET'")
def q_audit_filter(spark, sf):
    root, _, schemas = write_audit(spark, sf)
    return audit.filter_by(spark, root, "risk_flags", schemas["risk_flags"], level="critical",
                           code="TINY_DATASET").drop("run_date")


_AUDIT_ROWS = {
    "sessions": "SELECT n_nationkey AS session_id FROM nation",
    "agent_decisions": "SELECT n_nationkey AS session_id FROM nation",
    "model_runs": "SELECT DISTINCT c_nationkey AS session_id FROM customer",
    "risk_flags": "SELECT session_id FROM flags",
    "human_approvals": "SELECT session_id FROM appr",
}


@query("audit_cascade_delete", sql=f"""WITH {_flags_sql()}, {APPR_SQL}, {CHECK_SQL},
per AS (SELECT session_id, max((status = 'rejected')::INT) AS rej FROM chk GROUP BY 1),
doomed AS (SELECT session_id FROM per WHERE rej = 1)
""" + sqlkit.union_all([
    f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n_before, "
    f"coalesce(count_if(session_id NOT IN (SELECT session_id FROM doomed)), 0)::BIGINT AS n_after FROM ({q})"
    for t, q in _AUDIT_ROWS.items()]))
def q_audit_cascade_delete(spark, sf):
    root, steps, schemas = write_audit(spark, sf)
    new_root = files.scratch_path(spark, "audit-kept")
    kept = audit.cascade_delete(spark, root, new_root, steps.filter(F.col("next_step") == "halt"), schemas)
    parts = []
    for t in audit.AUDIT_TABLES:
        before = audit.read(spark, root, t, schemas[t]).agg(F.count(F.lit(1)).alias("n_before"))
        after = audit.read(spark, new_root, t, schemas[t]).agg(F.count(F.lit(1)).alias("n_after"))
        parts.append(before.withColumn("table_name", F.lit(t)).unionByName(
            after.withColumn("table_name", F.lit(t)), allowMissingColumns=True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_name").agg(F.max("n_before").cast("bigint").alias("n_before"),
                                         F.max("n_after").cast("bigint").alias("n_after"))


PAGE_SIZE = 10
CURSOR = 7


@query("trace_page", sql=f"""WITH {_flags_sql()}, {APPR_SQL}, {CHECK_SQL},
per AS (SELECT session_id, max((status = 'rejected')::INT) AS rej, max((status <> 'cleared')::INT) AS op FROM chk GROUP BY 1),
steps AS (SELECT n.n_nationkey AS session_id, CASE WHEN coalesce(per.rej, 0) = 1 THEN 'halt'
            WHEN coalesce(per.op, 0) = 1 THEN 'human_review' ELSE 'preprocessing' END AS next_step
          FROM nation n LEFT JOIN per ON per.session_id = n.n_nationkey)
SELECT session_id, 'risk_failure' AS agent, 'next_step' AS decision_key, next_step AS decision_value
FROM steps WHERE session_id > {CURSOR} ORDER BY session_id LIMIT {PAGE_SIZE}""")
def q_trace_page(spark, sf):
    """One page of the decision trace after a cursor, read back from the audit table
    (the page size is the feature: ``filter(> cursor).orderBy.limit``)."""
    root, _, schemas = write_audit(spark, sf)
    t = audit.read(spark, root, "agent_decisions", schemas["agent_decisions"])
    page = t.filter(F.col(S) > F.lit(CURSOR)).orderBy(S, "decision_key").limit(PAGE_SIZE)
    return page.select(S, "agent", "decision_key",
                       F.get_json_object("decision_value", "$.next_step").alias("decision_value"))
