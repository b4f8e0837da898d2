"""Queries: framing (F1-F6, X1), leakage (F5, C3) and pre-training risk flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators import corrupt, framing, risk
from . import sqlkit
from .registry import query
from .tables import SCHEMAS, kind, load

FRAME_TABLES = ["orders", "part", "customer", "events"]


def _sql_infer(schema):
    names = [c for c, _ in schema]
    target = framing.infer_target(names)
    group = framing.detect_group_column(names)
    time = next((c for c, t in schema if framing.TIME_NAME.search(c) or kind(t) == "datetime"), None)
    return target, group, time


def _quote(v):
    return "NULL" if v is None else f"'{v}'"


def frame_sql(table: str, schema=None, src: str | None = None) -> str:
    schema = schema or SCHEMAS[table]
    src = src or f"SELECT * FROM {table}"
    target, group, time = _sql_infer(schema)
    ttype = dict(schema)[target]
    if kind(ttype) == "datetime":
        ptype = "'timeseries'"
    elif kind(ttype) == "numeric":
        ptype = (f"CASE WHEN count(DISTINCT {target}) <= greatest({framing.CLASS_LIMIT_MIN}, "
                 f"floor(count(*) * {framing.CLASS_LIMIT_SHARE})) THEN 'classification' ELSE 'regression' END")
    else:
        ptype = "'classification'"
    if group:
        cv = "'GroupKFold'"
    elif time:
        cv = "'TimeSeriesSplit'"
    else:
        cv = f"CASE WHEN ({ptype}) = 'regression' THEN 'KFold' ELSE 'StratifiedKFold' END"
    idc = [c for c, t in sorted(schema) if c != target and t not in ("double", "float")]
    ids = ", ".join(f"CASE WHEN count(DISTINCT {c}) > {framing.ID_LIKE_SHARE} * count(*) THEN '{c}' END" for c in idc)
    return (f"SELECT '{table}' AS table_name, {_quote(target)} AS target, {ptype} AS problem_type, "
            f"{_quote(group)} AS group_col, {_quote(time)} AS time_col, {cv} AS cv_strategy, "
            f"concat_ws(', ', {ids}) AS id_like, count(*)::BIGINT AS n_rows FROM ({src})")


@query("frame", sql=sqlkit.union_all([frame_sql(t) for t in FRAME_TABLES]))
def q_frame(spark, sf):
    return reduce(DataFrame.unionByName, [framing.framing_frame(load(spark, sf, t), t) for t in FRAME_TABLES])


def leak_sql(src: str, schema, target: str) -> str:
    types = dict(schema)
    t_num = kind(types[target]) == "numeric"
    parts = []
    for c, ty in schema:
        if c == target:
            continue
        blank = "true" if framing.BLANK_NAME.match(c) else "false"
        name = "true" if framing.LEAKY_NAME.search(c) else "false"
        eq = (f"avg(CASE WHEN coalesce(CAST({c} AS VARCHAR), '__missing__') = "
              f"coalesce(CAST({target} AS VARCHAR), '__missing__') THEN 1.0 ELSE 0.0 END)")
        if t_num and kind(ty) == "numeric":
            x = f"(CASE WHEN {target} IS NOT NULL THEN CAST({c} AS DOUBLE) END)"
            y = f"(CASE WHEN {c} IS NOT NULL THEN CAST({target} AS DOUBLE) END)"
            den = f"(stddev_pop({x}) * stddev_pop({y}))"
            corr = f"(CASE WHEN {den} = 0 THEN NULL ELSE covar_pop({x}, {y}) / {den} END)"
            pairs = f"count_if({c} IS NOT NULL AND {target} IS NOT NULL)"
        else:
            corr, pairs = "CAST(NULL AS DOUBLE)", "0"
        parts.append(
            f"SELECT '{c}' AS column_name, {blank} AS blank_name, {name} AS name_rule, round({corr}, 6) AS corr, "
            f"({pairs})::BIGINT AS n_pairs, round({eq}, 6) AS equal_share, "
            f"({blank} OR {name} OR (({pairs}) >= 3 AND coalesce(abs({corr}) > 0.95, false)) "
            f"OR coalesce({eq} > 0.99, false)) AS suspect FROM ({src})")
    return sqlkit.union_all(parts)


PART_LEAK_SCHEMA = SCHEMAS["part"] + [("p_retailprice_outcome", "double"), ("leakage_val", "double")]
PART_LEAK_SRC = "SELECT *, p_retailprice AS p_retailprice_outcome, p_retailprice * 2.0 AS leakage_val FROM part"


@query("leakage_scores", sql=leak_sql(PART_LEAK_SRC, PART_LEAK_SCHEMA, "p_retailprice"))
def q_leakage_scores(spark, sf):
    part = corrupt.target_leakage_inject(load(spark, sf, "part"), "p_retailprice")
    return framing.leakage_scores(part, "p_retailprice")


# --- R1-R11 --------------------------------------------------------------------------

def profile_sql(src: str, schema) -> str:
    parts = []
    for i, (c, t) in enumerate(schema):
        m = sqlkit.missing_sql(c, t)
        v = sqlkit.clean_sql(c, t)
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, '{kind(t)}' AS kind, count(*)::BIGINT AS n_rows, "
            f"round(coalesce(avg(CASE WHEN {m} THEN 1.0 ELSE 0.0 END), 0.0), 6) AS missing_rate, "
            f"coalesce((count_if({m}) = count(*)) OR (count_if({m}) = 0 AND min({v}) = max({v})), true) AS is_constant "
            f"FROM ({src})")
    return sqlkit.union_all(parts)


def dup_sql(src: str, schema) -> str:
    cols = ", ".join(c for c, _ in schema)
    return (f"SELECT sum(c)::BIGINT AS n_rows, count(*)::BIGINT AS n_unique, (sum(c) - count(*))::BIGINT AS n_duplicates, "
            f"round(coalesce((sum(c) - count(*)) / sum(c), 0.0), 6) AS duplicate_ratio "
            f"FROM (SELECT count(*) AS c FROM ({src}) GROUP BY {cols})")


def risk_pre_sql(table_name: str, src: str, schema, target: str) -> str:
    p, d, lk = profile_sql(src, schema), dup_sql(src, schema), leak_sql(src, schema, target)
    tn = f"'{table_name}' AS table_name"

    def sel(stage, level, code, feature, desc, appr, frm):
        return (f"SELECT {tn}, '{stage}' AS stage, '{level}' AS level, '{code}' AS code, CAST({feature} AS VARCHAR) AS feature, "
                f"CAST({desc} AS VARCHAR) AS description, {appr} AS requires_approval FROM {frm}")
    nrow = "(SELECT * FROM prof WHERE position = 0)"
    leak = "(SELECT list_sort(list(column_name)) AS names FROM leak WHERE suspect HAVING count(*) > 0)"
    tgt = (f"(SELECT 1 FROM ({src}) HAVING count({target}) = 0 OR min({target}) = max({target}))")
    allm = (f"(SELECT 1 FROM prof WHERE column_name <> '{target}' HAVING count(*) > 0 AND bool_and(missing_rate > 0.5))")
    parts = [
        sel("profile", "critical", "MISSING_COLUMN_NAMES", "NULL", "'a column header is blank'", "true",
            "(SELECT * FROM prof WHERE trim(column_name) = '')"),
        sel("profile", "warning", "HIGH_DUPLICATE_RATIO", "NULL",
            "printf('duplicate share %.4f above %.2f', duplicate_ratio, 0.2)", "false",
            "(SELECT * FROM dup WHERE duplicate_ratio > 0.2)"),
        sel("profile", "warning", "TINY_DATASET", "NULL", "printf('%d rows, fewer than %d', n_rows, 100)", "false",
            f"(SELECT * FROM {nrow} WHERE n_rows < 100)"),
        sel("profile", "warning", "HIGH_MISSING_RATE", "column_name", "printf('missing share %.4f', missing_rate)",
            "false", "(SELECT * FROM prof WHERE missing_rate > 0.5)"),
        sel("profile", "info", "CONSTANT_COLUMN", "column_name", "'no variation'", "false",
            "(SELECT * FROM prof WHERE is_constant)"),
        sel("profile", "warning", "CLASS_IMBALANCE", f"'{target}'", "'class balance of a tiny table needs a review'",
            "false", f"(SELECT * FROM {nrow} WHERE n_rows < 100)"),
        sel("pre_training", "critical", "TINY_DATASET", "NULL", "printf('%d rows: too few to train on', n_rows)", "true",
            f"(SELECT * FROM {nrow} WHERE n_rows < 100)"),
        sel("framing", "critical", "LEAKAGE_SUSPECTED", "names[1]",
            "'possible target leakage: ' || array_to_string(names, ', ')", "true", leak),
        sel("pre_training", "critical", "LEAKAGE_SUSPECTED", "array_to_string(names, ', ')",
            "'possible target leakage: ' || array_to_string(names, ', ')", "true", leak),
        sel("pre_training", "critical", "CONSTANT_COLUMN", f"'{target}'",
            "'target has at most one value: nothing to learn, halt'", "false", tgt),
        sel("pre_training", "critical", "HIGH_MISSING_RATE", "NULL",
            "'every feature is more than half missing, halt'", "false", allm),
    ]
    return f"WITH prof AS ({p}), dup AS ({d}), leak AS ({lk})\n" + sqlkit.union_all(parts)


CUSTOMER_SRC = sqlkit.duplicate_rows(
    sqlkit.null_burst("SELECT * FROM customer", "c_acctbal", ["c_custkey"], 0.6), ["c_custkey"], 0.30)


def customer_corrupted(spark, sf):
    from ..functions.materialize import pin
    cust = corrupt.null_burst(load(spark, sf, "customer"), "c_acctbal", ["c_custkey"], 0.6)
    # read by the profile, duplicate, leakage and target passes: draw once, pin
    return pin(corrupt.duplicate_rows(cust, ["c_custkey"], 0.30))


@query("risk_flags_pre", sql=sqlkit.union_all([
    f"SELECT * FROM ({risk_pre_sql('customer', CUSTOMER_SRC, SCHEMAS['customer'], 'c_mktsegment')})",
    f"SELECT * FROM ({risk_pre_sql('region', 'SELECT * FROM region', SCHEMAS['region'], 'r_name')})",
]))
def q_risk_flags_pre(spark, sf):
    from pyspark.sql import functions as F
    cust = risk.risk_flags_pre(customer_corrupted(spark, sf), "c_mktsegment").withColumn("table_name", F.lit("customer"))
    reg = risk.risk_flags_pre(load(spark, sf, "region"), "r_name").withColumn("table_name", F.lit("region"))
    return cust.unionByName(reg)


def _drop_sql() -> str:
    ids = []
    for c, t in PART_LEAK_SCHEMA:
        if c == "p_retailprice":
            continue
        idx = "(count(*) < 0)" if t in ("double", "float") else f"count(DISTINCT {c}) > 0.95 * count(*)"
        ids.append(f"SELECT '{c}' AS column_name, {idx} AS id_like FROM ({PART_LEAK_SRC})")
    return f"""WITH lk AS ({leak_sql(PART_LEAK_SRC, PART_LEAK_SCHEMA, 'p_retailprice')}), ids AS ({sqlkit.union_all(ids)})
SELECT column_name, id_like, suspect AS leakage,
       CASE WHEN id_like OR suspect THEN 'dropped' ELSE 'feature' END AS role FROM ids JOIN lk USING (column_name)
UNION ALL SELECT 'p_retailprice', false, false, 'target'"""


@query("drop_set", sql=_drop_sql())
def q_drop_set(spark, sf):
    """X1 + X2: ID-like and leakage columns dropped, the rest are features."""
    from pyspark.sql import functions as F
    from ..operators import prep
    part = corrupt.target_leakage_inject(load(spark, sf, "part"), "p_retailprice")
    leak = framing.leakage_suspects(part, "p_retailprice")
    fr = framing.frame(part, target="p_retailprice")
    drop, feats = prep.id_like_and_drop(part, "p_retailprice", leak)
    rows = [(c, c in fr.id_like, c in leak, "dropped" if c in drop else "feature") for c in part.columns
            if c != "p_retailprice"] + [("p_retailprice", False, False, "target")]
    body = ", ".join(f"'{c}', {str(i).lower()}, {str(lk).lower()}, '{r}'" for c, i, lk, r in rows)
    return part.agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        f"stack({len(rows)}, {body}) AS (column_name, id_like, leakage, role)")
