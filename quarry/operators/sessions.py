"""Many review sessions at once (R24-R27): grouped risk flags, approval checks and the
routing verdict, each one grouped pass or one join over (session, code) keys.

A session is any grouping of a table (``session_cols``); its flags come from one
``groupBy(session)`` aggregate, so thousands of sessions cost one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import long_rows, miss
from .risk import (APPROVAL_FOR_CODE, CONSTANT_COLUMN, CRITICAL, HIGH_MISSING_RATE, INFO, MISSING_LIMIT,
                   TINY_DATASET, TINY_ROWS, WARNING)

# Fixed value: shortest accepted approval reason (after trimming).
MIN_REASON_CHARS = 10


def session_flags(df: DataFrame, session_col: str) -> DataFrame:
    """Per session: TINY_DATASET (warning and gated critical), HIGH_MISSING_RATE and
    CONSTANT_COLUMN per column — from one grouped aggregate, unpivoted to flag rows."""
    cols = [c for c in df.columns if c != session_col]
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for i, c in enumerate(cols):
        m = F.count_if(miss(df, c))
        aggs += [(m / n).alias(f"m{i}"),
                 ((m == n) | ((m == 0) & (F.min(F.col(f"`{c}`")) == F.max(F.col(f"`{c}`"))))).alias(f"k{i}")]
    g = df.groupBy(session_col).agg(*aggs)
    per_col = long_rows(g, [F.col(f"`{session_col}`")], ["feature", "rate", "const"],
                        [(c, F.col(f"m{i}"), F.col(f"k{i}")) for i, c in enumerate(cols)])
    parts = [
        g.filter(F.col("_n") < TINY_ROWS).select(session_col, F.lit("profile").alias("stage"), F.lit(WARNING).alias("level"),
                                                  F.lit(TINY_DATASET).alias("code"), F.lit(None).cast("string").alias("feature"),
                                                  F.lit(False).alias("requires_approval")),
        g.filter(F.col("_n") < TINY_ROWS).select(session_col, F.lit("pre_training").alias("stage"),
                                                  F.lit(CRITICAL).alias("level"), F.lit(TINY_DATASET).alias("code"),
                                                  F.lit(None).cast("string").alias("feature"),
                                                  F.lit(True).alias("requires_approval")),
        per_col.filter(F.col("rate") > MISSING_LIMIT).select(
            session_col, F.lit("profile").alias("stage"), F.lit(WARNING).alias("level"),
            F.lit(HIGH_MISSING_RATE).alias("code"), "feature", F.lit(False).alias("requires_approval")),
        per_col.filter("const").select(session_col, F.lit("profile").alias("stage"), F.lit(INFO).alias("level"),
                                       F.lit(CONSTANT_COLUMN).alias("code"), "feature",
                                       F.lit(False).alias("requires_approval")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required_approvals(flags: DataFrame, session_col: str) -> DataFrame:
    """(session, code, approval_name) for every gated flag code (one mapping table)."""
    mapping = F.create_map(*[x for k, v in APPROVAL_FOR_CODE.items() for x in (F.lit(k), F.lit(v))])
    return flags.filter("requires_approval").select(session_col, "code").distinct() \
        .withColumn("approval_name", mapping[F.col("code")])


def approvals_checked(flags: DataFrame, approvals: DataFrame, session_col: str) -> DataFrame:
    """Per gated (session, code): missing, invalid (reason < 10 chars), rejected, cleared."""
    req = required_approvals(flags, session_col)
    a = approvals.select(session_col, "approval_name", "approved", "reason")
    j = req.join(a, [session_col, "approval_name"], "left")
    status = (F.when(F.col("approved").isNull(), "missing")
              .when(F.coalesce(F.length(F.trim("reason")), F.lit(0)) < MIN_REASON_CHARS, "invalid")
              .when(~F.col("approved"), "rejected")
              .otherwise("cleared"))
    return j.select(session_col, "code", "approval_name", status.alias("status"))


def pending_gates(flags: DataFrame, approvals: DataFrame, session_col: str) -> DataFrame:
    """Gated codes of each session without a valid approval (left anti join)."""
    cleared = approvals_checked(flags, approvals, session_col).filter(F.col("status") == "cleared")
    return required_approvals(flags, session_col).join(cleared.select(session_col, "code"), [session_col, "code"],
                                                       "left_anti")


def confidence(flags: DataFrame, sessions: DataFrame, session_col: str) -> DataFrame:
    """R24 per session; a session without flags is safe."""
    rank = F.max(F.when(F.col("level") == CRITICAL, 3).when(F.col("level") == WARNING, 2)
                 .when(F.col("level") == INFO, 1))
    g = flags.groupBy(session_col).agg(rank.alias("_r"))
    j = sessions.select(session_col).distinct().join(g, session_col, "left")
    return j.select(session_col, F.when(F.col("_r") == 3, "unsafe").when(F.col("_r") == 2, "uncertain")
                    .otherwise("safe").alias("confidence"))


def next_step(flags: DataFrame, approvals: DataFrame, sessions: DataFrame, session_col: str,
              halt_codes: Sequence[str] = ()) -> DataFrame:
    """R25 after the risk check: halt (a halting flag or a rejected approval) > human_review
    (a gated flag not cleared) > preprocessing."""
    chk = approvals_checked(flags, approvals, session_col)
    per = chk.groupBy(session_col).agg(
        F.max((F.col("status") == "rejected").cast("int")).alias("_rej"),
        F.max((F.col("status") != "cleared").cast("int")).alias("_open"))
    halts = flags.filter(F.col("code").isin(list(halt_codes)) & (F.col("level") == CRITICAL)) \
        .groupBy(session_col).agg(F.lit(1).alias("_halt")) if halt_codes else None
    j = sessions.select(session_col).distinct().join(per, session_col, "left")
    if halts is not None:
        j = j.join(halts, session_col, "left")
    else:
        j = j.withColumn("_halt", F.lit(None).cast("int"))
    step = (F.when((F.coalesce("_halt", F.lit(0)) == 1) | (F.coalesce("_rej", F.lit(0)) == 1), "halt")
            .when(F.coalesce("_open", F.lit(0)) == 1, "human_review").otherwise("preprocessing"))
    return j.select(session_col, step.alias("next_step"))


def route_after_eval(gate: DataFrame, flags: DataFrame, session_col: str, retries_col: str,
                     max_retries: int = 3) -> DataFrame:
    """R25 after evaluation: halt > SUSPICIOUS_AUC review > failed gate retries (up to 3,
    then review) > explainability.  ``gate`` has (session, pass_gate, halt, retries)."""
    # gate rows and SUSPICIOUS_AUC markers side by side, the marker spread over its session
    # by a window (no join: a constant session key would fold into a nested-loop join)
    marks = flags.filter(F.col("code") == "SUSPICIOUS_AUC").select(
        session_col, F.lit(None).cast(gate.schema[retries_col].dataType).alias(retries_col),
        F.lit(None).cast("boolean").alias("pass_gate"), F.lit(None).cast("boolean").alias("halt"),
        F.lit(1).alias("_m"))
    u = gate.select(session_col, retries_col, "pass_gate", "halt", F.lit(0).alias("_m")).unionByName(marks)
    w = Window.partitionBy(session_col)
    j = u.withColumn("_auc", F.max("_m").over(w)).filter(F.col("_m") == 0)
    step = (F.when(F.col("halt"), "halt").when(F.col("_auc") == 1, "human_review")
            .when(~F.col("pass_gate") & (F.col(retries_col) < max_retries), "model_strategy")
            .when(~F.col("pass_gate"), "human_review").otherwise("explainability"))
    return j.select(session_col, retries_col, step.alias("next_step"))


def audit_filter(df: DataFrame, **equals) -> DataFrame:
    """Conjunctive equality filter (pushed to the Parquet scan as equality filters)."""
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)
