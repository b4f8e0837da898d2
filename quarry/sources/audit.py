"""Audit tables (S7-S9): append-only Parquet tables partitioned by run date and sorted by
session inside each file; equality lookups prune on Parquet statistics; a cascade delete
rewrites each table without the deleted sessions (left anti join) to a new path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_TABLES = ["sessions", "agent_decisions", "model_runs", "risk_flags", "human_approvals"]


def append(df: DataFrame, root: str, table: str, run_date_col: str = "run_date") -> str:
    """Append one batch (files sorted by session, partitioned by run date)."""
    path = f"{root.rstrip('/')}/{table}"
    df.sortWithinPartitions("session_id").write.mode("append").partitionBy(run_date_col).parquet(path)
    return path


def read(spark: SparkSession, root: str, table: str, schema=None) -> DataFrame:
    """An audit table; pass its schema so an empty table (no data files yet) reads too."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(f"{root.rstrip('/')}/{table}")


def get_by_id(spark: SparkSession, root: str, table: str, id_col: str, value) -> DataFrame:
    """S8 key lookup."""
    return read(spark, root, table).filter(F.col(id_col) == F.lit(value))


def filter_by(spark: SparkSession, root: str, table: str, schema=None, **equals) -> DataFrame:
    """S8 conjunctive equality filter."""
    df = read(spark, root, table, schema)
    for k, v in equals.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def cascade_delete(spark: SparkSession, root: str, new_root: str, doomed: DataFrame,
                   schemas: Mapping[str, object]) -> Mapping[str, str]:
    """Every table without the doomed sessions, written under ``new_root``."""
    ids = doomed.select("session_id").distinct()
    out = {}
    for t, schema in schemas.items():
        kept = read(spark, root, t, schema).join(ids, "session_id", "left_anti")
        path = f"{new_root.rstrip('/')}/{t}"
        kept.write.mode("overwrite").partitionBy("run_date").parquet(path)
        out[t] = path
    return out
