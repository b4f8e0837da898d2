"""Report sink and reload (S5, S6): a long-form report (section, key, value_json) written as
JSON lines by Spark, and typed tables rebuilt from the saved file alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.risk import union_flags


def section(df: DataFrame, name: str, key_col: str) -> DataFrame:
    """Rows of any DataFrame as report entries: the key column plus all fields as JSON."""
    return df.select(F.lit(name).alias("section"), F.col(f"`{key_col}`").cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value_json"))


def build_report(sections: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Union of the sections (no collect; written by the executors)."""
    return union_flags([section(df, name, key) for name, (df, key) in sections.items()])


def write_report(report: DataFrame, path: str) -> str:
    report.write.mode("overwrite").json(path)
    return path


def read_section(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One section of a saved report as a typed table (``from_json`` with a schema)."""
    r = spark.read.schema("section string, key string, value_json string").json(path)
    return r.filter(F.col("section") == name).select(F.from_json("value_json", schema).alias("v")).select("v.*")
