"""Table loading (S1-S3): CSV with header and missing markers, Parquet, TSV/TXT.

Spark's CSV reader knows one ``nullValue``; the markers below are mapped to NULL first,
then each column's type is inferred by one aggregate of ``try_cast`` failures (a
distributed replacement for reading a sample on one machine).
"""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Text read as missing (pandas' default markers).
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                   "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Fixed value patterns used to classify text before any cast is tried.
INT_PATTERN = r"^\s*[+-]?[0-9]{1,19}\s*$"
WIDE_PATTERN = r"^\s*[+-]?[0-9]{1,38}\s*$"
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
BOOL_WORDS = ("true", "false", "True", "False", "TRUE", "FALSE")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    at = f"{base}/quarry-io/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # removed when the driver's JVM ends
    return at


def header_names(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The raw header line (Spark renames a blank header to _c0; R1 must see it blank)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    return next(csv.reader([first[0][0]], delimiter=sep))


def _infer(df: DataFrame) -> DataFrame:
    """One aggregate decides every column's type: the most specific of bigint, decimal(38,0) (whole
    numbers beyond 64 bits), double, boolean that all its non-missing values read as, else string.  Cheap
    patterns classify each value first; a cast is only tried where the pattern matched."""
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(INT_PATTERN) & v.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(v.rlike(WIDE_PATTERN)).alias(f"w{i}"),
            F.count_if(v.rlike(NUMBER_PATTERN)).alias(f"d{i}"),
            F.count_if(v.isin(*BOOL_WORDS)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        chosen = "string"
        if n > 0:
            for t, k in (("bigint", "i"), ("decimal(38,0)", "w"), ("double", "d"), ("boolean", "b")):
                if row[f"{k}{i}"] == n:
                    chosen = t
                    break
        out.append(F.col(f"`{c}`").try_cast(chosen).alias(c) if chosen != "string" else F.col(f"`{c}`"))
    return df.select(*out)


def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """S1/S2/S3 by suffix: .csv, .parquet, .tsv/.txt.

    Quotes inside quoted cells are doubled.  ``multi_line`` allows line breaks in quoted cells; such
    files can't be split, so each is read by one task.  Dates stay text, as in the reference format.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt not in ("csv", "tsv", "txt"):
        raise ValueError(f"unsupported dataset format: {fmt}")
    sep = "," if fmt == "csv" else "\t"
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, nullValue=None, emptyValue="", quote='"', escape='"',
                         multiLine=multi_line)
    names = header_names(spark, path, sep)
    if len(names) == len(raw.columns):
        raw = raw.toDF(*names)
    cleaned = raw.select(*[F.when(F.col(f"`{c}`").isin(MISSING_MARKERS), None).otherwise(F.col(f"`{c}`")).alias(c)
                           for c in raw.columns])
    return _infer(cleaned)


def write_dataset(df: DataFrame, path: str, fmt: str = "csv") -> str:
    sep = "," if fmt == "csv" else "\t"
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "") \
            .option("quote", '"').option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path
