"""Version store (Z5): every recorded version of a table with its schema, and its bins for later comparisons.

A version keeps the edges and counts of its numeric columns and the counts of its categories.  The next
version is compared with these stored bins: its own rows are read, those of the older one never again.

    <path>/versions   one row a version: fingerprint, columns, rows, whether the schema changed
    <path>/columns    one row a version and column: type, PSI against the version before, band
    <path>/bins       the counts of each version's bins and categories
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dtype_name, is_numeric_type, long_rows
from ..functions.materialize import pin
from . import drift

_VERSIONS = "no int, token string, version string, fingerprint string, n_columns int, n_rows bigint, changed boolean"
_COLUMNS = "no int, token string, column_name string, position int, dtype string, method string, n_bins bigint, psi double, band string"
_BINS = "no int, token string, column_name string, bin int, low double, high double, value string, n bigint"


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    at = f"{path.rstrip('/')}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(at)


def _as_number(df: DataFrame, c: str) -> Column:
    """A column as numbers, text that holds none as missing (a numeric column may have become text)."""
    v = F.col(f"`{c}`").try_cast("double")
    return F.when(~F.isnan(v), v)


def _as_category(df: DataFrame, c: str) -> Column:
    """A column's categories as text; numbers compare as numbers (1 and 1.0 are one category)."""
    numeric = is_numeric_type(df.schema[c].dataType)
    return (_as_number(df, c) if numeric else F.col(f"`{c}`")).cast("string")


def comparable(df: DataFrame) -> list[str]:
    """Columns that PSI compares: numbers, text and booleans."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) or isinstance(f.dataType, (T.StringType, T.BooleanType))]


def bin_counts(df: DataFrame, edges: dict[str, list[float]], categorical: list[str]) -> DataFrame:
    """(column_name, bin, value, n) in one pass: bin -1 holds values beyond the outer edges, categories have no bin."""
    rows = []
    for c, e in edges.items():
        v = _as_number(df, c)
        inner = sum((v >= F.lit(x)).cast("int") for x in e[1:-1]) if len(e) > 2 else F.lit(0)
        at = F.when(v.isNotNull(), F.when((v >= F.lit(e[0])) & (v <= F.lit(e[-1])), inner).otherwise(-1))
        rows.append((c, at, F.lit(None).cast("string")))
    rows += [(c, F.lit(None).cast("int"), _as_category(df, c)) for c in categorical]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, value string, n bigint")
    long = long_rows(df, [], ["column_name", "bin", "value"], rows).filter("bin IS NOT NULL OR value IS NOT NULL")
    return long.groupBy("column_name", "bin", "value").agg(F.count(F.lit(1)).alias("n"))


def compare(stored: DataFrame, df: DataFrame) -> DataFrame:
    """(column_name, method, n_bins, psi, band) of the rows ``df`` against stored bins, for the columns both have.

    A column without values on one side scores 0."""
    spark = df.sparkSession
    edges: dict[str, list[float]] = {}
    # at most 10 bins a column
    for r in sorted(stored.filter("low IS NOT NULL").select("column_name", "bin", "low", "high").collect(), key=lambda r: (r[0], r[1])):
        edges.setdefault(r["column_name"], [r["low"]]).append(r["high"])
    held = {r[0] for r in stored.select("column_name").distinct().collect()}  # a row a column
    edges = {c: e for c, e in edges.items() if c in df.columns}
    categorical = [c for c in df.columns if c in held and c not in edges]
    now = bin_counts(df, edges, categorical).withColumnRenamed("n", "a")
    keys = ["column_name", "bin", "value"]
    old = stored.select(*keys, F.col("n").alias("e"))
    slots = [(c, b, None) for c, e in edges.items() for b in range(len(e) - 1)]
    every = spark.createDataFrame(slots, "column_name string, bin int, value string")
    both = old.unionByName(now, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    counts = both.groupBy(*keys).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    totals = counts.groupBy("column_name").agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    full = counts.filter("bin IS NULL OR bin >= 0").join(totals, "column_name").filter("ne > 0 AND na > 0")
    psi = drift._psi_from_counts(full, ["column_name"])
    names = [(c, "quantile_bins" if c in edges else "categories") for c in df.columns if c in held]
    listed = spark.createDataFrame(names, "column_name string, method string")
    scored = listed.join(psi, "column_name", "left").withColumns(
        {"psi": F.coalesce("psi", F.lit(0.0)), "n_bins": F.coalesce("n_bins", F.lit(0)).cast("bigint")})
    return scored.select("column_name", "method", "n_bins", "psi", drift.band(F.col("psi")).alias("band"))


def record(df: DataFrame, path: str, version: str) -> None:
    """Append a version: compare it with the stored bins of the one before, and store its own."""
    spark = df.sparkSession
    before = _table(spark, path, "versions", _VERSIONS).orderBy(F.desc("no")).limit(1).collect()  # the latest version
    no, token = (before[0]["no"] + 1 if before else 0), uuid.uuid4().hex  # rows of a broken-off recording match no version
    cols = comparable(df)
    edges = drift.bin_edges(df, [c for c in cols if is_numeric_type(df.schema[c].dataType)])
    own = bin_counts(df, edges, [c for c in cols if c not in edges])
    # every bin is stored, empty ones too
    bins = spark.createDataFrame([(c, b, None, 0, e[b], e[b + 1]) for c, e in edges.items() for b in range(len(e) - 1)],
                                 "column_name string, bin int, value string, n bigint, low double, high double")
    own = own.unionByName(bins, allowMissingColumns=True).groupBy("column_name", "bin", "value").agg(
        F.sum("n").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"))
    described = spark.createDataFrame([(f.name, i, dtype_name(f.dataType)) for i, f in enumerate(df.schema.fields)],
                                      "column_name string, position int, dtype string")
    if before:
        stored = _table(spark, path, "bins", _BINS).filter((F.col("no") == no - 1) & (F.col("token") == before[0]["token"]))
        described = described.join(compare(stored, df), "column_name", "left")
    else:
        described = described.withColumns({c: F.lit(None).cast(t) for c, t in (("method", "string"), ("n_bins", "bigint"), ("psi", "double"), ("band", "string"))})
    root = path.rstrip("/")
    one = [F.lit(no).alias("no"), F.lit(token).alias("token")]
    own.select(*one, "column_name", "bin", "low", "high", "value", "n").write.mode("append").parquet(f"{root}/bins")
    described.select(*one, "column_name", "position", "dtype", "method", "n_bins", "psi", "band").write.mode("append").parquet(f"{root}/columns")
    mark = drift.fingerprint(df)
    # the version's row comes last: without it the version doesn't exist
    df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        *one, F.lit(version).alias("version"), F.lit(mark).alias("fingerprint"), F.lit(len(df.columns)).alias("n_columns"), "n_rows",
        F.lit(bool(before) and before[0]["fingerprint"] != mark).alias("changed")).write.mode("append").parquet(f"{root}/versions")


def history(spark: SparkSession, path: str) -> DataFrame:
    """A row for each version and column, with the version's own entries and whether it is the latest.

    Rows of a recording that broke off before its version's row was written aren't shown."""
    v = _table(spark, path, "versions", _VERSIONS)
    top = v.agg(F.max("no").alias("top"))
    v = v.join(F.broadcast(top), F.col("no") == F.col("top"), "left").withColumn("latest", F.col("top").isNotNull()).drop("top")
    c = _table(spark, path, "columns", _COLUMNS)
    return c.join(F.broadcast(v), ["no", "token"]).drop("token")


def latest_psi(spark: SparkSession, path: str) -> DataFrame:
    """The scores of the latest version."""
    return pin(history(spark, path).filter("latest AND psi IS NOT NULL").select("version", "column_name", "psi", "band"))
