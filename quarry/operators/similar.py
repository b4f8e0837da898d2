"""Similar earlier runs (Z7): a profile vector of every table version, stored by random-projection
bucket, and an exact search for the earlier versions with the largest cosine.

A version's vector has the same length whatever its columns: each column adds its presence, missing rate,
and the squashed mean and deviation of its values to the slot that its name hashes to.  One grouped pass
profiles all versions of a table.

The store is partitioned by bucket: on which side of the centre a unit vector lies along a few orthonormal
random directions within the span of the data.  From a query that lies q_i from the centre, a vector on the
other side of the directions S is at least the root of the sum of q_i^2 over S away, so its cosine is at most
1 - half of that sum.  After its own bucket a query reads only the buckets whose bound reaches its kth cosine
so far.  The result is exact; the buckets decide how much is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric_type

# Slots of a vector, entries of a slot, leading entries, and the random directions.
SLOTS = 16
ENTRIES = 4
LEADING = 2
DIM = LEADING + SLOTS * ENTRIES
PLANES = 6
PLANE_SEED = 7
#: Versions that the directions are fitted on (every version is stored and searched).
FITTED_ON = 2000
#: Room for rounding in a bucket's bound.
SLACK = 1e-9


def slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


def squash(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x)) / 10


def _value(c: Column, dt: T.DataType) -> Column:
    """A number for every kind of column: itself, the day, or the text's length."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c).cast("double")
    if is_numeric_type(dt) or isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(c.cast("date")).cast("double")
    if isinstance(dt, T.StringType):
        return F.length(c).cast("double")
    return F.when(c.isNotNull(), F.lit(0.0))


def profile_vectors(df: DataFrame, run_id: Column, run_at: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """(run_id, run_at, vector): one row for each version that ``run_id`` tells apart, in one grouped pass.

    ``columns`` are the columns described (all by default).  Columns without values have mean and
    deviation 0; a table without rows has no versions."""
    names = list(df.columns)
    chosen = range(len(names)) if columns is None else [names.index(c) for c in columns]
    plain = [f"_c{i}" for i in range(len(names))]  # any name may occur, the empty one too
    base = df.withColumns({"_run": run_id, "_at": run_at}).toDF(*plain, "_run", "_at")
    kinds = {i: df.schema.fields[i].dataType for i in chosen}
    vals = base.select("_run", "_at", *[_value(F.col(plain[i]), kinds[i]).alias(plain[i]) for i in chosen])
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i in chosen:
        c = F.col(plain[i])
        aggs += [F.count(c).alias(f"k{i}"), F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"d{i}")]
    g = vals.groupBy("_run", "_at").agg(*aggs)
    cells: list[Column] = [F.lit(0.0)] * (SLOTS * ENTRIES)
    for i in chosen:
        own = [F.lit(1.0), 1 - F.col(f"k{i}") / F.col("_n"), squash(F.coalesce(F.col(f"m{i}"), F.lit(0.0))),
               squash(F.coalesce(F.col(f"d{i}"), F.lit(0.0)))]
        at = slot(names[i]) * ENTRIES
        for e, x in enumerate(own):
            cells[at + e] = cells[at + e] + x
    lead = [F.log1p(F.col("_n").cast("double")) / 10, F.lit(len(chosen) / 10.0)]
    return g.select(F.col("_run").alias("run_id"), F.col("_at").cast("bigint").alias("run_at"),
                    F.array(*lead, *cells).alias("vector"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(runs: DataFrame) -> DataFrame:
    """``vector`` replaced by ``unit``; a vector of zeros keeps length 0."""
    norm = F.sqrt(_dot(F.col("vector"), F.col("vector")))
    return runs.withColumn("_norm", norm).withColumn(
        "unit", F.transform("vector", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(F.lit(0.0)))
    ).drop("_norm", "vector")


def directions(sample: np.ndarray, planes: int = PLANES, seed: int = PLANE_SEED) -> np.ndarray:
    """Orthonormal directions drawn at random from the span of the sample's deviations from its mean."""
    away = sample - sample.mean(axis=0)
    draw = np.random.RandomState(seed).normal(size=(len(sample), planes))
    q, _ = np.linalg.qr(away.T @ draw)
    return q.T


def _products(fitted: Sequence[Sequence[float]]) -> Column:
    """Distances from the centre along each direction; ``fitted`` holds the centre, then the directions."""
    centre, *planes = [[float(x) for x in row] for row in fitted]
    return F.array(*[_dot(F.col("unit"), F.array(*[F.lit(x) for x in p])) - F.lit(float(np.dot(centre, p))) for p in planes])


def _bucket(products: Column) -> Column:
    return F.aggregate(F.transform(products, lambda p: F.when(p > 0, 1).otherwise(0)), F.lit(0), lambda a, b: a * 2 + b)


def write_index(runs: DataFrame, path: str, planes: int = PLANES) -> None:
    """Store the versions by bucket.  The directions are fixed by the first write; later ones append."""
    spark = runs.sparkSession
    units = unit_vectors(runs)
    at = f"{path.rstrip('/')}/planes"
    try:
        held = [r["plane"] for r in spark.read.parquet(at).orderBy("no").collect()]  # a few rows
    except Exception as e:  # noqa: BLE001  only a missing path is expected
        if "PATH_NOT_FOUND" not in str(e):
            raise
        drawn = units.orderBy(F.xxhash64("run_id", "run_at")).limit(FITTED_ON).collect()  # the documented sample
        sample = np.array([r["unit"] for r in drawn] or np.zeros((1, DIM)))
        held = [sample.mean(axis=0).tolist(), *directions(sample, planes).tolist()]
        spark.createDataFrame(list(enumerate(held)), "no int, plane array<double>").coalesce(1).write.parquet(at)
    stored = units.withColumn("bucket", _bucket(_products(held)))
    stored.write.mode("append").partitionBy("bucket").parquet(f"{path.rstrip('/')}/vectors")


_STORED = "run_id string, run_at bigint, unit array<double>, bucket int"


def _scored(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """Stored versions of the buckets that the queries ask for, earlier than the query, with their cosine.

    The queries are a stated set (new runs); the join on the partition column reads only their buckets."""
    hit = stored.join(queries, "bucket").filter(F.col("run_at") < F.col("q_at"))
    return hit.select("q_id", "q_at", "run_id", "run_at", _dot(F.col("unit"), F.col("q_unit")).alias("cosine"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id", "q_at").orderBy(F.round("cosine", 9).desc(), "run_id", "run_at")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probes(path: str, queries: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(best versions of each query's own bucket, further buckets that each query has to read)."""
    spark = queries.sparkSession
    planes = [r["plane"] for r in spark.read.parquet(f"{path.rstrip('/')}/planes").orderBy("no").collect()]
    units = unit_vectors(queries).select(F.col("run_id").alias("q_id"), F.col("run_at").alias("q_at"), "unit")
    asked = units.withColumn("products", _products(planes)).withColumn("bucket", _bucket(F.col("products")))
    asked = asked.withColumnRenamed("unit", "q_unit")
    own = _best(_scored(_vectors(spark, path), asked.drop("products")), k)
    least = own.groupBy("q_id", "q_at").agg(F.count("*").alias("found"), F.min("cosine").alias("kth"))
    n = len(planes) - 1
    # squared products of the directions on whose other side a bucket lies
    away = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.when(
        F.getbit(F.col("other").bitwiseXOR(F.col("bucket")), (n - 1 - i).cast("int")) == 1,
        F.col("products")[i] * F.col("products")[i]).otherwise(F.lit(0.0)))
    more = (asked.join(least, ["q_id", "q_at"], "left")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
            .filter(F.col("other") != F.col("bucket"))
            .withColumn("bound", 1 - away / 2 + SLACK)
            .filter((F.coalesce("found", F.lit(0)) < k) | (F.col("bound") >= F.col("kth"))))
    return own, more.select("q_id", "q_at", "q_unit", F.col("other").alias("bucket"))


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{path.rstrip('/')}/vectors")


def similar_runs(path: str, queries: DataFrame, k: int = 3) -> DataFrame:
    """(run_id, rank, similar_run, cosine): the ``k`` stored earlier versions with the largest cosine.

    Cosines that agree to 9 places are tied; ties go to the smaller run id."""
    own, more = probes(path, queries, k)
    rest = _scored(_vectors(queries.sparkSession, path), more)
    best = _best(own.drop("rank").unionByName(rest), k)
    return best.select(F.col("q_id").alias("run_id"), F.col("rank").cast("int").alias("rank"),
                       F.col("run_id").alias("similar_run"), F.round("cosine", 6).alias("cosine"))
