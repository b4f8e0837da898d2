"""Helpers shared by the operators of this package: tables, hashes, scratch folders, skew-safe joins."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import pin
from ..session import ensure_checkpoint_dir

__all__ = ["Scratch", "bounded_batches", "crc_remainder", "hash128", "heavy_split_join", "pin", "read_table"]

# ASCII white space as the contracts list it, and the ASCII letters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch handed to a Python worker.  Whole texts travel in these batches, so
#: the default of 10,000 rows could hold a gigabyte of long documents.
BATCH_ROWS = 512
PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch to ``rows`` rows (never raises a smaller setting).

    Also tells Python workers where this package lies, for sessions started from another folder.
    """
    workers = spark.sparkContext.environment
    if PACKAGE_HOME not in workers.get("PYTHONPATH", "").split(os.pathsep):
        workers["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_HOME, workers.get("PYTHONPATH", "")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle and checkpoint files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` would fold other alphabets too)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under independent seeds: 128 bits, so corpora of 10^12 keys stay free of collisions."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


class Scratch:
    """A folder below the cluster's shared checkpoint folder, removed when the block ends.

    ``stash`` writes a frame as Parquet and reads it back, which cuts lineage with files that
    every executor sees.  Results that outlive the block must be pinned first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def stash(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self, n: int) -> None:
        self._delete(f"{self.path}/{n}")

    def keep(self) -> None:
        """Leave the folder in place until the driver's JVM ends (for frames that are read later)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *exc) -> None:
        self._delete(self.path)


#: At most so many keys are broadcast as heavy.
HEAVY_KEYS = 10_000


def heavy_split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique on ``keys``), safe when one key holds most of ``left``.

    ``weight`` is a column of ``right`` with the number of left rows of the key.  Keys with more
    than 1 / HEAVY_KEYS of the summed weight are fewer than HEAVY_KEYS by construction, whatever
    the input's size: these alone are broadcast.  All other keys meet in a shuffled join, in which
    no key can hold more than that share of the rows.  Both inputs should be materialised.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    cut = total / HEAVY_KEYS
    heavy = F.broadcast(right.filter(F.col(weight) > cut).drop(weight))
    rest = right.filter(F.col(weight) <= cut).drop(weight)
    if total == 0:
        return left.join(rest, keys)
    marked = heavy.select(*keys)
    return left.join(heavy, keys).unionByName(
        left.join(F.broadcast(marked), keys, "left_anti").join(rest.hint("shuffle_merge"), keys))
