"""Reproducible data corruption (C1-C8): known faults that the risk rules must catch.

Random draws use the portable seeded hash of the key columns, so a corruption is the
same on every partitioning and on a re-run after an executor loss.  Exact draw sizes
(``floor(n*frac)`` rows) come from ``hash_rank_bins``: counts per hash bucket, never a
global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SEED, is_numeric_type
from ..functions.ranks import hash_rank_bins

# The label written by unseen_categories, the number of leading rows that
# unseen_categories / extreme_outliers rewrite, and the outlier scale.
UNSEEN_LABEL = "UNSEEN_CAT_XYZ"
LEADING_ROWS = 5
OUTLIER_SCALE = 1000


def missing_column_names(df: DataFrame) -> DataFrame:
    """The first header becomes blank."""
    names = list(df.columns)
    if names:
        names[0] = ""
    return df.toDF(*names)


def _draw(df: DataFrame, key_cols: Sequence[str], frac: float, seed: int, flag: str, hash_cols=None) -> DataFrame:
    bp = int(round(frac * 10_000))
    return hash_rank_bins(df, [], key_cols, seed=seed, fractions_bp=[bp], rounding="floor", out_col=flag,
                          hash_cols=hash_cols)


def duplicate_rows(df: DataFrame, key_cols: Sequence[str], frac: float = 0.25, seed: int = SEED,
                   hash_cols: Sequence[str] | None = None) -> DataFrame:
    """Append floor(n*frac) copies of rows picked by the seeded hash order."""
    picked = _draw(df, key_cols, frac, seed, "_pick", hash_cols).filter(F.col("_pick") == 0).drop("_pick")
    return df.unionByName(picked)


def target_leakage_inject(df: DataFrame, target: str) -> DataFrame:
    """``<target>_outcome`` copies the target; ``leakage_val`` is 2*target (or a copy)."""
    if target not in df.columns:
        return df
    t = F.col(f"`{target}`")
    leak = t * F.lit(2.0) if is_numeric_type(df.schema[target].dataType) else t
    return df.withColumns({f"{target}_outcome": t, "leakage_val": leak})


def dtype_change(df: DataFrame, col: str) -> DataFrame:
    """C4: the column becomes text."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.col(f"`{col}`").cast("string"))


def null_burst(df: DataFrame, col: str, key_cols: Sequence[str], frac: float = 0.4, seed: int = SEED) -> DataFrame:
    """floor(n*frac) cells of ``col`` become missing."""
    if col not in df.columns:
        return df
    d = _draw(df, key_cols, frac, seed, "_burst")
    return d.withColumn(col, F.when(F.col("_burst") != 0, F.col(f"`{col}`"))).drop("_burst").select(*df.columns)


def _leading_keys(df: DataFrame, key_cols: Sequence[str]) -> list[tuple]:
    # top-k by key (TakeOrderedAndProject keeps 5 rows per task): the limit is the feature
    rows = df.select(*key_cols).orderBy(*key_cols).limit(LEADING_ROWS).collect()
    return [tuple(r) for r in rows]


def _is_leading(df: DataFrame, key_cols: Sequence[str], keys: list[tuple]):
    # literals carry the key columns' own types (a naive datetime must stay timestamp_ntz)
    if not keys:
        return F.lit(False)
    cond = F.lit(False)
    for k in keys:
        one = F.lit(True)
        for c, v in zip(key_cols, k):
            one = one & (F.col(c) == F.lit(v).cast(df.schema[c].dataType))
        cond = cond | one
    return cond


def unseen_categories(df: DataFrame, col: str, key_cols: Sequence[str]) -> DataFrame:
    """The first five rows (smallest keys) get a label never seen before."""
    if col not in df.columns:
        return df
    lead = _is_leading(df, key_cols, _leading_keys(df, key_cols))
    return df.withColumn(col, F.when(lead, F.lit(UNSEEN_LABEL)).otherwise(F.col(f"`{col}`").cast("string")))


def extreme_outliers(df: DataFrame, col: str, key_cols: Sequence[str]) -> DataFrame:
    """The first five rows get (max + 1) * 1000; a missing or infinite max counts as 1."""
    if col not in df.columns or not is_numeric_type(df.schema[col].dataType):
        return df
    c = F.col(f"`{col}`")
    dt = df.schema[col].dataType
    clean = F.when(~F.isnan(c), c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c
    mx = df.agg(F.max(clean.cast("double"))).first()[0]
    if mx is None or mx in (float("inf"), float("-inf")):
        mx = 1.0
    value = (mx + 1) * OUTLIER_SCALE
    lead = _is_leading(df, key_cols, _leading_keys(df, key_cols))
    out_type = dt if is_numeric_type(dt) and isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)) else T.DoubleType()
    return df.withColumn(col, F.when(lead, F.lit(value).cast(out_type)).otherwise(c.cast(out_type)))


def changed_column_order(df: DataFrame) -> DataFrame:
    """Columns reversed."""
    return df.select(*[F.col(f"`{c}`") for c in reversed(df.columns)])
