"""Column profile (P1-P8): one wide aggregate per pass instead of a scan per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (as_double, clean, dtype_name, is_numeric_type, kind_of, long_rows, miss, r6)
from ..functions.ranks import exact_quantiles

# Tukey fences at 1.5 IQR; fewer than 4 distinct values means no outlier score.
TUKEY_K = 1.5
MIN_DISTINCT_FOR_OUTLIERS = 4

# Value patterns that tell the kinds of text apart (P6, re-aimed for typed columns).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_PATTERN = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$"
BOOL_WORDS = ("true", "false")


def _orderable(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.MapType, T.StructType, T.ArrayType, T.BinaryType, T.VariantType))


def profile_columns(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Per column name, position, dtype, kind, rows, missing rate, constant flag.

    One aggregate over all columns (partial aggregation on every task, a single tiny
    final merge), then one row per column.  ``rounded=False`` keeps the exact rate, for rules
    that compare it with a limit.
    """
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for i, f in enumerate(df.schema.fields):
        m = F.count_if(miss(df, f.name))
        aggs.append(F.try_divide(m.cast("double"), n.cast("double")).alias(f"m{i}"))
        if _orderable(f.dataType):
            v = clean(df, f.name)
            const = (m == n) | ((m == 0) & (F.min(v) == F.max(v)))
        else:
            const = m == n
        aggs.append(F.coalesce(const, F.lit(True)).alias(f"k{i}"))
    wide = df.agg(*aggs)
    out = long_rows(wide, [F.col("_n").alias("n_rows")],
                    ["column_name", "position", "dtype", "kind", "missing_rate", "is_constant"],
                    [(f.name, i, dtype_name(f.dataType), kind_of(f.dataType), F.col(f"m{i}"), F.col(f"k{i}"))
                     for i, f in enumerate(df.schema.fields)])
    rate = F.coalesce("missing_rate", F.lit(0.0))
    return out.select(
        "column_name", F.col("position").cast("int").alias("position"), "dtype", "kind",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        (r6(rate) if rounded else rate).alias("missing_rate"), "is_constant",
    )


def duplicate_ratio(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Share of rows equal to an earlier row (missing equals missing); 0 when empty.

    Exact: a hash aggregate on all columns (partial aggregation first, so local copies
    collapse before the shuffle).
    """
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    ratio = F.coalesce(F.try_divide((F.col("n_rows") - F.col("n_unique")).cast("double"), F.col("n_rows")), F.lit(0.0))
    return groups.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).cast("bigint").alias("n_unique"),
    ).select(
        "n_rows", "n_unique",
        (F.col("n_rows") - F.col("n_unique")).alias("n_duplicates"),
        (r6(ratio) if rounded else ratio).alias("duplicate_ratio"),
    )


def text_kinds(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P6 re-aimed: per text column the share of non-missing values that read as number,
    date/time, boolean or free text; mixed when more than one kind occurs."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields
                                                if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        lower = F.lower(F.trim(v))
        is_num = v.rlike(NUMBER_PATTERN)
        is_bool = lower.isin(*BOOL_WORDS)
        is_date = (~is_num) & v.rlike(DATE_PATTERN)
        is_text = v.isNotNull() & ~is_num & ~is_bool & ~is_date
        aggs += [
            F.count(v).alias(f"n{i}"), F.count_if(is_num).alias(f"a{i}"), F.count_if(is_date).alias(f"d{i}"),
            F.count_if(is_bool).alias(f"b{i}"), F.count_if(is_text).alias(f"t{i}"),
        ]
    wide = df.agg(*aggs)
    long = long_rows(wide, [], ["column_name", "n_values", "n_number", "n_datetime", "n_boolean", "n_text"],
                     [(c, *[F.col(f"{k}{i}") for k in "nadbt"]) for i, c in enumerate(cols)])

    def share(c):
        return r6(F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_values").cast("double")), F.lit(0.0)))

    kinds = sum((F.col(c) > 0).cast("int") for c in ("n_number", "n_datetime", "n_boolean", "n_text"))
    return long.select(
        "column_name", F.col("n_values").cast("bigint").alias("n_values"),
        share("n_number").alias("share_number"), share("n_datetime").alias("share_datetime"),
        share("n_boolean").alias("share_boolean"), share("n_text").alias("share_text"),
        (kinds > 1).alias("is_mixed"),
    )


def tukey_outliers(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Share of values outside the Tukey fences per numeric column (missing skipped).

    Pass 1 counts and (approximate) distinct counts for every column in one aggregate;
    exact quartiles use the bounded rank selection; pass 2 is one aggregate of
    conditional counts.  A column with fewer than 4 distinct values, no values or a zero
    IQR scores 0.
    """
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    exprs = {c: as_double(df, c) for c in cols}
    first = df.agg(*[F.count(e) for e in exprs.values()], *[F.approx_count_distinct(e) for e in exprs.values()]).first()
    counts = dict(zip(cols, first[:len(cols)]))
    approx = dict(zip(cols, first[len(cols):]))
    low = [c for c in cols if approx[c] < 4 * MIN_DISTINCT_FOR_OUTLIERS]
    distinct = {c: approx[c] for c in cols}
    if low:  # exact only where the sketch cannot decide
        distinct.update(zip(low, df.agg(*[F.count_distinct(exprs[c]) for c in low]).first()))
    scored = [c for c in cols if counts[c] > 0 and distinct[c] >= MIN_DISTINCT_FOR_OUTLIERS]
    q = exact_quantiles(df, {c: exprs[c] for c in scored}, [0.25, 0.75],
                        counts={c: counts[c] for c in scored}) if scored else {}
    aggs, meta = [], []
    for i, c in enumerate(cols):
        q1, q3 = q.get((c, 0.25)), q.get((c, 0.75))
        if c in scored and q3 - q1 != 0:
            iqr = q3 - q1
            lo, hi = q1 - TUKEY_K * iqr, q3 + TUKEY_K * iqr
            e = exprs[c]
            aggs.append(F.try_divide(F.count_if((e < F.lit(lo)) | (e > F.lit(hi))).cast("double"),
                                     F.count(e).cast("double")).alias(f"s{i}"))
        else:
            aggs.append(F.lit(0.0).alias(f"s{i}"))
        meta.append((c, q1, q3))
    wide = df.agg(*aggs)
    long = long_rows(wide, [], ["column_name", "q1", "q3", "outlier_share"],
                     [(c, F.lit(q1).cast("double"), F.lit(q3).cast("double"), F.col(f"s{i}"))
                      for i, (c, q1, q3) in enumerate(meta)])
    return long.select("column_name", r6(F.col("q1")).alias("q1"), r6(F.col("q3")).alias("q3"),
                       r6(F.coalesce("outlier_share", F.lit(0.0))).alias("outlier_share"))


# First characters that make a spreadsheet cell a formula.
FORMULA_PREFIXES = ("=", "+", "-", "@")


def formula_cells(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per text column, cells whose first character starts a spreadsheet formula."""
    cols = list(cols) if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(F.substring(v, 1, 1).isin(*FORMULA_PREFIXES)).alias(f"s{i}")]
    wide = df.agg(*aggs)
    return long_rows(wide, [], ["column_name", "n_cells", "n_formula"],
                     [(c, F.col(f"n{i}"), F.col(f"s{i}")) for i, c in enumerate(cols)]).select(
        "column_name", F.col("n_cells").cast("bigint"), F.col("n_formula").cast("bigint"))
