"""Feature preparation (X1, X2, X5-X13): fitted on the training rows, applied as one
narrow projection.

Fitting is three bounded aggregates whatever the number of columns: (1) counts, missing
counts, minimum, skewness, mean; (2) exact medians through the bounded rank selection;
(3) mean and population deviation of each transformed column.  The modes of categorical
columns come from one unpivoted ``groupBy(column, value)``; ties go to the smallest value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, is_numeric_type, long_rows, miss, r6, unpivot
from ..functions.materialize import pin
from ..functions.ranks import exact_quantiles

# Imputation bands and the skew rule.
KNN_LOW = 0.05
KNN_HIGH = 0.30
SKEW_LIMIT = 1.5
#: Columns times parts that one pass takes.
MASKED_COLUMNS = 64


@dataclass
class NumericStep:
    column: str
    missing_rate: float
    imputation: str          # median / median_with_indicator / knn_imputer_5
    fill_value: float | None
    indicator: bool
    skewness: float | None
    log1p: bool
    mean: float | None = None
    std: float | None = None
    ind_mean: float | None = None
    ind_std: float | None = None

    @property
    def scaling(self) -> str:
        return "log1p_and_standard" if self.log1p else "standard"


@dataclass
class PrepModel:
    numeric: list[NumericStep] = field(default_factory=list)
    categorical: dict[str, str | None] = field(default_factory=dict)


def _imputed(df: DataFrame, s: NumericStep) -> Column:
    x = as_double(df, s.column)
    v = F.coalesce(x, F.lit(s.fill_value)) if s.fill_value is not None else x
    return F.log1p(v) if s.log1p else v


def _indicator(df: DataFrame, s: NumericStep) -> Column:
    ind = miss(df, s.column).cast("double")
    return F.log1p(ind) if s.log1p else ind


def fit_prep(train: DataFrame, numeric_cols: Sequence[str], categorical_cols: Sequence[str] = ()) -> PrepModel:
    """X5-X10, X13 fitted on ``train``."""
    return fit_parts(train, [F.lit(True)], numeric_cols, categorical_cols)[0]


def fit_parts(df: DataFrame, parts: Sequence[Column], numeric_cols: Sequence[str],
              categorical_cols: Sequence[str] = ()) -> list[PrepModel]:
    """X5-X10, X13 fitted on each part of ``df`` (the rows that meet its condition), in the passes that one part takes."""
    numeric_cols, categorical_cols, parts = list(numeric_cols), list(categorical_cols), list(parts)
    together = max(1, MASKED_COLUMNS // max(1, len(numeric_cols) + len(categorical_cols)))
    if len(parts) > together:
        return [m for lo in range(0, len(parts), together)
                for m in fit_parts(df, parts[lo:lo + together], numeric_cols, categorical_cols)]
    models = [PrepModel() for _ in parts]
    if numeric_cols:
        aggs = []
        for p, inside in enumerate(parts):
            aggs.append(F.count_if(inside).alias(f"n{p}"))
            for i, c in enumerate(numeric_cols):
                x = F.when(inside, as_double(df, c))
                aggs += [F.count(x).alias(f"c{p}_{i}"), F.min(x).alias(f"m{p}_{i}"), F.skewness(x).alias(f"s{p}_{i}"),
                         F.avg(x).alias(f"a{p}_{i}")]
        row = df.agg(*aggs).first()
        for p, model in enumerate(models):
            n = row[f"n{p}"]
            for i, c in enumerate(numeric_cols):
                cnt = row[f"c{p}_{i}"]
                rate = (n - cnt) / n if n else 0.0
                knn = KNN_LOW < rate <= KNN_HIGH
                indicator = knn or rate > 0
                imputation = "knn_imputer_5" if knn else ("median_with_indicator" if indicator else "median")
                g1 = row[f"s{p}_{i}"]
                # bias-corrected sample skewness from the population value
                skew = g1 * math.sqrt(cnt * (cnt - 1)) / (cnt - 2) if g1 is not None and cnt > 2 else None
                mn = row[f"m{p}_{i}"]
                log1p = mn is not None and mn >= 0 and skew is not None and abs(skew) > SKEW_LIMIT
                # a single-column KNN imputer has no distances: it falls back to the mean
                fill = row[f"a{p}_{i}"] if knn else None
                model.numeric.append(NumericStep(c, rate, imputation, fill, indicator, skew, log1p))
        exprs, counts = {}, {}
        for p, model in enumerate(models):
            for i, s in enumerate(model.numeric):
                if s.imputation != "knn_imputer_5":
                    exprs[(p, i)] = F.when(parts[p], as_double(df, s.column))
                    counts[(p, i)] = row[f"c{p}_{i}"]
        if exprs:
            q = exact_quantiles(df, exprs, [0.5], counts=counts)
            for p, i in exprs:
                models[p].numeric[i].fill_value = q[((p, i), 0.5)]
        aggs = []
        for p, model in enumerate(models):
            for i, s in enumerate(model.numeric):
                v = F.when(parts[p], _imputed(df, s))
                aggs += [F.avg(v).alias(f"mu{p}_{i}"), F.stddev_pop(v).alias(f"sd{p}_{i}")]
                if s.indicator:
                    ind = F.when(parts[p], _indicator(df, s))
                    aggs += [F.avg(ind).alias(f"imu{p}_{i}"), F.stddev_pop(ind).alias(f"isd{p}_{i}")]
        row = df.agg(*aggs).first()
        for p, model in enumerate(models):
            for i, s in enumerate(model.numeric):
                s.mean, s.std = row[f"mu{p}_{i}"], row[f"sd{p}_{i}"]
                if s.indicator:
                    s.ind_mean, s.ind_std = row[f"imu{p}_{i}"], row[f"isd{p}_{i}"]
    if categorical_cols:
        for model, modes in zip(models, _modes(df, parts, categorical_cols)):
            model.categorical = modes
    return models


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Per column the most frequent non-missing value, ties to the smallest."""
    return _modes(df, [F.lit(True)], cols)[0]


def _modes(df: DataFrame, parts: Sequence[Column], cols: Sequence[str]) -> list[dict[str, str | None]]:
    """``most_frequent`` in each part."""
    free = "_" * (1 + max(map(len, df.columns)))  # longer than any column's name
    marks = [f"{free}{p}" for p in range(len(parts))]
    marked = df.select("*", *[inside.alias(m) for inside, m in zip(parts, marks)])
    long = unpivot(marked, marks, cols, name_col="column_name", value_type="string").filter("value IS NOT NULL")
    counts = long.groupBy("column_name", "value").agg(*[F.count_if(m).alias(m) for m in marks])
    best = counts.groupBy("column_name").agg(*[
        F.min_by("value", F.when(F.col(m) > 0, F.struct((-F.col(m)).alias("neg"), F.col("value").alias("v")))).alias(m)
        for m in marks])
    found = {r["column_name"]: r for r in best.collect()}  # one row per column
    return [{c: found[c][m] if c in found else None for c in cols} for m in marks]


def _safe_std(sd):
    return 1.0 if sd is None or sd == 0 else sd


def transform(df: DataFrame, model: PrepModel, keep: Sequence[str] = ()) -> DataFrame:
    """Apply the fitted plan: impute, indicator, log1p, standardise (indicator too)."""
    out = [F.col(f"`{k}`") for k in keep]
    for s in model.numeric:
        v = (_imputed(df, s) - F.lit(s.mean)) / F.lit(_safe_std(s.std))
        out.append(v.alias(s.column))
        if s.indicator:
            ind = (_indicator(df, s) - F.lit(s.ind_mean)) / F.lit(_safe_std(s.ind_std))
            out.append(ind.alias(f"{s.column}__missing"))
    for c, mode in model.categorical.items():
        out.append(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(mode)).alias(c))
    return df.select(*out)


def plan_rows(train: DataFrame, model: PrepModel) -> DataFrame:
    """X13 as rows (one per produced feature), computed with the training row count."""
    rows = []
    for s in model.numeric:
        rows.append((s.column, s.column, "numeric", s.missing_rate, s.imputation, s.fill_value, s.skewness,
                     s.scaling, s.mean, s.std))
        if s.indicator:
            rows.append((f"{s.column}__missing", s.column, "indicator", s.missing_rate, "none", None, None,
                         s.scaling, s.ind_mean, s.ind_std))
    for c, mode in model.categorical.items():
        rows.append((c, c, "categorical", None, "most_frequent", None, None, "onehot", None, None))

    named = ["feature", "source_column", "kind", "missing_rate", "imputation", "fill_value", "skewness", "scaling", "mean", "std"]
    kinds = dict.fromkeys(["missing_rate", "fill_value", "skewness", "mean", "std"], "double")
    cells = [[F.lit(v if v is None or n not in kinds else float(v)).cast(kinds.get(n, "string")) for n, v in zip(named, r)] for r in rows]
    t = long_rows(train.agg(F.count(F.lit(1)).alias("n_train")), [F.col("n_train")], named, cells)
    return t.select("feature", "source_column", "kind", r6(F.col("missing_rate")).alias("missing_rate"), "imputation",
                    r6(F.col("fill_value")).alias("fill_value"), r6(F.col("skewness")).alias("skewness"), "scaling",
                    r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                    F.col("n_train").cast("bigint").alias("n_train"))


def id_like_and_drop(df: DataFrame, target: str, leakage: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """X1 + X2: (sorted drop set, remaining features)."""
    from .framing import frame
    fr = frame(df, target=target)
    drop = sorted(set(leakage) | set(fr.id_like))
    feats = [c for c in df.columns if c != target and c not in drop]
    return drop, feats


@dataclass
class Categories:
    """X11: (column_name, value, n, index) of all categories, and how many slots each column has."""
    index: DataFrame
    widths: dict[str, int]


def category_index(train: DataFrame, cols: Sequence[str]) -> Categories:
    """X11: categories numbered from 0 in ascending order, column by column.

    The distinct values are cut into sorted ranges; a value's number is its place in its range plus the
    sizes of the column's earlier ranges.  No list of values is gathered; missing values have no number."""
    cols = list(cols)
    long = unpivot(train, [], cols, value_type="string").filter("value IS NOT NULL")
    distinct = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = pin(distinct.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("column_name", "part").agg(F.count(F.lit(1)).alias("size"))  # a row a column and range
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    place = F.row_number().over(Window.partitionBy("column_name", "part").orderBy("value")) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(offsets), ["column_name", "part"])
    index = pin(numbered.select("column_name", "value", "n", (F.col("start") + F.col("place")).alias("index")))
    widths = {r["column_name"]: r["w"] for r in index.groupBy("column_name").agg(F.count(F.lit(1)).alias("w")).collect()}
    return Categories(index, {c: widths.get(c, 0) for c in cols})


def onehot_long(df: DataFrame, categories: Categories, cols: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
    """One row per (key, column): the value, the index of its hot slot (NULL: all zeros) and the width.

    A slot is kept as (index, width), never as a vector."""
    keys = [f"_k{i}" for i in range(len(key_cols))]  # a key may be named like the columns added here
    base = df.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(key_cols, keys)], *[F.col(f"`{c}`") for c in cols])
    long = unpivot(base, keys, cols, value_type="string")
    hot = categories.index.select("column_name", "value", F.col("index").alias("onehot_index"))
    width = F.create_map(*[x for c, w in categories.widths.items() for x in (F.lit(c), F.lit(w))])
    return long.join(hot, ["column_name", "value"], "left").select(
        *[F.col(a).alias(k) for k, a in zip(key_cols, keys)], "column_name", "value", "onehot_index",
        width[F.col("column_name")].alias("width"))


def numeric_features(model: PrepModel) -> list[str]:
    """The numeric columns that ``transform`` produces, indicators behind their column."""
    return [name for s in model.numeric for name in ([s.column, f"{s.column}__missing"] if s.indicator else [s.column])]


def feature_stages(model: PrepModel, out: str = "features") -> list:
    """One-hot of the filled categories, side by side with the prepared numbers."""
    cats = list(model.categorical)
    stages = []
    if cats:
        stages.append(StringIndexer(inputCols=cats, outputCols=[f"{c}__idx" for c in cats],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__vec" for c in cats],
                                    dropLast=True))
    inputs = numeric_features(model) + [f"{c}__vec" for c in cats]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="keep")]



def target_encode_oof(folded: DataFrame, col: str, target: str, fold_col: str = "fold") -> DataFrame:
    """Z3: out-of-fold mean target per category: (sum - fold sum) / (count - fold count),
    from one grouped pass per (category, fold) joined back by key (no row leaves its fold's
    statistics)."""
    # exact decimal sums: the result does not depend on the order rows are added in
    y = F.col(f"`{target}`").cast("decimal(38,10)")
    per = folded.groupBy(col, fold_col).agg(F.sum(y).alias("_fold_sum"), F.count(y).alias("_fold_n"))
    tot = per.groupBy(col).agg(F.sum("_fold_sum").alias("_all_sum"), F.sum("_fold_n").alias("_all_n"))
    stats = per.join(tot, col).select(col, fold_col, F.try_divide(
        (F.col("_all_sum") - F.col("_fold_sum")).cast("double"),
        (F.col("_all_n") - F.col("_fold_n")).cast("double")).alias("_te"))
    return folded.join(stats, [col, fold_col], "left").withColumnRenamed("_te", f"{col}__te")
