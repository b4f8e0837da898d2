"""Attribution and representative cases (H1, H4-H9) and the dominant-feature share.

Linear attributions are closed-form columns (coef * (x - background mean)), unpivoted to
long rows; global importance is one ``groupBy(feature)``.  Case picking is one aggregate
of ``min_by`` over (ordering value, key) structs, so ties break on the key and nothing is
sorted; the median-error case uses the bounded rank selection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, r6
from ..functions.ranks import lex_thresholds

# The correlated-pair threshold and the dominant-feature share.
CORR_LIMIT = 0.7
DOMINANT_SHARE = 0.5


def background_means(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = train.agg(*[F.avg(as_double(train, f)).alias(f) for f in features]).first()
    return {f: row[f] for f in features}


def linear_shap(df: DataFrame, coefs: dict[str, float], means: dict[str, float], key_cols: Sequence[str]) -> DataFrame:
    """H1: exact attributions of a linear model against the training means (long rows)."""
    feats = list(coefs)
    structs = [F.struct(F.lit(f).alias("feature"), as_double(df, f).alias("value"),
                        (F.lit(coefs[f]) * (as_double(df, f) - F.lit(means[f]))).alias("shap")) for f in feats]
    return df.select(*key_cols, F.explode(F.array(*structs)).alias("a")).select(*key_cols, "a.*")


def global_importance(shap_long: DataFrame, coefs: dict[str, float] | None = None) -> DataFrame:
    """H4 (mean |attribution|, descending rank) with H5 (|coef|) and T10 (share, dominant)."""
    g = shap_long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    if coefs:
        imp = F.create_map(*[x for f, c in coefs.items() for x in (F.lit(f), F.lit(abs(c)))])
        g = g.withColumn("importance", imp[F.col("feature")])
    else:
        g = g.withColumn("importance", F.col("mean_abs_shap"))
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0))  # over the feature rows only
    g = g.withColumns({"_tot": F.sum("importance").over(w),
                       "shap_rank": F.row_number().over(w.orderBy(F.desc("mean_abs_shap"), "feature"))})
    share = F.try_divide(F.col("importance"), F.col("_tot"))
    return g.select("feature", r6(F.col("mean_abs_shap")).alias("mean_abs_shap"), F.col("shap_rank").cast("int"),
                    r6(F.col("importance")).alias("importance"), r6(share).alias("importance_share"),
                    (share > DOMINANT_SHARE).alias("is_dominant"))


#: A pair's variance counts as none below this part of its sum of squares (rounding of equal values).
FLAT = 1e-12
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) for every pair a < b of column numbers, over the rows that have both.

    Every task multiplies blocks of rows with their masks (four matrix products give all pairs' sums) and
    hands out one row a column; the rows of a column add up by element.  Values are taken from the
    column's mean, so that sums of squares keep their digits."""
    k = len(cols)
    values = df.select(*[as_double(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    means = values.agg(*[F.avg(f"c{i}") for i in range(k)]).first()
    shift = np.array([0.0 if m is None or not math.isfinite(m) else m for m in means])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - shift
            has = ~np.isnan(x)
            x = np.where(has, x, 0.0)
            m = has.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        n, s, q, p = total
        own = {"n": n, "sx": s, "sy": s.T, "sxx": q, "syy": q.T, "sxy": p}
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), *(pa.array([own[c][i, i + 1:] for i in range(k)], pa.list_(pa.float64())) for c in _SUMS)],
            ["a", *_SUMS])

    def add(part: pa.Table) -> pa.Table:
        sums = [np.sum(part.column(c).to_pylist(), axis=0) for c in _SUMS]
        return pa.table({"a": part.column("a")[:1], **{c: pa.array([s], pa.list_(pa.float64())) for c, s in zip(_SUMS, sums)}})

    kinds = "a int, " + ", ".join(f"{c} array<double>" for c in _SUMS)
    rows = values.mapInArrow(work, kinds).groupBy("a").applyInArrow(add, kinds)
    each = rows.select("a", F.posexplode(F.arrays_zip(*_SUMS)).alias("at", "s"))
    return each.select("a", (F.col("a") + 1 + F.col("at")).alias("b"), *[F.col(f"s.{c}").alias(c) for c in _SUMS])


def correlated_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H6: |Pearson| of every pair (upper triangle, pairwise complete); null where a side is constant."""
    k = len(cols)
    if k < 2:
        return df.sparkSession.createDataFrame(
            [], "pair_index int, feature_a string, feature_b string, corr double, above_limit boolean")
    s = pair_sums(df, cols)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    varied = (vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy"))
    corr = F.when(varied, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in cols])
    index = (F.col("a") * (2 * k - F.col("a") - 1) / 2 + F.col("b") - F.col("a") - 1).cast("int")
    return s.select(index.alias("pair_index"), F.get(names, F.col("a")).alias("feature_a"), F.get(names, F.col("b")).alias("feature_b"),
                    corr.alias("corr")).select(
        "pair_index", "feature_a", "feature_b", r6(F.col("corr")).alias("corr"),
        F.coalesce(F.abs("corr") > CORR_LIMIT, F.lit(False)).alias("above_limit"))


def cases_classification(df: DataFrame, key_cols: Sequence[str], label: str, pred: str, prob_pred: str) -> DataFrame:
    """H7: most confident correct, closest to 0.5, most confident wrong (none wrong: the
    correct one again).  ``prob_pred`` is the probability of the predicted class."""
    key = F.struct(*[F.col(k) for k in key_cols])
    p = F.col(prob_pred).cast("double")
    ok = F.col(label) == F.col(pred)
    row = df.agg(
        F.min_by(key, F.when(ok, F.struct((-p).alias("o"), key.alias("k")))).alias("correct"),
        F.min_by(key, F.struct(F.abs(p - 0.5).alias("o"), key.alias("k"))).alias("borderline"),
        F.min_by(key, F.when(~ok, F.struct((-p).alias("o"), key.alias("k")))).alias("failure"),
    )
    picks = row.select(F.explode(F.array(
        F.struct(F.lit("highest_confidence_correct").alias("case_name"), F.col("correct").alias("k")),
        F.struct(F.lit("borderline").alias("case_name"), F.col("borderline").alias("k")),
        F.struct(F.lit("failure_case").alias("case_name"), F.coalesce("failure", "correct").alias("k")),
    )).alias("c")).select("c.case_name", *[F.col(f"c.k.{k}").alias(k) for k in key_cols])
    return picks.join(df.select(*key_cols, label, pred, prob_pred), list(key_cols))


def cases_regression(df: DataFrame, key: str, label: str, pred: str) -> DataFrame:
    """H8: smallest, median (rank n // 2 in (error, key) order) and largest absolute error."""
    err = F.abs(F.col(label).cast("double") - F.col(pred).cast("double"))
    d = df.withColumn("abs_error", err)
    row = d.agg(F.min_by(F.col(key), F.struct("abs_error", F.col(key))).alias("lo"),
                F.min_by(F.col(key), F.struct((-F.col("abs_error")).alias("e"), F.col(key))).alias("hi"),
                F.count("abs_error").alias("n")).first()
    n = row["n"]
    med_key = lex_thresholds(d, F.col("abs_error"), F.col(key), [n // 2], n)[n // 2][1] if n else None
    picks = {"highest_confidence_correct": row["lo"], "borderline": med_key, "failure_case": row["hi"]}
    case = F.lit(None).cast("string")
    for name, k in picks.items():
        case = F.when(F.col(key) == F.lit(k), F.lit(name)).otherwise(case)
    # a row may be more than one case; expand the matches
    arr = F.array(*[F.when(F.col(key) == F.lit(k), F.lit(name)) for name, k in picks.items()])
    return d.filter(F.col(key).isin([k for k in picks.values() if k is not None])) \
        .select(F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("case_name"), key, label, pred, "abs_error")


def case_table(cases: DataFrame, shap_long: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """H9: each case with its feature values and attributions (long rows)."""
    return cases.join(shap_long, list(key_cols))
