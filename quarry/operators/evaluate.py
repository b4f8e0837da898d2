"""Evaluation metrics (E1-E14) as aggregate queries over (label, prediction, score) rows.

Exact ROC AUC and the precision-recall curve need, for every distinct score, how many
negatives (positives) score lower.  ``score_curve`` gets those running sums without a
global sort: scores are first collapsed to distinct values per group (partial
aggregation), cut into buckets at approximate quantiles when there are many of them,
bucket totals are summed over the few bucket rows, and the exact running sum inside a
bucket is a window partitioned by (group, bucket).  A hot group holding a third of the
rows is spread over buckets like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import long_rows, r6, safe_corr, unpivot

# ECE bins, slice size and gates.
ECE_BINS = 10
SLICE_MIN_ROWS = 10
SLICE_GATE_AUC = 0.55
SLICE_GATE_R2 = -0.5
DISTINCT_SCORES_PER_BUCKET = 20_000


def _edges_ece() -> list[float]:
    # the bin edges as a linearly spaced grid computes them: i * step, last one exactly 1
    step = 1.0 / ECE_BINS
    return [i * step for i in range(ECE_BINS)] + [1.0]


def score_curve(df: DataFrame, label: Column, score: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, distinct score): pos, neg, pos_below, neg_below, P, N (label is 0/1).

    Rows without a score (null or NaN) or label take no part, whatever the number of scores."""
    gcols = list(group_cols)
    base = df.select(*[F.col(f"`{c}`") for c in gcols], label.cast("long").alias("_y"),
                     score.cast("double").alias("score"))
    base = base.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("_y").isNotNull())
    g = base.groupBy(*gcols, "score").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    distinct = base.agg(F.approx_count_distinct("score")).first()[0] or 0
    buckets = max(1, math.ceil(distinct / DISTINCT_SCORES_PER_BUCKET))
    if buckets == 1:
        # at most DISTINCT_SCORES_PER_BUCKET distinct scores: one window per group is bounded
        wg = Window.partitionBy(*gcols) if gcols else Window.partitionBy(F.lit(0))
        wb = wg.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        return g.select(
            *gcols, "score", "pos", "neg", F.sum("pos").over(wg).alias("P"), F.sum("neg").over(wg).alias("N"),
            F.coalesce(F.sum("pos").over(wb), F.lit(0)).alias("pos_below"),
            F.coalesce(F.sum("neg").over(wb), F.lit(0)).alias("neg_below"))
    cuts = g.agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0]
    splits = [float("-inf")] + sorted(set(cuts)) + [float("inf")]
    g = Bucketizer(splits=splits, inputCol="score", outputCol="_bk").transform(g)
    keys = [*gcols, "_bk"]
    tot = g.groupBy(*keys).agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wg = Window.partitionBy(*gcols) if gcols else Window.partitionBy(F.lit(0))
    tot = tot.withColumns({
        "_pb": F.coalesce(F.sum("_bp").over(wg.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_nb": F.coalesce(F.sum("_bn").over(wg.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "P": F.sum("_bp").over(wg), "N": F.sum("_bn").over(wg),
    })
    j = g.join(tot.select(*keys, "_pb", "_nb", "P", "N"), keys)
    wb = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return j.select(
        *gcols, "score", "pos", "neg", "P", "N",
        (F.col("_pb") + F.coalesce(F.sum("pos").over(wb), F.lit(0))).alias("pos_below"),
        (F.col("_nb") + F.coalesce(F.sum("neg").over(wb), F.lit(0))).alias("neg_below"),
    )


def auc(df: DataFrame, label: Column, score: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """E5 exact (ties count one half), per group; NULL where a group lacks a class."""
    c = score_curve(df, label, score, group_cols)
    g = c.groupBy(*group_cols) if group_cols else c.groupBy()
    return g.agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_u"),
        F.first("P").alias("P"), F.first("N").alias("N"),
    ).select(*group_cols, "P", "N",
             F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_u") / (F.col("P") * F.col("N"))).alias("auc"))


def pr_curve(df: DataFrame, label: Column, score: Column) -> DataFrame:
    """At every distinct score ascending: precision and recall of ``score >= t``,
    then the closing point (precision 1, recall 0, no threshold)."""
    c = score_curve(df, label, score)
    tp = F.col("P") - F.col("pos_below")
    pp = (F.col("P") + F.col("N")) - (F.col("pos_below") + F.col("neg_below"))
    pts = c.select(F.col("score").alias("threshold"),
                   r6(F.when(pp > 0, tp / pp).otherwise(F.lit(0.0))).alias("precision"),
                   r6(F.when(F.col("P") > 0, tp / F.col("P")).otherwise(F.lit(0.0))).alias("recall"))
    close = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(close)


def confusion_long(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Actual x predicted over the union of classes, zero cells kept (long form)."""
    y, p = F.col(f"`{label}`").cast("string"), F.col(f"`{prediction}`").cast("string")
    counts = df.groupBy(y.alias("actual"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.col("actual").alias("c")).unionByName(counts.select(F.col("predicted").alias("c"))) \
        .agg(F.sort_array(F.collect_set("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("actual"), "cs").select("actual", F.explode("cs").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left") \
        .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """E1-E3 per class (sorted union of classes), with accuracy and support-weighted F1.

    Row and column sums of the confusion counts are all it needs: the K x K grid is never built."""
    y, p = F.col(f"`{label}`").cast("string"), F.col(f"`{prediction}`").cast("string")
    cells = df.filter(y.isNotNull() & p.isNotNull()).groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    tp = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none)
    both = long_rows(cells, [], ["class_label", "support", "n_predicted", "tp"],
                     [(F.col("y"), F.col("n"), none, tp), (F.col("p"), none, F.col("n"), none)])
    r = both.groupBy("class_label").agg(*[F.sum(c).alias(c) for c in ("support", "n_predicted", "tp")])
    prec = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    r = r.withColumns({"precision": prec, "recall": rec})
    r = r.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(F.lit(0.0)))
    w = Window.partitionBy(F.lit(0))  # over the class rows only
    out = r.withColumns({
        "accuracy": F.try_divide(F.sum("tp").over(w).cast("double"), F.sum("support").over(w)),
        "f1_weighted": F.try_divide(F.sum(F.col("support") * F.col("f1")).over(w), F.sum("support").over(w).cast("double")),
    })
    return out.select("class_label", F.col("support").cast("bigint").alias("support"),
                      F.col("n_predicted").cast("bigint").alias("n_predicted"), F.col("tp").cast("bigint").alias("tp"),
                      r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"),
                      r6(F.col("f1")).alias("f1"), r6(F.col("accuracy")).alias("accuracy"),
                      r6(F.col("f1_weighted")).alias("f1_weighted"))


def ece_bins(df: DataFrame, label: str, prob_cols: Sequence[str] | None = None, prob: str | None = None,
             classes: Sequence | None = None) -> DataFrame:
    """E8 per bin: (lo, hi] share, mean confidence, accuracy, and the total ECE.

    Binary (``prob``): predicted 1 when p >= 0.5, confidence p or 1-p.  Multiclass
    (``prob_cols`` in class order ``classes``): argmax (first on ties) and max prob.
    Bin = number of inner edges strictly below the confidence.
    """
    y = F.col(f"`{label}`")
    if prob is not None:
        p = F.col(f"`{prob}`").cast("double")
        pred = (p >= 0.5).cast("int")
        conf = F.when(pred == 1, p).otherwise(1.0 - p)
        acc = (pred == y.cast("int")).cast("double")
    else:
        ps = [F.col(f"`{c}`").cast("double") for c in prob_cols]
        conf = F.greatest(*ps)
        arg = F.lit(None)
        for k in reversed(range(len(ps))):  # first maximum wins
            arg = F.when(ps[k] == conf, F.lit(str(classes[k]))).otherwise(arg)
        acc = (arg == y.cast("string")).cast("double")
    edges = _edges_ece()
    b = sum((conf > F.lit(e)).cast("int") for e in edges[1:-1])
    # rows without a bin (confidence 0) count in the total only: bin -1, dropped after
    rows = df.select(conf.alias("conf"), acc.alias("acc"), F.when(conf > 0, b).otherwise(-1).alias("bin"))
    per = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"), F.avg("acc").alias("accuracy"))
    w = Window.partitionBy(F.lit(0))  # over at most eleven bin rows
    per = per.withColumn("share", F.col("n") / F.sum("n").over(w)).filter(F.col("bin") >= 0)
    per = per.withColumn("ece", F.sum(F.col("share") * F.abs(F.col("mean_conf") - F.col("accuracy"))).over(w))
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 2)
    return per.select(F.col("bin").cast("int").alias("bin"), r6(lo).alias("lo"), r6(hi).alias("hi"),
                      F.col("n").cast("bigint").alias("n"), r6(F.col("share")).alias("share"),
                      r6(F.col("mean_conf")).alias("mean_conf"), r6(F.col("accuracy")).alias("accuracy"),
                      r6(F.col("ece")).alias("ece"))


def erfc(x: Column) -> Column:
    """Complementary error function (Chebyshev-fitted form, fractional error < 1.2e-7)."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    # Coefficients of the fitted exponent polynomial, lowest order first.
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(2.0 - ans)


def regression_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """RMSE, MAE, R^2 (1 - SSE/SST) and the Breusch-Pagan LM statistic and p-value
    (LM = n * corr(prediction, residual^2)^2; p = erfc(sqrt(LM/2)); n < 5 or undefined -> 1)."""
    y = F.col(f"`{label}`").cast("double")
    p = F.col(f"`{prediction}`").cast("double")
    e = y - p
    agg = df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"),
        safe_corr(p, e * e).alias("bp_r"))
    lm = F.when((F.col("n") >= 5) & F.col("bp_r").isNotNull(), F.col("n") * F.col("bp_r") * F.col("bp_r"))
    r2 = F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")) \
        .otherwise(F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(
        F.col("n").cast("bigint").alias("n"), r6(F.sqrt("mse")).alias("rmse"), r6(F.col("mae")).alias("mae"),
        r6(r2).alias("r2"), r6(lm).alias("bp_lm"),
        r6(F.coalesce(erfc(F.sqrt(lm / 2.0)), F.lit(1.0))).alias("bp_p_value"))


def slices_classification(df: DataFrame, label: str, prediction: str, score: str,
                          slice_cols: Sequence[str]) -> DataFrame:
    """Per value of each slice column (n >= 10): AUC, or accuracy when the slice holds
    one class; gate >= 0.55.  One unpivot and one grouped pass for all slices."""
    long = unpivot(df.select(*slice_cols, label, prediction, score), [label, prediction, score], slice_cols,
                   name_col="slice_column", value_col="slice_value", value_type="string")
    y = F.col(f"`{label}`")
    stats = long.groupBy("slice_column", "slice_value").agg(
        F.count(F.lit(1)).alias("n"), F.avg((y == F.col(f"`{prediction}`")).cast("double")).alias("acc"),
        (F.min(y) == F.max(y)).alias("single"))
    a = auc(long, y, F.col(f"`{score}`"), ["slice_column", "slice_value"]).select("slice_column", "slice_value", "auc")
    a = a.select(F.col("slice_column").alias("_c"), F.col("slice_value").alias("_v"), "auc")
    # a missing slice value is a slice of its own, so the values meet null-safely
    j = stats.filter(F.col("n") >= SLICE_MIN_ROWS).join(
        a, (F.col("slice_column") == F.col("_c")) & F.col("slice_value").eqNullSafe(F.col("_v")), "left")
    metric = F.when(F.col("single") | F.col("auc").isNull(), "accuracy").otherwise("auc")
    val = F.when(metric == "auc", F.col("auc")).otherwise(F.col("acc"))
    return j.select("slice_column", "slice_value", F.col("n").cast("bigint").alias("n"), metric.alias("metric"),
                    r6(val).alias("score"), (val >= SLICE_GATE_AUC).alias("pass_gate"))


def slices_multiclass(df: DataFrame, label: str, prediction: str, prob_cols: dict[str, str],
                      slice_cols: Sequence[str]) -> DataFrame:
    """E13 for more than two classes: per slice (n >= 10) the mean one-vs-rest AUC; accuracy where a
    slice holds one class (metric "accuracy") or lacks one of several (the AUC is then undefined).

    ``prob_cols``: class -> its probability column.  One unpivot over slices and classes."""
    y = F.col(f"`{label}`").cast("string")
    base = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_s{i}") for i, c in enumerate(slice_cols)], y.alias("_y"),
                     (y == F.col(f"`{prediction}`").cast("string")).cast("double").alias("_hit"),
                     *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(prob_cols.values())])
    probs = [f"_p{i}" for i in range(len(prob_cols))]
    long = long_rows(base, [F.col("_y"), F.col("_hit"), *map(F.col, probs)], ["slice_column", "slice_value"],
                     [(c, F.col(f"_s{i}")) for i, c in enumerate(slice_cols)])
    keys = ["slice_column", "slice_value"]
    stats = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("acc"),
                                    (F.min("_y") == F.max("_y")).alias("single")).filter(F.col("n") >= SLICE_MIN_ROWS)
    each = long_rows(long, [F.col(k) for k in keys], ["_k", "_is", "_score"],
                     [(k, (F.col("_y") == F.lit(k)).cast("int"), F.col(p)) for k, p in zip(prob_cols, probs)])
    a = auc(each, F.col("_is"), F.col("_score"), [*keys, "_k"]).groupBy(*keys).agg(
        F.when(F.every(F.col("auc").isNotNull()), F.avg("auc")).alias("auc"))
    a = a.select(F.col("slice_column").alias("_c"), F.col("slice_value").alias("_v"), "auc")
    j = stats.join(a, (F.col("slice_column") == F.col("_c")) & F.col("slice_value").eqNullSafe(F.col("_v")), "left")
    val = F.when(F.col("single") | F.col("auc").isNull(), F.col("acc")).otherwise(F.col("auc"))
    return j.select(*keys, F.col("n").cast("bigint").alias("n"), F.when(F.col("single"), "accuracy").otherwise("auc").alias("metric"),
                    r6(val).alias("score"), (val >= SLICE_GATE_AUC).alias("pass_gate"))


def slices_regression(df: DataFrame, label: str, prediction: str, slice_cols: Sequence[str]) -> DataFrame:
    """R^2 per slice value (n >= 10); gate >= -0.5."""
    long = unpivot(df.select(*slice_cols, label, prediction), [label, prediction], slice_cols,
                   name_col="slice_column", value_col="slice_value", value_type="string")
    y, p = F.col(f"`{label}`").cast("double"), F.col(f"`{prediction}`").cast("double")
    g = long.groupBy("slice_column", "slice_value").agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    r2 = F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")) \
        .otherwise(F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.filter(F.col("n") >= SLICE_MIN_ROWS).select(
        "slice_column", "slice_value", F.col("n").cast("bigint").alias("n"), F.lit("r2").alias("metric"),
        r6(r2).alias("score"), (r2 >= SLICE_GATE_R2).alias("pass_gate"))
