"""Class balance (M5, M6, Z2), candidate eligibility (M7), dummy baselines (M1-M4) under
cross-validation with the scorer choice (T5), the baseline gate (T8) and selection (T9).

Per-fold fitting of a dummy never re-reads the data per fold: class counts, sums and
row counts are taken per fold once, and a fold's training statistic is total minus the
fold's own share.  Medians of the five training parts come from one bounded rank
selection with one masked expression per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HASH_SPACE, SEED, phash, r6
from ..functions.ranks import column_counts, exact_quantiles

# Imbalance ratio, minority share, candidate tiers and size floors.
IMBALANCE_RATIO = 10
MINORITY_SHARE = 0.10
TINY_ROWS = 100
# (name for classification, name for regression, tier, minimum rows)
CANDIDATES = [
    ("dummy_most_frequent", "dummy_mean", 0, 0),
    ("dummy_stratified", "dummy_median", 0, 0),
    ("logistic", "ridge", 1, 0),
    ("random_forest", "random_forest", 2, 200),
    ("boosted_trees", "boosted_trees", 3, 500),
]
BASELINE_REL = 1.05
BASELINE_ABS = 0.05


def scorer(problem_type: str, n_classes: int) -> str:
    """T5."""
    if problem_type == "classification":
        return "roc_auc_ovr" if n_classes > 2 else "roc_auc"
    return "r2"


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Per class: count, share and balanced weight n / (k * n_class); with the table's
    max/min ratio, the imbalance verdict (ratio > 10, two classes or more) and whether the
    smallest class is under 10 %."""
    counts = df.filter(F.col(f"`{target}`").isNotNull()) \
        .groupBy(F.col(f"`{target}`").cast("string").alias("class_label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # over the class rows only
    out = counts.withColumns({"_tot": F.sum("n").over(w), "_k": F.count(F.lit(1)).over(w),
                              "_mx": F.max("n").over(w), "_mn": F.min("n").over(w)})
    ratio = F.col("_mx") / F.col("_mn")
    return out.select(
        "class_label", F.col("n").cast("bigint").alias("n"), r6(F.col("n") / F.col("_tot")).alias("share"),
        r6(F.col("_tot") / (F.col("_k") * F.col("n"))).alias("balanced_weight"),
        r6(ratio).alias("imbalance_ratio"), ((F.col("_k") >= 2) & (ratio > IMBALANCE_RATIO)).alias("is_imbalanced"),
        (F.col("_mn") / F.col("_tot") < MINORITY_SHARE).alias("minority_under_10pct"))


def candidates(df: DataFrame, problem_type: str) -> DataFrame:
    """M7: candidate list with tier and eligibility for this table size, tier order."""
    idx = 0 if problem_type == "classification" else 1
    arr = F.array(*[F.struct(F.lit(c[idx]).alias("candidate"), F.lit(c[2]).alias("tier"),
                             F.lit(c[3]).alias("min_rows")) for c in CANDIDATES])
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    rows = n.select("n_rows", F.explode(arr).alias("c")).select("n_rows", "c.*")
    name_ok = F.col("candidate").isin(CANDIDATES[0][idx], CANDIDATES[1][idx], CANDIDATES[2][idx])
    eligible = F.when(F.col("n_rows") < TINY_ROWS, name_ok).otherwise(F.col("n_rows") >= F.col("min_rows"))
    return rows.select("candidate", F.col("tier").cast("int").alias("tier"), F.col("min_rows").cast("bigint").alias("min_rows"),
                       F.col("n_rows").cast("bigint").alias("n_rows"), eligible.alias("eligible"))


def _cv_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy("candidate").agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def dummy_cv_classification(df: DataFrame, target: str, key_cols: Sequence[str], fold_col: str,
                            rule_pred: str | None = None, k: int = 5) -> DataFrame:
    """M1, M2 (+ an optional rule candidate) scored by one-vs-rest AUC per fold."""
    y = F.col(f"`{target}`").cast("string")
    base = df.select(*key_cols, fold_col, y.alias("_y"), *([F.col(rule_pred).cast("string").alias("_rule")] if rule_pred else []))
    cnt = base.groupBy(fold_col, "_y").agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy("_y").agg(F.sum("n").alias("_ntot"))
    # training counts of fold i = all rows of the class minus those in fold i
    fold_ids = list(range(k))
    train = tot.withColumn(fold_col, F.explode(F.array(*[F.lit(i) for i in fold_ids]))) \
        .join(cnt, [fold_col, "_y"], "left") \
        .select(fold_col, "_y", (F.col("_ntot") - F.coalesce("n", F.lit(0))).alias("tn"))
    wf = Window.partitionBy(fold_col)
    train = train.withColumns({
        "_cum": F.sum("tn").over(wf.orderBy("_y").rowsBetween(Window.unboundedPreceding, 0)),
        "_tt": F.sum("tn").over(wf),
        "_best": F.first("_y").over(wf.orderBy(F.desc("tn"), "_y").rowsBetween(Window.unboundedPreceding,
                                                                                  Window.unboundedFollowing)),
    })
    per_fold = train.groupBy(fold_col).agg(
        F.first("_best").alias("_mf"),
        F.sort_array(F.collect_list(F.struct((F.col("_cum") / F.col("_tt")).alias("p"), F.col("_y").alias("c"))))
        .alias("_cdf"))
    u = phash(key_cols, SEED, df) / F.lit(float(HASH_SPACE))
    scored = base.join(per_fold, fold_col).withColumns({
        "_strat": F.filter("_cdf", lambda e: e["p"] > u)[0]["c"],
    })
    classes = [r[0] for r in tot.select("_y").orderBy("_y").collect()]  # one row per class
    preds = {"dummy_most_frequent": None, "dummy_stratified": "_strat"}
    if rule_pred:
        preds["rule_model"] = "_rule"
    fold_scores = hard_vote_auc(scored, fold_col, "_y", preds, classes)
    scorer_name = scorer("classification", len(classes))
    return _cv_summary(fold_scores).withColumn("scorer", F.lit(scorer_name))


def hard_vote_auc(scored: DataFrame, fold_col: str, y: str, preds: dict, classes: Sequence) -> DataFrame:
    """Macro one-vs-rest AUC per (fold, candidate) for candidates whose class scores are
    one-hot votes (or constant: ``None``), from a per-fold confusion table.

    For class c with score 1 on rows voted c: AUC = a(1-b) + (ab + (1-a)(1-b))/2 with
    a = share of c's rows voted c and b = share of the other rows voted c (ties count
    one half); a constant score gives 1/2.  No row is multiplied by classes or candidates.
    """
    parts = []
    for name, col in preds.items():
        if col is None:
            parts.append(scored.groupBy(fold_col).agg(F.lit(name).alias("candidate"), F.lit(0.5).alias("score")))
            continue
        cm = scored.groupBy(fold_col, F.col(y).alias("_a"), F.col(col).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
        rows = []
        for c in classes:
            pos = F.col("_a") == F.lit(c)
            hit = F.col("_p") == F.lit(c)
            rows.append(F.struct(F.lit(c).alias("k"), pos.alias("pos"), hit.alias("hit"), F.col("n").alias("n")))
        per = cm.select(fold_col, F.explode(F.array(*rows)).alias("r")).select(fold_col, "r.*") \
            .groupBy(fold_col, "k").agg(
                F.sum(F.when(F.col("pos"), F.col("n"))).alias("P"), F.sum(F.when(~F.col("pos"), F.col("n"))).alias("N"),
                F.sum(F.when(F.col("pos") & F.col("hit"), F.col("n"))).alias("tp"),
                F.sum(F.when(~F.col("pos") & F.col("hit"), F.col("n"))).alias("fp"))
        a = F.coalesce(F.col("tp"), F.lit(0)) / F.col("P")
        b = F.coalesce(F.col("fp"), F.lit(0)) / F.col("N")
        auc_k = F.when((F.col("P") > 0) & (F.col("N") > 0), a * (1 - b) + (a * b + (1 - a) * (1 - b)) / 2)
        parts.append(per.groupBy(fold_col).agg(
            F.lit(name).alias("candidate"),
            F.when(F.every(auc_k.isNotNull()), F.avg(auc_k)).otherwise(F.lit(0.5)).alias("score")))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def dummy_cv_regression(df: DataFrame, target: str, fold_col: str, rule_pred: str | None = None,
                        k: int = 5) -> DataFrame:
    """M3, M4 (+ an optional rule candidate) scored by R^2 per fold."""
    y = F.col(f"`{target}`").cast("double")
    sums = df.groupBy(fold_col).agg(F.count(y).alias("n"), F.sum(y).alias("s"))
    tot = sums.agg(F.sum("n").alias("N"), F.sum("s").alias("S")).first()
    fold_ids = sorted(r[0] for r in sums.select(fold_col).collect())  # k rows
    med_exprs = {str(i): F.when(F.col(fold_col) != F.lit(i), y) for i in fold_ids}
    med = exact_quantiles(df, med_exprs, [0.5], counts=column_counts(df, med_exprs))
    fit = sums.select(fold_col, ((F.lit(tot["S"]) - F.col("s")) / (F.lit(tot["N"]) - F.col("n"))).alias("_mean"))
    med_map = F.create_map(*[x for i in fold_ids for x in (F.lit(i), F.lit(med[(str(i), 0.5)]))])
    d = df.select(fold_col, y.alias("_y"), *([F.col(rule_pred).cast("double").alias("_rule")] if rule_pred else [])) \
        .join(fit, fold_col).withColumn("_median", med_map[F.col(fold_col)])
    preds = {"dummy_mean": "_mean", "dummy_median": "_median"}
    if rule_pred:
        preds["rule_model"] = "_rule"
    long = d.select(fold_col, "_y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("candidate"), F.col(c).alias("p")) for n, c in preds.items()])).alias("r")) \
        .select(fold_col, "_y", "r.*")
    g = long.groupBy(fold_col, "candidate").agg(
        F.sum((F.col("_y") - F.col("p")) ** 2).alias("sse"), (F.var_pop("_y") * F.count("_y")).alias("sst"))
    score = F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return _cv_summary(g.select(fold_col, "candidate", score.alias("score"))).withColumn("scorer", F.lit("r2"))


def baseline_gate(cv: DataFrame, problem_type: str) -> DataFrame:
    """T8 + T9 over candidate rows (candidate, cv_mean, cv_std): best dummy d; a real
    candidate passes with > 1.05 d (classification) or > max(d + 0.05, 0.05); the selected
    one is the best passing candidate, else the best of all (gate false)."""
    is_dummy = F.col("candidate").startswith("dummy")
    w = Window.partitionBy(F.lit(0))  # over the few candidate rows
    c = cv.withColumn("is_dummy", is_dummy).withColumn("_d", F.max(F.when(is_dummy, F.col("cv_mean"))).over(w))
    d = F.coalesce(F.col("_d"), F.lit(0.0))
    need = d * BASELINE_REL if problem_type != "regression" else F.greatest(d + BASELINE_ABS, F.lit(BASELINE_ABS))
    c = c.withColumn("beats_baseline", ~F.col("is_dummy") & (F.col("cv_mean") > need))
    c = c.withColumn("_any", F.max(F.col("beats_baseline").cast("int")).over(w) == 1)
    # one winner: the highest mean, ties to the first name
    order = F.struct((-F.col("cv_mean")).alias("m"), F.col("candidate").alias("c"))
    best = F.min(F.when(F.col("beats_baseline") | ~F.col("_any"), order)).over(w)
    sel = F.col("candidate") == best["c"]
    return c.select("candidate", "scorer", r6(F.col("cv_mean")).alias("cv_mean"), r6(F.col("cv_std")).alias("cv_std"),
                    "is_dummy", "beats_baseline", sel.alias("selected"))
