"""From a table to a verdict: framing, drop set, split, cross-validated candidates against the best dummy, the
selected model's holdout metrics, slices, importances, correlated pairs, flags, gate and next step (R12-R25).

Every number that a rule reads comes from the steps before it: the baseline is the best dummy under the same
folds (T8), the importances are the fitted model's (T10).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric_type
from ..functions.materialize import pin, spread
from . import baselines, evaluate, explain, folds, models, prep, risk, sessions


@dataclass
class Verdict:
    """What the chain found: candidate rows, the metric row, flags, the gate's row and the selected candidate."""
    candidates: DataFrame
    selected: str
    metrics: DataFrame
    flags: DataFrame
    gate: DataFrame

    def next_steps(self, retries: Sequence[int] = (0,)) -> DataFrame:
        """(retries, next_step) after evaluation."""
        gate = self.gate.select(F.lit(0).alias("_session"), "pass_gate", "halt", F.explode(F.array(*map(F.lit, retries))).alias("retries"))
        marked = self.flags.withColumn("_session", F.lit(0))
        return sessions.route_after_eval(gate, marked, "_session", "retries").select("retries", "next_step")


def _holdout(model: models.FinalModel, test: DataFrame, target: str, task: str) -> DataFrame:
    out = model.transform(test)
    if task == "regression":
        return out.withColumnRenamed("prediction", "_pred").withColumn("_y", F.col(f"`{target}`").cast("double"))
    labels = F.array(*[F.lit(x) for x in model.classes])
    out = out.withColumns({"_pred": F.get(labels, F.col("prediction").cast("int")), "_y": F.col(f"`{target}`").cast("string")})
    return out.withColumn("_p", vector_to_array("probability"))


def run(df: DataFrame, target: str, task: str, key_cols: Sequence[str], candidates: dict[str, dict], slice_cols: Sequence[str] = (),
        features: Sequence[str] | None = None, hash_cols: Sequence[str] | None = None) -> Verdict:
    """Run the chain.  ``candidates`` maps a model's name to its parameters.

    Features are those that framing leaves (no id-like or leaking column) unless named.  Rows without a
    target take no part.  Classification is binary here; its positive class is the last in order."""
    keys = list(key_cols)
    if features is None:
        _, left = prep.id_like_and_drop(df.drop(*[k for k in keys if k != target]), target)
        features = [c for c in left if c not in slice_cols]
    features = list(features)
    numeric = [c for c in features if is_numeric_type(df.schema[c].dataType)]
    categorical = [c for c in features if c not in numeric]
    rows = df.filter(F.col(f"`{target}`").isNotNull()).select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*keys, target, *features, *slice_cols])])
    split = folds.random_split(rows, keys, hash_cols=hash_cols) if task == "regression" else \
        folds.stratified_split(rows, target, keys, hash_cols=hash_cols)
    split = spread(pin(split))
    train, test = (split.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    # with the label of the fits, so that they needn't write the table once more
    folded = pin(models.labelled(folds.kfold(train, keys, hash_cols=hash_cols), target, task) if task == "regression" else
                 folds.stratified_kfold(train, target, keys))
    parts = models.fit_folds(folded, target, numeric, categorical, task, pinned=task == "regression")
    if task == "regression":
        cv = baselines.dummy_cv_regression(folded, target, "fold")
    else:
        cv = baselines.dummy_cv_classification(folded, target, keys, "fold")
    scorer = cv.select("scorer").first()[0]
    real = [models.fold_scores(parts, target, numeric, categorical, name, task, p).groupBy("candidate").agg(
        F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std")) for name, p in candidates.items()]
    cv = pin(reduce(DataFrame.unionByName, real, cv.select("candidate", "cv_mean", "cv_std")).withColumn("scorer", F.lit(scorer)))
    ranked = pin(baselines.baseline_gate(cv, task))
    # the best real candidate is fitted; where it doesn't beat the best dummy, the gate halts
    exact = cv.join(ranked.select("candidate", "is_dummy", "beats_baseline"), "candidate")
    name = exact.filter("NOT is_dummy").orderBy(F.desc("cv_mean"), "candidate").first()["candidate"]  # a row a candidate
    final = models.fit_final(train, target, numeric, categorical, name, task, candidates[name])
    held = pin(_holdout(final, test, target, task))
    m = risk.metric
    if task == "regression":
        e = F.col("_y") - F.col("_pred")
        sst = F.var_pop("_y") * F.count("_y")
        hold = held.agg(F.when(sst > 0, 1 - F.sum(e * e) / sst).otherwise(0.0).alias("h"))
        slices = evaluate.slices_regression(held, "_y", "_pred", list(slice_cols)) if slice_cols else None
        ece = held.agg(F.lit(None).cast("double").alias("e"))
    else:
        last = final.classes[-1]
        scored = held.withColumns({"_is": (F.col("_y") == F.lit(last)).cast("int"), "_score": F.element_at("_p", -1)})
        scored = scored.withColumn("_hit", (F.col("_pred") == F.lit(last)).cast("int"))
        hold = evaluate.auc(scored, F.col("_is"), F.col("_score")).select(F.col("auc").alias("h"))
        slices = evaluate.slices_classification(scored, "_is", "_hit", "_score", list(slice_cols)) if slice_cols else None
        ece = evaluate.ece_bins(scored, "_is", prob="_score").agg(F.first("ece").alias("e"))
    imp = models.importance_rows(df.sparkSession, models.importances(final)).agg(
        F.max("share").alias("s"), F.max_by("feature", F.struct("share", F.col("feature"))).alias("f"))
    pairs = explain.correlated_pairs(train, numeric).filter("above_limit").agg(
        F.count(F.lit(1)).alias("k"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "pair_index", F.concat_ws("~", "feature_a", "feature_b").alias("p")))), lambda x: x["p"]), ", ").alias("names"))
    own = exact.filter(F.col("candidate") == name)
    found = {
        "cv_mean": m(own, "cv_mean", F.col("cv_mean")), "cv_std": m(own, "cv_std", F.col("cv_std")),
        "beats_baseline": m(own, "beats_baseline", F.col("beats_baseline").cast("double")),
        "holdout": m(hold, "holdout", F.col("h")), "ece": m(ece, "ece", F.col("e")),
        "dominant_share": m(imp, "dominant_share", F.col("s"), F.col("f")),
        "correlated_pairs": m(pairs, "correlated_pairs", F.col("k"), F.col("names")),
    }
    if slices is not None:
        failed = slices.filter(~F.col("pass_gate")).agg(
            F.count(F.lit(1)).alias("k"), F.concat_ws(", ", F.sort_array(F.collect_list(F.concat_ws("=", "slice_column", "slice_value")))).alias("names"))
        found["failed_slices"] = m(failed, "failed_slices", F.col("k"), F.col("names"))
    else:
        found["failed_slices"] = m(own, "failed_slices", F.lit(0.0), F.lit(""))
    metrics = pin(risk.metrics_row(found))
    return Verdict(ranked, name, metrics, risk.post_training_flags(metrics, task), risk.pass_gate(metrics, task))
