"""Model candidates on ``pyspark.ml`` (M8-M10), cross-validation with preprocessing inside
every fold (T6), grid tuning (T7), final importances (T10) and
sampled Shapley attributions (H2, H3).

The training table is read once and pinned with its fold column, over as many tasks as its rows keep busy;
every fold refits the preparation (``prep.fit_parts``, all folds in the same passes), the encoder and the
model on the other folds, and so does the final fit.
Scores are exact: AUC through ``evaluate.auc`` (no binning), R^2 as 1 - SSE/SST.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions.materialize import pin, spread
from . import prep
from .evaluate import auc
from .explain import DOMINANT_SHARE

# The candidate grids and budgets.
LOGISTIC_C = [0.01, 0.1, 1.0, 10.0]
RIDGE_ALPHA = [0.01, 0.1, 1.0, 10.0]
FOREST_TREES = [100, 200, 500]
FOREST_DEPTH = [None, 10, 20]
BOOST_ROUNDS = [100, 300, 500]
BOOST_RATE = [0.01, 0.1, 0.3]
MAX_ITER = 1000
SPARK_MAX_DEPTH = 30          # "no limit" becomes Spark's deepest allowed tree
BACKGROUND_ROWS = 20
SHAPLEY_PERMUTATIONS = 8
FIT_PARALLELISM = 5
#: Training rows that one task of a tree fit takes at most: a forest keeps some 600 bytes of each.
MOST_ROWS = 500_000


def estimator(name: str, task: str, n_rows: int, params: dict | None = None, n_classes: int = 2,
              weight_col: str | None = None, label_std: float | None = None):
    """M8-M10 with the reference's parameter meaning mapped onto Spark's."""
    p = dict(params or {})
    if name == "logistic":
        c = p.get("C", 1.0)
        kw = dict(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False,
                  maxIter=MAX_ITER, featuresCol="features", labelCol="label")
        if weight_col:
            kw["weightCol"] = weight_col
        return LogisticRegression(**kw)
    if name == "ridge":
        a = p.get("alpha", 1.0)
        # Spark scales the penalty by the label's deviation; this makes it the closed-form ridge
        return LinearRegression(regParam=a * (label_std or 1.0) / max(n_rows, 1), elasticNetParam=0.0,
                                standardization=False, solver="normal", featuresCol="features", labelCol="label")
    if name == "random_forest":
        depth = p.get("max_depth") or SPARK_MAX_DEPTH
        cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return cls(numTrees=p.get("n_estimators", 100), maxDepth=depth, seed=42, featuresCol="features",
                   labelCol="label")
    if name == "boosted_trees":
        kw = dict(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1), seed=42,
                  featuresCol="features", labelCol="label")
        if task != "classification":
            return GBTRegressor(**kw)
        if n_classes <= 2:
            return GBTClassifier(**kw)
        return OneVsRest(classifier=GBTClassifier(**kw), featuresCol="features", labelCol="label")
    raise ValueError(f"unknown candidate {name}")


def most_rows(name: str) -> int | None:
    return MOST_ROWS if name in ("random_forest", "boosted_trees") else None


def _score(pred: DataFrame, task: str, n_classes: int) -> DataFrame:
    """Exact per-fold score: AUC (binary), macro one-vs-rest AUC, or R^2."""
    if task == "classification":
        probs = vector_to_array(F.col("probability")) if "probability" in pred.columns else None
        if probs is None:  # one-vs-rest without probabilities: hard votes as scores
            probs = F.array(*[(F.col("prediction") == k).cast("double") for k in range(n_classes)])
        classes = list(range(n_classes)) if n_classes > 2 else [1]
        pred = pin(pred.select("fold", "label", probs.alias("_s")))  # read several times, predicted once
        long = pred.select("fold", F.explode(F.array(*[
            F.struct(F.lit(k).alias("k"), (F.col("label") == k).cast("int").alias("y"), F.col("_s")[k].alias("s"))
            for k in classes])).alias("r")).select("fold", "r.*")
        a = auc(long, F.col("y"), F.col("s"), ["fold", "k"])
        return a.groupBy("fold").agg(F.when(F.every(F.col("auc").isNotNull()), F.avg("auc"))
                                     .otherwise(F.lit(0.5)).alias("score"))
    e = F.col("label") - F.col("prediction")
    g = pred.groupBy("fold").agg(F.sum(e * e).alias("sse"), (F.var_pop("label") * F.count("label")).alias("sst"))
    return g.select("fold", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(F.lit(0.0)).alias("score"))


class NominalAttribute:
    """Marks the label column as having ``n`` classes, also where a training part lacks some of them."""

    def __init__(self, n: int):
        self.meta = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": n}}

    def mark(self, df: DataFrame) -> DataFrame:
        return df.withMetadata("label", self.meta)


def labelled(df: DataFrame, target: str, task: str) -> DataFrame:
    """The table with the numeric column ``label``: the class's place in alphabetical order, or the value."""
    if task != "classification":
        return df.withColumn("label", F.col(f"`{target}`").cast("double"))
    return StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(df).transform(df)


@dataclass
class Part:
    """A fold's training part: which rows, their number, the label's deviation or the classes' counts, the preparation."""
    fold: int
    inside: Column
    n: int
    label_std: float | None
    classes: dict
    plan: prep.PrepModel


@dataclass
class Folded:
    """A pinned, labelled table with the training part of each fold."""
    data: DataFrame
    n_classes: int
    parts: list[Part]


def fit_folds(folded: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], task: str, k: int = 5,
              pinned: bool = False, time_ordered: bool = False, most: int | None = None) -> Folded:
    """What a fold's fits need besides the model, for all folds in the passes that one fold takes.

    The training part is all other folds; with ``time_ordered`` only earlier ones (a model never sees the
    future).  Labels are indexed once over the whole table, so a class that only one fold holds is known to
    all; rows without a label take no part.  ``most`` limits the rows that a task reads."""
    if not pinned:
        # read once, survives executor loss (reliable checkpoint)
        folded = spread(pin(labelled(folded.filter(F.col(f"`{target}`").isNotNull()), target, task)), most)
    inside = [F.col("fold") < i if time_ordered else F.col("fold") != i for i in range(k)]
    seen = folded.agg(F.max("label").alias("top"), *[F.count_if(p).alias(f"n{i}") for i, p in enumerate(inside)],
                      *[F.stddev_pop(F.when(p, F.col("label"))).alias(f"sd{i}") for i, p in enumerate(inside)]).first()
    counts = []
    if task == "classification":  # one row per class
        counts = folded.groupBy(F.col(f"`{target}`")).agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(inside)]).collect()
    plans = prep.fit_parts(folded, inside, numeric, categorical)
    return Folded(folded, int(seen["top"] or 0) + 1 if task == "classification" else 0, [
        Part(i, p, seen[f"n{i}"], seen[f"sd{i}"], {r[0]: r[f"n{i}"] for r in counts if r[f"n{i}"]}, plans[i])
        for i, p in enumerate(inside)])


def fold_scores(folded: DataFrame | Folded, target: str, numeric: Sequence[str], categorical: Sequence[str],
                name: str, task: str, params: dict | None = None, k: int = 5, pinned: bool = False,
                time_ordered: bool = False) -> DataFrame:
    """(candidate, fold, score): per fold, fit preparation (X5-X12) and model on the training part, score the fold.

    ``folded`` carries an integer ``fold`` column (from ``operators.folds``), or is what ``fit_folds``
    made of it: the preparations are then fitted already, for all candidates that share them."""
    if not isinstance(folded, Folded):
        folded = fit_folds(folded, target, numeric, categorical, task, k, pinned, time_ordered, most_rows(name))
    data, n_classes = folded.data, folded.n_classes

    def fit_fold(part: Part) -> DataFrame:
        plan = part.plan
        carry = ["fold", "label", *([target] if task == "classification" else [])]
        train = prep.transform(data.filter(part.inside), plan, carry)
        test = prep.transform(data.filter(F.col("fold") == part.fold), plan, carry)
        if task == "classification":  # the label's classes are those of the whole table
            classes = NominalAttribute(n_classes)
            train, test = classes.mark(train), classes.mark(test)
        weight_col = None
        if task == "classification" and name == "logistic":
            # M6: balanced class weights n / (k * n_class) from this fold's training rows
            tot, kk = sum(part.classes.values()), len(part.classes)
            wmap = F.create_map(*[x for c, m in part.classes.items() for x in (F.lit(c), F.lit(tot / (kk * m)))])
            train = train.withColumn("_w", wmap[F.col(target)])
            weight_col = "_w"
        est = estimator(name, task, part.n, params, n_classes, weight_col=weight_col,
                        label_std=None if task == "classification" else part.label_std)
        out = Pipeline(stages=[*prep.feature_stages(plan), est]).fit(train).transform(test)
        keep = ["probability"] if task == "classification" and "probability" in out.columns else []
        return out.select("fold", "label", "prediction", *keep)

    # the k fits are independent Spark jobs: submit them together (CrossValidator's
    # parallelism), the scheduler interleaves their stages on the executors
    with ThreadPoolExecutor(max_workers=min(len(folded.parts), FIT_PARALLELISM)) as pool:
        scores = list(pool.map(fit_fold, folded.parts))
    pred = scores[0]
    for s in scores[1:]:
        pred = pred.unionByName(s)
    per_fold = _score(pred, task, max(n_classes, 2))
    return per_fold.select(F.lit(name).alias("candidate"), F.col("fold").cast("int").alias("fold"), "score")


def cross_validate(folded: DataFrame | Folded, target: str, numeric: Sequence[str], categorical: Sequence[str],
                   name: str, task: str, params: dict | None = None, k: int = 5, pinned: bool = False,
                   time_ordered: bool = False) -> DataFrame:
    """Every fold's score with the candidate's mean and population deviation, rounded for show."""
    out = fold_scores(folded, target, numeric, categorical, name, task, params, k, pinned, time_ordered)
    w = Window.partitionBy("candidate")  # over k fold rows
    return out.select("candidate", "fold", r6(F.col("score")).alias("score"),
                      r6(F.avg("score").over(w)).alias("cv_mean"), r6(F.stddev_pop("score").over(w)).alias("cv_std"))


def grid(name: str) -> list[dict]:
    """Exhaustive grids (4, 9 and 9 points; 30 sampled trials never exceed them)."""
    if name == "logistic":
        return [{"C": c} for c in LOGISTIC_C]
    if name == "ridge":
        return [{"alpha": a} for a in RIDGE_ALPHA]
    if name == "random_forest":
        return [{"n_estimators": t, "max_depth": d} for t in FOREST_TREES for d in FOREST_DEPTH]
    if name == "boosted_trees":
        return [{"n_estimators": t, "learning_rate": r} for t in BOOST_ROUNDS for r in BOOST_RATE]
    return [{}]


def tune(folded: DataFrame, target: str, numeric, categorical, name: str, task: str,
         points: Sequence[dict] | None = None, time_ordered: bool = False) -> DataFrame:
    """Cross-validated mean score per grid point; ``best`` marks the maximum (R^2 is
    maximised too)."""
    rows = []
    data = fit_folds(folded, target, numeric, categorical, task, time_ordered=time_ordered, most=most_rows(name))  # serves every grid point
    for i, p in enumerate(points or grid(name)):
        cv = cross_validate(data, target, numeric, categorical, name, task, p)
        rows.append(cv.groupBy("candidate").agg(F.first("cv_mean").alias("cv_mean"), F.first("cv_std").alias("cv_std"))
                    .withColumn("params", F.lit(str(p))).withColumn("point", F.lit(i)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    w = Window.partitionBy("candidate")
    # one winner: the highest mean, ties to the earlier grid point
    best = F.min(F.struct((-F.col("cv_mean")).alias("m"), F.col("point").alias("p"))).over(w)
    return out.withColumn("best", F.col("point") == best["p"])


@dataclass
class FinalModel:
    """The preparation (X5-X12) and the model, both fitted on the whole training split."""
    plan: prep.PrepModel
    pipeline: PipelineModel
    inputs: list[str]
    names: list[str]  # of the vector's slots: numbers, then a slot for each category
    classes: list[str] = field(default_factory=list)  # of a classifier, in order of their index

    @property
    def estimator(self):
        return self.pipeline.stages[-1]

    def prepared(self, df: DataFrame) -> DataFrame:
        """The columns that are no inputs, and the assembled vector ``features``."""
        keep = [c for c in df.columns if c not in self.inputs]
        return PipelineModel(self.pipeline.stages[:-1]).transform(prep.transform(df, self.plan, keep))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.estimator.transform(self.prepared(df))


def fit_final(train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], name: str, task: str,
              params: dict | None = None) -> FinalModel:
    """Refit on the training split with the preparation that cross-validation uses.

    Rows without a target take no part.  Logistic models weigh classes as in T6 (M6)."""
    train = labelled(train.filter(F.col(f"`{target}`").isNotNull()), target, task)
    classes = train.schema["label"].metadata.get("ml_attr", {}).get("vals", [])
    plan = prep.fit_prep(train, numeric, categorical)
    data = spread(pin(prep.transform(train, plan, ["label"])), most_rows(name))
    seen = data.agg(F.count("label").alias("n"), F.max("label").alias("top"), F.stddev_pop("label").alias("sd")).first()
    n_classes = int(seen["top"] or 0) + 1 if task == "classification" else 0
    weight_col = None
    if task == "classification":
        data = NominalAttribute(n_classes).mark(data)
        if name == "logistic":
            of_class = data.groupBy("label").agg(F.count(F.lit(1)).alias("_k"))
            weight = F.lit(float(seen["n"])) / (F.lit(float(of_class.count())) * F.col("_k"))
            data, weight_col = data.join(F.broadcast(of_class), "label").withColumn("_w", weight), "_w"
            data = NominalAttribute(n_classes).mark(data)
    est = estimator(name, task, seen["n"], params, n_classes, weight_col, None if task == "classification" else seen["sd"])
    pipeline = Pipeline(stages=[*prep.feature_stages(plan), est]).fit(data)
    names = prep.numeric_features(plan)
    for stage in pipeline.stages:
        if isinstance(stage, StringIndexerModel):
            names += [f"{c}_{v}" for c, labels in zip(plan.categorical, stage.labelsArray) for v in labels]
    return FinalModel(plan, pipeline, [*numeric, *categorical], names, classes)


def importances(model: FinalModel) -> list[tuple[str, float]]:
    """Model importances, else mean |coefficient|, else equal shares; one entry for each slot."""
    est = model.estimator
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficientMatrix"):
        m = est.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    elif hasattr(est, "coefficients"):
        vals = [abs(v) for v in est.coefficients.toArray().tolist()]
    else:
        vals = [1.0 / len(model.names)] * len(model.names)
    return list(zip(model.names, vals))


def importance_rows(spark: SparkSession, rows: Sequence[tuple[str, float]]) -> DataFrame:
    """(feature, importance, share, is_dominant) of the model's slots."""
    total = sum(v for _, v in rows)
    share = [v / total if total else 0.0 for _, v in rows]
    out = spark.createDataFrame([(f, v, s, s > DOMINANT_SHARE) for (f, v), s in zip(rows, share)],
                                "feature string, importance double, share double, is_dominant boolean")
    return out.withColumns({"importance": r6(F.col("importance")), "share": r6(F.col("share"))})


def sampled_shapley(model, explain: DataFrame, background: DataFrame, features: Sequence[str], key: str, output: str,
                    permutations: int = SHAPLEY_PERMUTATIONS, seed: int = 42,
                    max_background: int = BACKGROUND_ROWS) -> DataFrame:
    """H2/H3: Monte-Carlo Shapley values (``attribution`` has the exact ones): a feature's mean marginal gain over
    background rows x permutations.  Every row of ``explain`` is explained; ``background`` is the caller's draw
    of at most ``max_background`` rows, and refused beyond.

    Permutations share their prefixes, so the model scores each of a row's coalitions once for each background
    row, all features known once for each row, and none known once in all.  A coalition carries how often a
    feature's gain ends at it, less how often it begins there, and the values are one sum by ``key``."""
    k = len(features)
    x = explain.select(F.col(key).alias("_key"), *[F.col(f).alias(f"x_{f}") for f in features])
    # the background travels as a literal array: each explained row explodes it, no join
    bg = background.select(*features).limit(max_background + 1).collect()
    if len(bg) > max_background:
        raise ValueError(f"the background has more than {max_background} rows")
    if not bg:
        raise ValueError("the background is empty")
    kinds = {f: explain.schema[f].dataType for f in features}
    b_arr = F.array(*[F.struct(*[F.lit(r[f]).cast(kinds[f]).alias(f"b_{f}") for f in features]) for r in bg])
    nothing = explain.sparkSession.createDataFrame([tuple(r) for r in bg], background.select(*features).schema)
    f_none = model.transform(nothing.withColumn("_key", F.lit(0))).agg(F.avg(F.col(output).cast("double"))).first()[0]
    # a seeded permutation per (row, draw): sort feature indices by a hash of (key, draw, index)
    index = F.sequence(F.lit(0), F.lit(k - 1))
    perms = F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda p: F.transform(F.array_sort(F.transform(
        index, lambda j: F.struct(F.xxhash64(F.col("_key"), p, j, F.lit(seed)).alias("h"), j.alias("j")))), lambda s: s["j"]))
    # the prefixes: the features known, the one that came last and the one that comes next (none: -1)
    ways = F.flatten(F.transform(F.col("_perms"), lambda perm: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda step: F.struct(
        F.transform(index, lambda j: F.array_position(perm, j) <= step).alias("known"),
        F.element_at(perm, step).alias("last"),
        F.when(step < k, F.get(perm, step)).otherwise(-1).alias("next")))))
    weights = F.transform(F.array_distinct(F.col("_ways.known")), lambda known: F.struct(known.alias("known"), F.transform(
        index, lambda j: F.aggregate(F.filter("_ways", lambda w: w["known"] == known), F.lit(0), lambda n, w:
                                     n + F.when(w["last"] == j, 1).when(w["next"] == j, -1).otherwise(0))).alias("weight")))
    full = F.forall("_c.known", lambda known: known)
    firsts = F.transform(index, lambda j: F.size(F.filter("_perms", lambda perm: F.get(perm, F.lit(0)) == j)))
    rows = x.withColumn("_perms", perms).withColumn("_ways", ways).select(
        "*", F.explode(weights).alias("_c")).withColumn("_full", full)
    rows = rows.withColumn("_bg", F.explode(F.when(F.col("_full"), F.slice(b_arr, 1, 1)).otherwise(b_arr)))
    pts = rows.select("_key", "_full", F.col("_c.weight").alias("_weight"), F.when(F.col("_full"), firsts).alias("_firsts"), *[
        F.when(F.get("_c.known", F.lit(j)), F.col(f"x_{f}")).otherwise(F.col("_bg")[f"b_{f}"]).alias(f) for j, f in enumerate(features)])
    scored = model.transform(pts).select("_key", "_full", "_weight", "_firsts", F.col(output).cast("double").alias("_f"))
    # the outputs of a coalition count by its share of the background
    share = F.when(F.col("_full"), F.lit(1.0)).otherwise(1.0 / len(bg)) * F.col("_f")
    gain = [F.sum(F.get("_weight", F.lit(j)) * share) - F.sum(F.get("_firsts", F.lit(j))) * F.lit(f_none) for j in range(k)]
    n = F.count_if("_full")  # rows of the key: one, else the mean gain is once more shared among them
    sums = scored.groupBy("_key").agg(*[(g / (permutations * n * n)).alias(f"_p{j}") for j, g in enumerate(gain)])
    out = F.array(*[F.struct(F.lit(f).alias("feature"), r6(F.col(f"_p{j}")).alias("shap")) for j, f in enumerate(features)])
    return sums.select(F.col("_key").alias(key), F.inline(out)).withColumn("shap", F.col("shap") + F.lit(0.0))  # no -0
