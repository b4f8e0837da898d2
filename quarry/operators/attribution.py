"""Attributions of fitted models without sampling: exact for trees (H2), weighted coalitions for any model (H3).

Trees.  A saved tree is a table of nodes; each leaf becomes one row of a table of paths.  Along a leaf's
path every feature has one condition (an interval, or a set of categories) and one share: the part of the
training rows that goes the path's way at that feature's nodes.  With o_j = 1 where a row meets the condition
and z_j the share, a leaf is worth value * prod(o_j for known j) * prod(z_j for the others), and its Shapley
values follow from the symmetric sums of that product, whatever the row.  Rows that meet the same conditions
of a leaf have the same values there, so each pattern is computed once in a batch; and rows between the same
thresholds of the whole model (a cell) have the same attributions, so each cell is computed once in a batch.

Other models.  All coalitions of the features (or a seeded draw where there are too many) form one
weighted least-squares problem whose left side doesn't depend on the row: it is solved once, and a row's
attributions are a matrix product of its coalition means over the background.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_path

# Fixed value: the largest background of the kernel attribution.
BACKGROUND_ROWS = 20
#: Features up to which every coalition is weighed; beyond, MAX_COALITIONS are drawn in pairs.
ALL_COALITIONS = 11
MAX_COALITIONS = 2048
#: Rows explained at a time in a task, and numbers of the rows that a task looks through for equal cells.
ROWS = 4096
LOOK_THROUGH = 1 << 22


@dataclass
class Condition:
    """What a path asks of one feature, and the share of training rows that met it."""
    low: float = -math.inf  # exclusive
    high: float = math.inf  # inclusive
    allowed: frozenset | None = None
    share: float = 1.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        if self.allowed is not None:
            return np.isin(x, list(self.allowed))
        above = ~(x <= self.low) | (self.low == -math.inf)
        return above & ((x <= self.high) | (self.high == math.inf))  # NaN goes right, as in the trees


@dataclass
class Path:
    """A leaf: its weighted value and the condition of each feature on the way."""
    value: float
    features: list[int]
    conditions: list[Condition]


def tree_nodes(model) -> DataFrame:
    """The nodes of a fitted tree or ensemble, read from the model's own saved form in the shared folder."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").select(
            F.col("_1").alias("tree"), F.col("_3").alias("weight"))
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*").join(F.broadcast(weights), "tree")
    else:
        nodes = nodes.withColumns({"tree": F.lit(0), "weight": F.lit(1.0)})
    return nodes.select("tree", "weight", "id", "prediction", "impurityStats", "leftChild", "rightChild",
                        F.col("split.featureIndex").alias("feature"),
                        F.col("split.leftCategoriesOrThreshold").alias("left_of"),
                        F.col("split.numCategories").alias("categories"))


def tree_paths(model, class_index: int | None = None) -> list[Path]:
    """The leaves of all trees.  They are as many as the model, which lives on the driver, has.

    A classification forest is explained by the probability of ``class_index`` (the last class by
    default), boosted trees by their margin, regression by the prediction."""
    kind = type(model).__name__
    forest = kind.startswith("RandomForest")
    by_class = kind.endswith("ClassificationModel") and not kind.startswith("GBT")
    trees: dict[int, dict[int, object]] = {}
    for r in tree_nodes(model).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r

    def cover(r) -> float:
        return sum(r["impurityStats"]) if by_class else r["impurityStats"][0]

    paths: list[Path] = []
    for nodes in trees.values():
        stack: list[tuple[int, dict[int, Condition]]] = [(0, {})]
        while stack:
            at, way = stack.pop()
            r = nodes[at]
            if r["leftChild"] < 0:
                value = r["prediction"]
                if by_class:
                    stats = r["impurityStats"]
                    value = stats[-1 if class_index is None else class_index] / (sum(stats) or 1.0)
                scale = 1.0 / len(trees) if forest else r["weight"]
                paths.append(Path(value * scale, sorted(way), [way[f] for f in sorted(way)]))
                continue
            f, edge, n_categories = r["feature"], list(r["left_of"]), r["categories"]
            for child, left in ((r["leftChild"], True), (r["rightChild"], False)):
                old = way.get(f, Condition())
                new = Condition(old.low, old.high, old.allowed, old.share * cover(nodes[child]) / cover(r))
                if n_categories >= 0:
                    every = old.allowed if old.allowed is not None else frozenset(map(float, range(n_categories)))
                    new.allowed = every & set(edge) if left else every - set(edge)
                elif left:
                    new.high = min(old.high, edge[0])
                else:
                    new.low = max(old.low, edge[0])
                stack.append((child, {**way, f: new}))
    return paths


def expected_value(paths: Sequence[Path]) -> float:
    """The model's mean over its own training rows: every leaf by its share."""
    return sum(p.value * math.prod(c.share for c in p.conditions) for p in paths)


def _pattern_values(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the game prod(met_j over known j) * prod(share_j over the others), for rows of ``met``.

    For feature j: (met_j - share_j) * sum over k of k! (d-1-k)! / d! times the sum, over sets of k other
    features, of the products; these sums are the coefficients of prod(share_i + met_i t)."""
    rows, d = met.shape
    weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.empty((rows, d))
    for j in range(d):
        poly = np.zeros((rows, d))
        poly[:, 0] = 1.0
        size = 0
        for i in range(d):
            if i != j:
                size += 1
                shifted = poly[:, :size] * met[:, [i]]
                poly[:, :size + 1] *= share[i]
                poly[:, 1:size + 1] += shifted
        out[:, j] = (met[:, j] - share[j]) * (poly @ weight)
    return out


def path_attributions(paths: Sequence[Path], x: np.ndarray) -> np.ndarray:
    """Attributions (rows by features) of the rows ``x``; they add up to prediction minus expected value."""
    out = np.zeros(x.shape)
    for p in paths:
        if not p.features:
            continue
        met = np.column_stack([c.holds(x[:, f]) for f, c in zip(p.features, p.conditions)])
        code = met @ (1 << np.arange(len(p.features), dtype=np.int64))
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        values = _pattern_values(met[first].astype(float), np.array([c.share for c in p.conditions]))
        out[:, p.features] += p.value * values[which]
    return out


def model_edges(paths: Sequence[Path], width: int) -> list[np.ndarray | None]:
    """Per feature the thresholds that any path has, in order; None for a feature that splits by categories."""
    edges: list = [set() for _ in range(width)]
    for p in paths:
        for f, c in zip(p.features, p.conditions):
            if c.allowed is not None:
                edges[f] = None
            elif edges[f] is not None:
                edges[f].update(t for t in (c.low, c.high) if math.isfinite(t))
    return [None if e is None else np.array(sorted(e)) for e in edges]


def model_cells(edges: Sequence[np.ndarray | None], x: np.ndarray) -> np.ndarray:
    """Where each row lies between the model's thresholds: rows of one cell meet the same conditions of every path."""
    return np.column_stack([np.where(np.isnan(x[:, f]), -1.0, x[:, f]) if e is None else np.searchsorted(e, x[:, f]).astype(float)
                            for f, e in enumerate(edges)])


def cell_attributions(paths: Sequence[Path], edges: Sequence[np.ndarray | None], x: np.ndarray) -> np.ndarray:
    """``path_attributions``, each cell of the model computed once."""
    if not x.size:
        return np.zeros(x.shape)
    _, first, which = np.unique(model_cells(edges, x), axis=0, return_index=True, return_inverse=True)
    one = x[first]
    cells = np.concatenate([path_attributions(paths, one[lo:lo + ROWS]) for lo in range(0, len(one), ROWS)])
    return cells[which.reshape(-1)]


def tree_shap(df: DataFrame, model, key: str, names: Sequence[str], features_col: str = "features",
              class_index: int | None = None, paths: Sequence[Path] | None = None) -> DataFrame:
    """H2: (key, feature, value, shap) of every row and feature, exactly.  ``df`` holds the assembled vectors.

    ``paths`` are the model's ``tree_paths`` where the caller has them.  A task gathers LOOK_THROUGH numbers
    of rows before it explains them: the walk over all leaves is taken once for each cell of the model, of
    which there are no more than thresholds and categories allow, whatever the rows."""
    spark = df.sparkSession
    paths = tree_paths(model, class_index) if paths is None else paths
    names = list(names)
    held = spark.sparkContext.broadcast((paths, model_edges(paths, len(names))))  # the model, as the executors have it anyway
    rows = df.select(F.col(f"`{key}`").alias("key"), vector_to_array(F.col(features_col)).alias("x"))
    kind = rows.schema["key"].dataType.simpleString()

    def explained(keys: pa.Table, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        shap = cell_attributions(*held.value, x)
        key_of = keys.column("key").combine_chunks()
        label = pa.array(names, pa.string())
        for lo in range(0, len(x), ROWS):
            n = len(x[lo:lo + ROWS])
            yield pa.RecordBatch.from_arrays(
                [key_of.take(pa.array(np.repeat(np.arange(lo, lo + n), len(names)))), label.take(pa.array(np.tile(np.arange(len(names)), n))),
                 pa.array(x[lo:lo + n].ravel()), pa.array(shap[lo:lo + n].ravel())], ["key", "feature", "value", "shap"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        xs: list[np.ndarray] = []
        for b in batches:
            kept.append(b.select(["key"]))
            xs.append(b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(names)))
            if sum(x.size for x in xs) >= LOOK_THROUGH:
                yield from explained(pa.Table.from_batches(kept), np.concatenate(xs))
                kept, xs = [], []
        if kept:
            yield from explained(pa.Table.from_batches(kept), np.concatenate(xs))

    out = rows.mapInArrow(work, f"key {kind}, feature string, value double, shap double")
    return out.withColumnRenamed("key", key)


def coalitions(m: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(membership, weight) of the coalitions other than none and all, by the Shapley kernel.

    All of them up to ALL_COALITIONS features; beyond, distinct ones drawn in complementary pairs with
    the kernel's chances of each size, all of equal weight."""
    if m <= ALL_COALITIONS:
        z = np.array([[s >> j & 1 for j in range(m)] for s in range(1, (1 << m) - 1)], float).reshape(-1, m)
        size = z.sum(axis=1).astype(int)
        return z, np.array([(m - 1) / (math.comb(m, s) * s * (m - s)) for s in size])
    rnd = np.random.RandomState(seed)
    sizes = np.arange(1, m)
    chance = (m - 1) / (sizes * (m - sizes))
    drawn: dict[bytes, np.ndarray] = {}
    while len(drawn) < MAX_COALITIONS:
        z = np.zeros(m, np.int8)
        z[rnd.permutation(m)[:rnd.choice(sizes, p=chance / chance.sum())]] = 1
        for c in (z, 1 - z):
            drawn.setdefault(c.tobytes(), c)
    z = np.array(list(drawn.values()), float)
    return z, np.ones(len(z))


def kernel_solution(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The matrix A with phi = A y, for y = (v(S) - v(none) for all S in z, then v(all) - v(none)).

    Weighted least squares under the condition that phi adds up to the last entry: the last feature is
    replaced by that total minus the others, and the normal equations are solved once."""
    n, m = z.shape
    if m == 1:
        return np.ones((1, 1))
    free = z[:, :-1] - z[:, -1:]
    solve = np.linalg.solve(free.T @ (weight[:, None] * free), (weight[:, None] * free).T)  # (m-1, n)
    a = np.zeros((m, n + 1))
    a[:-1, :-1] = solve
    a[:-1, -1] = -solve @ z[:, -1]
    a[-1] = -a[:-1].sum(axis=0)
    a[-1, -1] += 1
    return a


def kernel_shap(predict: Callable[[DataFrame], DataFrame], explain: DataFrame, background: DataFrame,
                features: Sequence[str], key: str, output: str, max_background: int = BACKGROUND_ROWS) -> DataFrame:
    """H3: (key, feature, value, shap) of every row of ``explain`` for any model.

    ``predict`` adds the column ``output`` to a frame with the feature columns.  Known features of a
    coalition come from the explained row, the others from each background row in turn; the model's
    outputs are averaged over the background.  ``key`` tells the explained rows apart.  A background of more than ``max_background`` rows is
    refused, not cut."""
    features = list(features)
    m = len(features)
    kinds = {f: explain.schema[f].dataType for f in features}
    drawn = background.select(*[F.col(f"`{f}`") for f in features]).limit(max_background + 1).collect()
    if len(drawn) > max_background:
        raise ValueError(f"the background has more than {max_background} rows")
    if not drawn:
        raise ValueError("the background is empty")
    z, weight = coalitions(m)
    a = kernel_solution(z, weight)
    every = np.vstack([np.zeros((1, m)), z, np.ones((1, m))]).astype(int).tolist()  # none, ..., all
    others = F.array(*[F.struct(*[F.lit(r[i]).cast(kinds[f]).alias(f"b{i}") for i, f in enumerate(features)]) for r in drawn])
    known = F.array(*[F.struct(F.lit(s).alias("s"), *[F.lit(bool(x)).alias(f"k{i}") for i, x in enumerate(row)])
                      for s, row in enumerate(every)])
    x = explain.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{f}`").alias(f"x{i}") for i, f in enumerate(features)])
    grid = x.select("*", F.explode(known).alias("_c")).select("*", F.explode(others).alias("_b"))
    points = grid.select("_key", F.col("_c.s").alias("_s"), *[F.col(f"x{i}").alias(f"_x{i}") for i in range(m)], *[
        F.when(F.col(f"_c.k{i}"), F.col(f"x{i}")).otherwise(F.col(f"_b.b{i}")).alias(f) for i, f in enumerate(features)])
    scored = predict(points).select("_key", "_s", *[f"_x{i}" for i in range(m)], F.col(output).cast("double").alias("_f"))
    # a row's outputs, by coalition; the average over the background is a sum with weight 1 / rows
    per = {j: F.array(*[F.lit(float(v)) for v in _by_coalition(a[j])]) for j in range(m)}
    sums = scored.groupBy("_key").agg(
        *[F.sum(F.col("_f") * F.element_at(per[j], F.col("_s") + 1) / len(drawn)).alias(f"p{j}") for j in range(m)],
        *[F.first(f"_x{i}").alias(f"x{i}") for i in range(m)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").cast("double").alias("value"),
                              F.col(f"p{i}").alias("shap")) for i, f in enumerate(features)])
    return sums.select(F.col("_key").alias(key), F.inline(rows))


def _by_coalition(a: np.ndarray) -> list[float]:
    """The row's weight of each coalition's mean output: none, the coalitions, all."""
    return [-float(a.sum()), *a.tolist()]


def vector_names(df: DataFrame, features_col: str = "features") -> list[str]:
    """Names of the slots of an assembled vector, from its metadata."""
    attrs = df.schema[features_col].metadata.get("ml_attr", {})
    names = {a["idx"]: a["name"] for group in attrs.get("attrs", {}).values() for a in group}
    return [names.get(i, f"f_{i}") for i in range(attrs.get("num_attrs", len(names)))]


