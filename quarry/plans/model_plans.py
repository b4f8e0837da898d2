"""Queries on fitted models: CV of the candidates (M8-M10, T6, X12), grid tuning (T7), final
importances (T10, H5), Platt and isotonic calibration (T13, T14), attributions (H2, H3)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from ..functions.columns import phash, phash_sql, r6
from ..functions.materialize import pin, spread
from ..operators import attribution, calibrate, folds, models
from .eval_plans import LI_BIN_SQL, li_binary
from .quality import LI_HASH, LI_KEY
from . import sqlkit
from .registry import query
from .split_plans import _bins_sql, group_folds_ctes
from .tables import load

ORD_NUM, ORD_CAT = ["o_totalprice"], ["o_orderstatus"]
PART_NUM, PART_CAT = ["p_size"], ["p_brand"]  # p_partkey is ID-like (X1) and so no feature


def orders_folded(spark, sf):
    """Orders are framed as ordered in time (F6), so their folds are blocks of time (T4)."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", *ORD_NUM, *ORD_CAT)
    return folds.time_series_folds(o, folds.epoch_micros("o_orderdate"), "o_orderkey")


def part_folded(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", *PART_CAT)
    return folds.kfold(p, ["p_partkey"])


@query("cv_logistic")
def q_cv_logistic(spark, sf):
    return models.cross_validate(orders_folded(spark, sf), "o_orderpriority", ORD_NUM, ORD_CAT, "logistic",
                                 "classification", {"C": 1.0}, time_ordered=True)


def order_sums(spark, sf):
    """One row per order: summed quantity and price of its lines, and its first shipping date."""
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.min("l_shipdate").alias("shipped"))


def _cv_ridge_sql():
    """Ridge on one standardised feature in closed form: mean + z * sum(z y) / (sum(z z) + alpha)."""
    rank, n = sqlkit.rank_over(["l_orderkey"], folds.FOLD_SEED), sqlkit.count_over()
    shuffled = " + ".join(f"CASE WHEN _r >= (_n * {c} + 9999) // 10000 THEN 1 ELSE 0 END" for c in folds._fold_cuts(5))
    return f"""
WITH o AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS y, min(l_shipdate) AS t FROM lineitem GROUP BY 1),
r AS (SELECT *, {rank} AS _r, {n} AS _n, row_number() OVER (ORDER BY t, l_orderkey) - 1 AS _t FROM o),
f AS (SELECT 'random' AS folds, q, y, {shuffled} AS fold FROM r UNION ALL
      SELECT 'time', q, y, CAST(CASE WHEN _t < _n - 5 * (_n // 6) THEN -1 ELSE (_t - _n + 5 * (_n // 6)) // (_n // 6) END AS INTEGER) FROM r),
k AS (SELECT DISTINCT folds, fold FROM f WHERE fold >= 0),
m AS (SELECT k.folds, k.fold, avg(f.q) AS mq, stddev_pop(f.q) AS sq, avg(f.y) AS my, count(*) AS n,
             covar_pop(f.q, f.y) / stddev_pop(f.q) * count(*) / (count(*) + 1.0) AS b
      FROM k JOIN f ON f.folds = k.folds AND (CASE WHEN k.folds = 'time' THEN f.fold < k.fold ELSE f.fold <> k.fold END)
      GROUP BY 1, 2),
s AS (SELECT m.folds, m.fold, 1 - sum((y - my - b * (q - mq) / sq) ** 2) / (var_pop(y) * count(*)) AS score
      FROM m JOIN f USING (folds, fold) GROUP BY 1, 2)
SELECT folds, 'ridge' AS candidate, fold, round(score, 6) AS score, round(avg(score) OVER (PARTITION BY folds), 6) AS cv_mean,
       round(stddev_pop(score) OVER (PARTITION BY folds), 6) AS cv_std FROM s"""


@query("cv_ridge", sql=_cv_ridge_sql())
def q_cv_ridge(spark, sf):
    """Ridge under shuffled folds and under blocks of time."""
    rows = pin(order_sums(spark, sf))
    shuffled = folds.kfold(rows, ["l_orderkey"])
    timed = folds.time_series_folds(rows, folds.epoch_micros("shipped"), "l_orderkey")
    out = [models.cross_validate(df, "price", ["quantity"], [], "ridge", "regression", {"alpha": 1.0}, time_ordered=t)
           .select(F.lit(name).alias("folds"), "*") for name, df, t in (("random", shuffled, False), ("time", timed, True))]
    return out[0].unionByName(out[1])


def _cv_groups_sql():
    """Ridge on one standardised feature in closed form, under folds of whole orders."""
    ctes = group_folds_ctes("SELECT l_orderkey AS g, count(*) AS n_rows FROM lineitem GROUP BY 1")
    return f"""WITH RECURSIVE {ctes},
f AS (SELECT l_quantity AS q, l_extendedprice AS y, fold FROM lineitem JOIN gf ON g = l_orderkey),
m AS (SELECT k.fold, avg(f.q) AS mq, stddev_pop(f.q) AS sq, avg(f.y) AS my,
             covar_pop(f.q, f.y) / stddev_pop(f.q) * count(*) / (count(*) + 1.0) AS b
      FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1),
s AS (SELECT m.fold, 1 - sum((y - my - b * (q - mq) / sq) ** 2) / (var_pop(y) * count(*)) AS score FROM m JOIN f USING (fold) GROUP BY 1)
SELECT 'ridge' AS candidate, fold::INT AS fold, round(score, 6) AS score, round(avg(score) OVER (), 6) AS cv_mean,
       round(stddev_pop(score) OVER (), 6) AS cv_std FROM s"""


@query("cv_ridge_groups", sql=_cv_groups_sql())
def q_cv_ridge_groups(spark, sf):
    """The lines of an order are never on both sides of a fold."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return models.cross_validate(folds.group_folded(li, "l_orderkey"), "l_extendedprice", ["l_quantity"], [], "ridge",
                                 "regression", {"alpha": 1.0})


@query("cv_forest")
def q_cv_forest(spark, sf):
    return models.cross_validate(part_folded(spark, sf), "p_retailprice", PART_NUM, PART_CAT, "random_forest",
                                 "regression", {"n_estimators": 100, "max_depth": 10})


@query("cv_boosted")
def q_cv_boosted(spark, sf):
    return models.cross_validate(part_folded(spark, sf), "p_retailprice", PART_NUM, PART_CAT, "boosted_trees",
                                 "regression", {"n_estimators": 100, "learning_rate": 0.1})


@query("tune_grid")
def q_tune_grid(spark, sf):
    return models.tune(orders_folded(spark, sf), "o_orderpriority", ORD_NUM, ORD_CAT, "logistic", "classification",
                       time_ordered=True)


def part_split(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", *PART_CAT)
    return folds.random_split(p, ["p_partkey"])


def part_forest(spark, sf):
    """A forest with the preparation that cross-validation uses, refitted on the training split."""
    s = spread(pin(part_split(spark, sf)))
    train = s.filter(F.col("split") == "train")
    return s, models.fit_final(train, "p_retailprice", PART_NUM, PART_CAT, "random_forest", "regression",
                               {"n_estimators": 100, "max_depth": 10})


@query("final_importance")
def q_final_importance(spark, sf):
    """Refit on the training split, importances with share and dominance."""
    _, model = part_forest(spark, sf)
    return models.importance_rows(spark, models.importances(model))


@query("forest_attribution", sql="SELECT p_partkey, true AS adds_up FROM ("
       + _bins_sql("SELECT p_partkey FROM part", ["p_partkey"], 42, [2000]) + ") WHERE _bin = 0")
def q_forest_attribution(spark, sf):
    """H2: exact attributions of every test row by a forest of 100 trees; a row's add up to prediction minus mean."""
    s, model = part_forest(spark, sf)
    test = model.prepared(s.filter(F.col("split") == "test").select("p_partkey", *PART_NUM, *PART_CAT))
    paths = attribution.tree_paths(model.estimator)
    shap = attribution.tree_shap(test, model.estimator, "p_partkey", model.names, paths=paths)
    mean = attribution.expected_value(paths)
    total = shap.groupBy("p_partkey").agg(F.sum("shap").alias("total"))
    pred = model.estimator.transform(test).select("p_partkey", "prediction")
    return total.join(pred, "p_partkey").select(
        "p_partkey", (F.abs(F.col("total") - (F.col("prediction") - mean)) < 1e-6).alias("adds_up"))


TREE_FEATURES = ["l_quantity", "l_discount"]
TREE_LABEL = "l_quantity + 400 * l_discount"


def _tree_sql():
    """A regression tree of two levels by exhaustive search, and its Shapley values by listing the subsets."""
    rows = _bins_sql(f"SELECT *, {TREE_LABEL} AS y FROM lineitem", LI_KEY, 42, [2000], hash_cols=LI_HASH)
    long = sqlkit.union_all([f"SELECT node, {i} AS f, {c}::DOUBLE AS x, y FROM nd" for i, c in enumerate(TREE_FEATURES)])
    keys = ", ".join(LI_KEY)

    def best(nodes):
        """(node, f, thr): the split with the largest drop of the squared error."""
        return f"""(WITH nd AS ({nodes}), lg AS ({long}),
  g AS (SELECT node, f, x, count(*) AS n, sum(y) AS s FROM lg GROUP BY ALL),
  c AS (SELECT node, f, x, lead(x) OVER w AS nx, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
               sum(n) OVER (PARTITION BY node, f) AS n, sum(s) OVER (PARTITION BY node, f) AS s
        FROM g WINDOW w AS (PARTITION BY node, f ORDER BY x))
  SELECT node, f, (x + nx) / 2 AS thr FROM c WHERE nx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(sl * sl / nl + (s - sl) * (s - sl) / (n - nl), 3) DESC, f, x) = 1)"""
    val = "CASE f WHEN 0 THEN " + f"{TREE_FEATURES[0]} ELSE {TREE_FEATURES[1]} END"

    def known(s):  # value of the coalition: known splits are followed, others are averaged by the rows below
        def step(node, left, right):
            follow = f"CASE WHEN ({'list_contains([' + ', '.join(map(str, s)) + '], ' + node + '.f)' if s else 'false'}) THEN "                      f"(CASE WHEN (CASE {node}.f WHEN 0 THEN e.{TREE_FEATURES[0]} ELSE e.{TREE_FEATURES[1]} END) <= {node}.thr THEN {left} ELSE {right} END) "
            return follow + f"ELSE ({node}.nl * ({left}) + {node}.nr * ({right})) / ({node}.nl + {node}.nr) END"
        return step("r", step("a", "a.ml", "a.mr"), step("b", "b.ml", "b.mr"))
    return f"""WITH s AS ({rows}), tr AS (SELECT * FROM s WHERE _bin <> 0), e AS (SELECT * FROM s WHERE _bin = 0),
r0 AS (SELECT * FROM {best("SELECT 0 AS node, * FROM tr")}),
l1 AS (SELECT tr.*, CASE WHEN {val} <= thr THEN 1 ELSE 2 END AS node FROM tr, r0),
r1 AS (SELECT * FROM {best("SELECT node, * EXCLUDE (node) FROM l1")}),
st AS (SELECT r1.node, r1.f, r1.thr, count_if({val} <= thr) AS nl, count_if({val} > thr) AS nr,
              avg(y) FILTER ({val} <= thr) AS ml, avg(y) FILTER ({val} > thr) AS mr FROM r1 JOIN l1 ON l1.node = r1.node GROUP BY ALL),
r AS (SELECT f, thr, (SELECT nl + nr FROM st WHERE node = 1) AS nl, (SELECT nl + nr FROM st WHERE node = 2) AS nr FROM r0),
v AS (SELECT {keys}, {', '.join('e.' + c for c in TREE_FEATURES)}, {known([])} AS v_, {known([0])} AS v0, {known([1])} AS v1, {known([0, 1])} AS v01
      FROM e, r, (SELECT * FROM st WHERE node = 1) a, (SELECT * FROM st WHERE node = 2) b)
SELECT {keys}, '{TREE_FEATURES[0]}' AS feature, {TREE_FEATURES[0]}::DOUBLE AS value, round(((v0 - v_) + (v01 - v1)) / 2, 6) AS shap FROM v
UNION ALL SELECT {keys}, '{TREE_FEATURES[1]}', {TREE_FEATURES[1]}::DOUBLE, round(((v1 - v_) + (v01 - v0)) / 2, 6) FROM v"""


@query("tree_attribution", sql=_tree_sql())
def q_tree_attribution(spark, sf):
    """H2: a regression tree of two levels over lineitem, every test row attributed exactly."""
    li = load(spark, sf, "lineitem").select(*LI_KEY, *TREE_FEATURES, F.expr(TREE_LABEL).alias("label"))
    s = pin(folds.random_split(li, LI_KEY, hash_cols=LI_HASH))
    vectors = VectorAssembler(inputCols=TREE_FEATURES, outputCol="features")
    tree = DecisionTreeRegressor(maxDepth=2, maxBins=64, labelCol="label", featuresCol="features")
    model = tree.fit(vectors.transform(s.filter(F.col("split") == "train")))
    test = vectors.transform(s.filter(F.col("split") == "test")).withColumn("key", F.struct(*LI_KEY))
    shap = attribution.tree_shap(test, model, "key", TREE_FEATURES)
    return shap.select("key.*", "feature", "value", r6(F.col("shap")).alias("shap"))


KERNEL_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _kernel_sql():
    """Least squares on three features by Cramer's rule; a linear model's attributions against the background."""
    rows = _bins_sql("SELECT * FROM lineitem", LI_KEY, 42, [2000], hash_cols=LI_HASH)
    keys = ", ".join(LI_KEY)
    y = "l_extendedprice"
    cov = [[f"covar_pop({a}, {b})" for b in KERNEL_FEATURES] for a in KERNEL_FEATURES]
    names = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    rhs = ["y0", "y1", "y2"]

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    put = [f"{cov[i][j]} AS {names[i][j]}" for i in range(3) for j in range(i, 3)] + [f"covar_pop({f}, {y}) AS y{i}" for i, f in enumerate(KERNEL_FEATURES)]
    beta = [f"{det([[rhs[i] if j == k else names[i][j] for j in range(3)] for i in range(3)])} / {det(names)} AS b{k}" for k in range(3)]
    bg = ", ".join(f"avg({f}) AS m{i}" for i, f in enumerate(KERNEL_FEATURES))
    return f"""WITH s AS ({rows}), tr AS (SELECT * FROM s WHERE _bin <> 0), e AS (SELECT * FROM s WHERE _bin = 0),
c AS (SELECT {', '.join(put)} FROM tr), b AS (SELECT {', '.join(beta)} FROM c),
g AS (SELECT {bg} FROM (SELECT * FROM tr ORDER BY {phash_sql(LI_HASH, 42)}, {keys} LIMIT 20))
""" + sqlkit.union_all([f"SELECT {keys}, '{f}' AS feature, {f}::DOUBLE AS value, round(b{i} * ({f} - m{i}), 5) AS shap FROM e, b, g"
                        for i, f in enumerate(KERNEL_FEATURES)])


@query("kernel_attribution", sql=_kernel_sql())
def q_kernel_attribution(spark, sf):
    """H3: all coalitions of three features over a background of 20 rows; on a linear model the values are H1's."""
    li = load(spark, sf, "lineitem").select(*LI_KEY, *[c for c in KERNEL_FEATURES if c not in LI_KEY], "l_extendedprice")
    s = pin(folds.random_split(li, LI_KEY, hash_cols=LI_HASH))
    train, test = (s.filter(F.col("split") == x) for x in ("train", "test"))
    vectors = VectorAssembler(inputCols=KERNEL_FEATURES, outputCol="features")
    model = LinearRegression(solver="normal", labelCol="l_extendedprice", featuresCol="features").fit(vectors.transform(train))
    draw = train.orderBy(phash(LI_HASH, df=train), *LI_KEY).limit(attribution.BACKGROUND_ROWS)  # the feature's own size
    shap = attribution.kernel_shap(lambda df: model.transform(vectors.transform(df)), test.withColumn("key", F.struct(*LI_KEY)),
                                   draw, KERNEL_FEATURES, "key", "prediction")
    return shap.select("key.*", "feature", "value", F.round("shap", 5).alias("shap"))


def li_calibration_split(spark, sf):
    s = pin(folds.random_split(li_binary(spark, sf).select(*LI_KEY, "label", "score"), LI_KEY, hash_cols=LI_HASH))
    return s.filter(F.col("split") == "train").drop("split"), s.filter(F.col("split") == "test").drop("split")


_CAL_SPLIT = ("s AS (" + _bins_sql(LI_BIN_SQL, LI_KEY, 42, [2000], hash_cols=LI_HASH)
              + "), tr AS (SELECT * FROM s WHERE _bin <> 0), te AS (SELECT * FROM s WHERE _bin = 0)")


@query("calibrate_sigmoid", sql=f"""WITH RECURSIVE {_CAL_SPLIT},
c AS (SELECT sum(label)::DOUBLE AS p, count(*) - sum(label)::DOUBLE AS n FROM tr),
t AS (SELECT score AS x, CASE WHEN label = 1 THEN (p + 1) / (p + 2) ELSE 1 / (n + 2) END AS t, count(*) AS w FROM tr, c GROUP BY ALL),
nt AS (SELECT 0 AS it, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
  SELECT it + 1, a + (g1 * h00 - g0 * h01) / (h11 * h00 - h01 * h01), b + (g0 * h11 - g1 * h01) / (h11 * h00 - h01 * h01) FROM (
    SELECT it, a, b, sum(w * (t - q)) AS g0, sum(w * (t - q) * x) AS g1, sum(w * q * (1 - q)) AS h00,
           sum(w * q * (1 - q) * x) AS h01, sum(w * q * (1 - q) * x * x) AS h11
    FROM (SELECT it, a, b, x, t, w, 1 / (1 + exp(-(a * x + b))) AS q FROM nt, t WHERE it < 25) GROUP BY it, a, b)),
f AS (SELECT a, b FROM nt WHERE it = 25)
SELECT {', '.join(LI_KEY)}, label, round(score, 6) AS score, round(1 / (1 + exp(-(a * score + b))), 5) AS calibrated FROM te, f""")
def q_calibrate_sigmoid(spark, sf):
    """Platt's map of the held-out scores; the SQL iterates Newton's method."""
    valid, test = li_calibration_split(spark, sf)
    out = calibrate.apply_platt(calibrate.platt(valid, "score", "label"), test, "score")
    return out.withColumns({"score": r6(F.col("score")), "calibrated": F.round("calibrated", 5)})


@query("calibrate_isotonic", sql=f"""WITH {_CAL_SPLIT},
v AS (SELECT score, sum(label)::DOUBLE AS s, count(*) AS n FROM tr GROUP BY score),
p AS (SELECT score, s, n, row_number() OVER (ORDER BY score) AS i, sum(s) OVER (ORDER BY score) AS cs, sum(n) OVER (ORDER BY score) AS cn FROM v),
ab AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM p a JOIN p b ON b.i >= a.i),
mb AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM ab),
fit AS (SELECT p.score, max(m) AS g FROM mb JOIN p ON p.i = mb.b GROUP BY p.score),
lo AS (SELECT te.*, fit.score AS x0, fit.g AS g0 FROM te ASOF LEFT JOIN fit ON te.score >= fit.score),
hi AS (SELECT lo.*, fit.score AS x1, fit.g AS g1 FROM lo ASOF LEFT JOIN fit ON lo.score <= fit.score)
SELECT {', '.join(LI_KEY)}, label, round(score, 6) AS score, round(CASE WHEN x0 IS NULL THEN g1 WHEN x1 IS NULL OR x0 = x1 THEN g0
       ELSE g0 + (g1 - g0) * (score - x0) / (x1 - x0) END, 6) AS calibrated FROM hi""")
def q_calibrate_isotonic(spark, sf):
    """The isotonic map; the SQL takes the largest over starts of the smallest mean over ends."""
    valid, test = li_calibration_split(spark, sf)
    out = calibrate.apply_isotonic(calibrate.isotonic(valid, "score", "label"), test, "score")
    return out.withColumns({"score": r6(F.col("score")), "calibrated": r6(F.col("calibrated"))})


@query("sampled_shapley")
def q_sampled_shapley(spark, sf):
    s, model = part_forest(spark, sf)
    # every test row is explained against a seeded draw of training rows (the sampling is the feature)
    explain = s.filter(F.col("split") == "test")
    draw = phash(["p_partkey"], df=s)
    background = s.filter(F.col("split") == "train").orderBy(draw, "p_partkey").limit(models.BACKGROUND_ROWS)
    return models.sampled_shapley(model, explain, background, PART_NUM + PART_CAT, "p_partkey", "prediction")
