"""Calibration of scores (T13, T14): Platt's logistic map and the isotonic map, both fitted in Spark.

Isotonic: rows collapse to distinct scores, these are cut into ranges, and every range pools its adjacent
violators.  The blocks that remain are numbered along the scores and cut anew, each round at other places, so
that violations at the last round's edges now lie inside a range; a round whose neighbouring ranges don't
violate the order ends the fit.  Pooling blocks that were pooled before gives the same fit as pooling all
rows, so the result doesn't depend on the cuts.  A task holds ``RANGE`` blocks, the driver a row a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import pin

#: Distinct scores, or blocks, in one range.
RANGE = 1 << 19
MAX_ITER = 1000

_BLOCKS = "part bigint, seq bigint, lo double, hi double, total double, weight double"


def _pool(rows: list[tuple]) -> list[tuple]:
    """Pool adjacent violators: (lo, hi, total, weight) with strictly rising means."""
    out: list[tuple] = []
    for lo, hi, total, weight in rows:
        while out and out[-1][2] * weight >= total * out[-1][3]:
            before = out.pop()
            lo, total, weight = before[0], before[2] + total, before[3] + weight
        out.append((lo, hi, total, weight))
    return out


def _pooled(ordered: DataFrame) -> DataFrame:
    """Pool within each ``part``; a part's rows lie in one Spark partition, in order of their scores."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, room = None, [], 2 * RANGE

        def out() -> pa.RecordBatch:
            pooled = _pool(own)
            return pa.RecordBatch.from_arrays(
                [pa.array([now] * len(pooled), pa.int64()), pa.array(range(len(pooled)), pa.int64()),
                 *(pa.array([b[i] for b in pooled], pa.float64()) for i in range(4))],
                ["part", "seq", "lo", "hi", "total", "weight"])

        for b in batches:
            for part, *row in zip(*(b.column(c).to_pylist() for c in ("part", "lo", "hi", "total", "weight"))):
                if part != now and own:
                    yield out()
                    own, room = [], 2 * RANGE
                now = part
                own.append(tuple(row))
                if len(own) >= room:  # pooled so far; the last block may still take what follows
                    own = _pool(own)
                    room = max(2 * RANGE, 2 * len(own))
        if own:
            yield out()

    return ordered.select("part", "lo", "hi", "total", "weight").mapInArrow(work, _BLOCKS)


def isotonic(valid: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """(lo, hi, value, weight) of the blocks of the isotonic fit of ``label`` on ``score``.

    Rows without a score, label or positive weight take no part; no such row gives no block."""
    s, y = F.col(f"`{score}`").cast("double"), F.col(f"`{label}`").cast("double")
    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    rows = valid.select(s.alias("lo"), y.alias("y"), w.alias("w")).filter(
        "lo IS NOT NULL AND NOT isnan(lo) AND y IS NOT NULL AND NOT isnan(y) AND w > 0")
    points = pin(rows.groupBy("lo").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight")))
    n = points.count()
    if n == 0:
        return points.select("lo", F.col("lo").alias("hi"), F.col("total").alias("value"), "weight")
    cut = points.repartitionByRange(-(-n // RANGE), "lo").withColumns(
        {"part": F.spark_partition_id().cast("bigint"), "hi": F.col("lo")})
    blocks = pin(_pooled(cut.sortWithinPartitions("lo")))
    turn = 0
    while True:
        ends = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.col("total") / F.col("weight"), "seq").alias("first"),
                                          F.max_by(F.col("total") / F.col("weight"), "seq").alias("last")).collect()  # a row a range
        ends = sorted(ends, key=lambda r: r["part"])
        if all(a["last"] < b["first"] for a, b in zip(ends, ends[1:])):
            return blocks.select("lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")
        turn += 1
        before, offsets = 0, []
        for r in ends:
            offsets.append((r["part"], before))
            before += r["n"]
        start = blocks.sparkSession.createDataFrame(offsets, "part bigint, start bigint")
        shift = RANGE // 2 if turn % 2 and before > RANGE else 0
        place = F.floor((F.col("start") + F.col("seq") + shift) / RANGE).cast("bigint")
        moved = blocks.join(F.broadcast(start), "part").withColumn("part", place)
        parts = -(-(before + shift) // RANGE)
        blocks = pin(_pooled(moved.repartition(parts, "part").sortWithinPartitions("part", "lo")))


def apply_isotonic(blocks: DataFrame, df: DataFrame, score: str) -> DataFrame:
    """``df`` with ``calibrated``: the block's value, a straight line between two blocks, the end values beyond.

    Distinct scores are placed among the blocks in ranges of both together; a range knows the nearest
    blocks outside it.  Rows without a score get null."""
    s = F.col(f"`{score}`").cast("double")
    asked = df.select(s.alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").distinct()
    knots = blocks.select(F.explode(F.array(F.struct(F.col("lo").alias("x"), F.col("value").alias("y")),
                                            F.struct(F.col("hi").alias("x"), F.col("value").alias("y")))).alias("k")).select("k.*")
    both = pin(asked.withColumn("y", F.lit(None).cast("double")).unionByName(knots))
    ranges = max(1, -(-both.count() // RANGE))
    placed = pin(both.repartitionByRange(ranges, "x").withColumn("part", F.spark_partition_id()))
    edge = F.struct("x", "y")
    ends = placed.filter("y IS NOT NULL").groupBy("part").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).collect()
    known = sorted((r["part"], tuple(r["first"]), tuple(r["last"])) for r in ends)  # a row a range

    def fill(part: pa.Table) -> pa.Table:
        no = part.column("part")[0].as_py()
        x, y = (part.column(c).to_numpy() for c in ("x", "y"))
        own = ~np.isnan(y)
        px = [k[2] for k in known if k[0] < no][-1:] + list(zip(x[own], y[own])) + [k[1] for k in known if k[0] > no][:1]
        px.sort()
        ask = x[~own]
        got = np.interp(ask, [p[0] for p in px], [p[1] for p in px]) if px else np.full(len(ask), np.nan)
        return pa.table({"x": ask, "calibrated": pa.array(got, pa.float64(), from_pandas=True)})

    values = placed.groupBy("part").applyInArrow(fill, "x double, calibrated double")
    base = df.drop("calibrated")
    joined = base.withColumn("_x", s).join(values.withColumnRenamed("x", "_x"), "_x", "left")
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], "calibrated")


def platt(valid: DataFrame, score: str, label: str):
    """Platt scaling with the smoothed targets, as a weighted two-row expansion:
    each row becomes (1, t) and (0, 1 - t) with t = (N+ + 1)/(N+ + 2) for positives and
    1/(N- + 2) for negatives; one unregularised 1-feature logistic fit over distinct (score, label).

    Rows without a score or label take no part."""
    s, y = F.col(f"`{score}`").cast("double"), F.col(f"`{label}`").cast("int")
    points = pin(valid.select(s.alias("_s"), y.alias("_y")).filter("_s IS NOT NULL AND NOT isnan(_s) AND _y IS NOT NULL")
                 .groupBy("_s", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    cnt = points.agg(F.sum(F.col("_n") * F.col("_y")).alias("p"), F.sum("_n").alias("n")).first()
    pos, neg = cnt["p"] or 0.0, (cnt["n"] or 0.0) - (cnt["p"] or 0.0)
    hi, lo = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)
    t = F.when(F.col("_y") == 1, F.lit(hi)).otherwise(F.lit(lo))
    two = points.select("_s", "_n", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), t.alias("t")), F.struct(F.lit(0.0).alias("label"), (1 - t).alias("t")))).alias("r")) \
        .select("_s", "r.label", (F.col("r.t") * F.col("_n")).alias("w"))
    feats = VectorAssembler(inputCols=["_s"], outputCol="features").transform(two)
    return LogisticRegression(regParam=0.0, weightCol="w", maxIter=MAX_ITER, tol=1e-12, standardization=True).fit(feats)


def apply_platt(model, df: DataFrame, score: str) -> DataFrame:
    """``df`` with ``calibrated``; rows without a score get null."""
    a, b = float(model.coefficients[0]), float(model.intercept)
    s = F.col(f"`{score}`").cast("double")
    p = 1 / (1 + F.exp(-(F.lit(a) * s + F.lit(b))))
    return df.withColumn("calibrated", F.when(s.isNotNull() & ~F.isnan(s), p))
