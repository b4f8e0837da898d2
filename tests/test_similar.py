"""The bucketed search returns what brute force returns, reads few buckets, and takes odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import similar
from quarry.sources import files


@pytest.fixture(scope="module")
def runs(spark):
    rnd = np.random.RandomState(3)
    centres = rnd.normal(size=(8, similar.DIM)) + 2.0  # all on one side, as profile vectors are
    rows = [(f"r{i:03d}", i // 4, (centres[i % 8] + rnd.normal(size=similar.DIM) * 0.3).tolist()) for i in range(400)]
    rows += [("zero", 3, [0.0] * similar.DIM), ("r010", 2, rows[10][2])]  # no direction; a repeated row
    return rows


def brute(rows, queries, k=3):
    out = {}
    for q, at, v in queries:
        found = []
        for r, t, x in rows:
            if t < at:
                n = np.linalg.norm(v) * np.linalg.norm(x)
                found.append((-round(float(np.dot(v, x) / n) if n else 0.0, 9), r, t))
        for rank, (c, r, _) in enumerate(sorted(found)[:k]):
            out[q, rank + 1] = (r, round(-c, 6))
    return out


def test_equals_brute_force_and_prunes(spark, runs):
    df = spark.createDataFrame(runs, "run_id string, run_at bigint, vector array<double>")
    path = files.scratch_path(spark, "runs")
    similar.write_index(df.filter("run_at < 50"), path)
    similar.write_index(df.filter("run_at >= 50"), path)  # appended with the directions of the first write
    queries = [r for r in runs if r[1] >= 80 or r[0] in ("r000", "r017", "zero")]
    asked = df.filter(F.col("run_at") >= 80).unionByName(df.filter(F.col("run_id").isin("r000", "r017", "zero")))
    got = {(r["run_id"], r["rank"]): (r["similar_run"], r["cosine"]) for r in similar.similar_runs(path, asked).collect()}
    want = brute(runs, queries)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    recall = sum(got[k][0] == want[k][0] for k in want) / len(want)
    assert recall == 1.0 and not [k for k in got if k[0] == "r000"]  # nothing is earlier than the first
    _, more = similar.probes(path, asked.filter("run_at >= 80"))
    reads = more.count() / asked.filter("run_at >= 80").count()
    assert reads < 0.3 * (1 << similar.PLANES)  # buckets read, of 64
    plan = similar._scored(similar._vectors(spark, path), more)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_profile_vectors_of_odd_tables(spark):
    df = spark.createDataFrame([(1, float("nan"), None, "x"), (1, 2.0, "a", "y"), (2, None, None, "z")],
                               "g int, it_s double, s string, b string").withColumnRenamed("it_s", "it's")
    got = {r["run_id"]: r["vector"] for r in similar.profile_vectors(df, F.col("g").cast("string"), F.lit(0)).collect()}
    assert set(got) == {"1", "2"} and all(len(v) == similar.DIM for v in got.values())
    at = similar.LEADING + similar.slot("it's") * similar.ENTRIES
    if similar.slot("it's") not in {similar.slot(x) for x in ("g", "s", "b")}:
        assert got["1"][at:at + 2] == [1.0, 0.5] and got["2"][at:at + 4] == [1.0, 1.0, 0.0, 0.0]
    assert similar.profile_vectors(df.filter("g > 5"), F.lit("r"), F.lit(0)).count() == 0
