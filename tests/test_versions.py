"""Versions are compared with stored bins, broken-off recordings don't show, odd tables pass."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import drift, versions
from quarry.plans.tables import load
from quarry.sources.files import scratch_path

from .conftest import SMALL


def test_stored_bins_give_the_psi_of_both_tables(spark):
    ev = load(spark, SMALL, "events")
    old, new = ev.filter("event_id % 3 = 0"), ev.filter("event_id % 3 > 0").withColumn("value", F.col("value") * 1.4)
    path = scratch_path(spark, "v")
    versions.record(old, path, "a")
    versions.record(new, path, "b")
    got = {r["column_name"]: (round(r["psi"], 6), r["band"], r["method"], r["n_bins"]) for r in
           versions.history(spark, path).filter("latest AND psi IS NOT NULL").collect()}
    want = {r["column_name"]: (r["psi"], r["band"], r["method"], r["n_bins"]) for r in
            drift.psi(old, new, versions.comparable(old)).collect()}
    assert got == want and len({b for _, b, *_ in got.values()}) > 1


def test_the_old_rows_are_not_read_again(spark):
    path, data = scratch_path(spark, "v"), scratch_path(spark, "rows")
    spark.range(1000).select(F.col("id").cast("double").alias("x")).write.parquet(data)
    versions.record(spark.read.parquet(data), path, "a")
    where = spark._jvm.org.apache.hadoop.fs.Path(data)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # its own table, written above
    versions.record(spark.range(1000).select((F.col("id") + 500).cast("double").alias("x")), path, "b")
    assert versions.latest_psi(spark, path).collect()[0]["band"] == "drift"


def test_broken_off_recordings_and_odd_tables(spark, monkeypatch):
    path = scratch_path(spark, "v")
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "it's", None)], "`it's` int, t string, n double")
    versions.record(df, path, "a")

    def broken(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:  # stops after the bins and columns were written
        m.setattr(drift, "fingerprint", broken)
        with pytest.raises(RuntimeError):
            versions.record(df.filter("t = 'a'"), path, "broken")
    assert [r["version"] for r in versions.history(spark, path).select("version").distinct().collect()] == ["a"]
    versions.record(df, path, "b")
    rows = versions.history(spark, path).filter("latest").orderBy("position").collect()
    assert [(r["version"], r["no"], r["column_name"], r["psi"], r["changed"]) for r in rows] == [
        ("b", 1, "it's", 0.0, False), ("b", 1, "t", 0.0, False), ("b", 1, "n", None, False)]
    versions.record(df.filter("t = 'none'"), path, "empty")
    assert {r["psi"] for r in versions.history(spark, path).filter("latest AND psi IS NOT NULL").collect()} == {0.0}
