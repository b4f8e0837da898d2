"""Streaming drift monitor (Z1): PSI of each tumbling event-time window of a stream
against a fixed baseline.

The stream side is a Structured Streaming aggregation: ``withWatermark`` + ``window`` +
``groupBy(window, column, bin)`` counts, with the baseline's bin edges as literals (no
join with the baseline inside the stream).  ``update`` output mode lets the watermark
drop the state of closed windows, so state stays bounded on an endless stream.  Each
micro-batch appends its updated counts with the batch id; the PSI view reads the latest
count per (window, column, bin) and applies the same formula as the batch operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators.drift import PSI_EPS, band


def binned_stream(stream: DataFrame, time_col: str, edges: dict[str, list[float]], window: str,
                  watermark: str) -> DataFrame:
    """Per event: window, column and bin (-1 outside the baseline's outer edges)."""
    # the wall-clock time read as UTC: windows do not move with the session time zone
    ts = F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                f"CAST(`{time_col}` AS TIMESTAMP_NTZ)))")
    s = stream.withColumn("_ts", ts).withWatermark("_ts", watermark)
    parts = []
    for c, e in edges.items():
        v = F.col(f"`{c}`").cast("double")
        inner = sum((v >= F.lit(x)).cast("int") for x in e[1:-1]) if len(e) > 2 else F.lit(0)
        b = F.when(v.isNull(), None).when((v < F.lit(e[0])) | (v > F.lit(e[-1])), -1).otherwise(inner)
        parts.append(F.struct(F.lit(c).alias("column_name"), b.alias("bin")))
    long = s.select("_ts", F.explode(F.array(*parts)).alias("p")).select("_ts", "p.*").filter(F.col("bin").isNotNull())
    return long.groupBy(F.window("_ts", window).alias("w"), "column_name", "bin").agg(F.count(F.lit(1)).alias("n"))


def start(stream: DataFrame, time_col: str, edges: dict[str, list[float]], sink_path: str, checkpoint: str,
          window: str = "7 days", watermark: str = "1 day", available_now: bool = True):
    """Run the monitor: every micro-batch appends (window, column, bin, n, batch)."""
    counts = binned_stream(stream, time_col, edges, window, watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        ntz = "timestampadd(MICROSECOND, unix_micros(w.{}), TIMESTAMP_NTZ'1970-01-01 00:00:00')"
        batch.select(F.expr(ntz.format("start")).alias("window_start"), F.expr(ntz.format("end")).alias("window_end"),
                     "column_name", "bin", "n", F.lit(batch_id).alias("batch_id")) \
            .write.mode("append").parquet(sink_path)

    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def window_psi(spark: SparkSession, sink_path: str, baseline_counts: DataFrame, n_bins: dict[str, int]) -> DataFrame:
    """PSI per (window, column) from the latest counts in the sink and the baseline's bin
    counts ``(column_name, bin, e)``; every bin takes part (epsilon for empty ones)."""
    sink = spark.read.parquet(sink_path)
    latest = sink.groupBy("window_start", "window_end", "column_name", "bin").agg(F.max_by("n", "batch_id").alias("a"))
    tot_a = latest.groupBy("window_start", "window_end", "column_name").agg(F.sum("a").alias("na"))
    tot_e = baseline_counts.groupBy("column_name").agg(F.sum("e").alias("ne"))
    spec = F.create_map(*[x for c, k in n_bins.items() for x in (F.lit(c), F.lit(k))])
    bins = tot_a.select("window_start", "window_end", "column_name",
                        F.explode(F.sequence(F.lit(0), spec[F.col("column_name")] - 1)).alias("bin"))
    full = bins.join(latest, ["window_start", "window_end", "column_name", "bin"], "left") \
        .join(baseline_counts, ["column_name", "bin"], "left").fillna(0, ["a", "e"]) \
        .join(tot_a, ["window_start", "window_end", "column_name"]).join(tot_e, "column_name")
    pe, pa = F.col("e") / F.col("ne"), F.col("a") / F.col("na")
    full = full.withColumns({"pe": F.when(pe == 0, F.lit(PSI_EPS)).otherwise(pe),
                             "pa": F.when(pa == 0, F.lit(PSI_EPS)).otherwise(pa)})
    keys = ["window_start", "window_end", "column_name"]
    sums = full.groupBy(*keys).agg(F.sum("pe").alias("_se"), F.sum("pa").alias("_sa"))
    full = full.join(sums, keys).withColumns({"pe": F.col("pe") / F.col("_se"), "pa": F.col("pa") / F.col("_sa")})
    out = full.groupBy("window_start", "window_end", "column_name").agg(
        F.first("na").alias("n"), F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))).alias("psi"))
    return out.select("window_start", "window_end", "column_name",
                      F.col("n").cast("bigint").alias("n"), r6(F.col("psi")).alias("psi"), band(F.col("psi")).alias("band"))


def baseline_bins(baseline: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(column_name, bin, e): baseline counts on its own edges (inside values only)."""
    parts = []
    for c, e in edges.items():
        v = F.col(f"`{c}`").cast("double")
        inner = sum((v >= F.lit(x)).cast("int") for x in e[1:-1]) if len(e) > 2 else F.lit(0)
        parts.append(F.struct(F.lit(c).alias("column_name"),
                              F.when(v.isNull(), None).when((v < F.lit(e[0])) | (v > F.lit(e[-1])), -1)
                              .otherwise(inner).alias("bin")))
    long = baseline.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter(F.col("bin").isNotNull())
    return long.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("e")).filter(F.col("bin") >= 0)


def edges_for(baseline: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Baseline bin edges (D4's rule: 11 linear percentiles, unique, outer edges padded)."""
    from ..functions.columns import as_double
    from ..functions.ranks import exact_quantiles
    from ..operators.drift import PSI_BINS, PSI_EDGE_PAD
    probs = [i / PSI_BINS for i in range(PSI_BINS + 1)]
    q = exact_quantiles(baseline, {c: as_double(baseline, c) for c in cols}, probs)
    out = {}
    for c in cols:
        e = sorted(set(q[(c, p)] for p in probs))
        if len(e) >= 2:
            e[0] -= PSI_EDGE_PAD
            e[-1] += PSI_EDGE_PAD
            out[c] = e
    return out
