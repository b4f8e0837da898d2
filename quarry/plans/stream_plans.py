"""Query: streaming drift monitor (Z1) — events replayed as a file stream against the
first half of the period as baseline; PSI per 7-day event-time window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import scratch_path
from ..streaming import drift_monitor
from .drift_plans import events_halves
from .registry import query
from .tables import SCHEMAS, load

STREAM_COLS = ["value", "user_id"]
LANDING_FILES = 4


def _events_schema() -> str:
    return ", ".join(f"{c} {t}" for c, t in SCHEMAS["events"])


WEEK_US = 7 * 86_400 * 1_000_000


def _stream_sql():
    from .drift_plans import _HALVES
    qs = ", ".join(f"{i / 10}" for i in range(11))
    parts = []
    for c in STREAM_COLS:
        edges = (f"(SELECT list_concat([q[1] - 1e-5], q[2:len(q) - 1], [q[len(q)] + 1e-5]) AS e FROM "
                 f"(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{qs}]))) AS q FROM base))")
        binexpr = "CASE WHEN v < e[1] OR v > e[len(e)] THEN -1 ELSE len(list_filter(e[2:len(e) - 1], lambda x: v >= x)) END"
        cur = (f"SELECT (epoch_us(ts) // {WEEK_US}) * {WEEK_US} AS w, {binexpr} AS bin FROM "
               f"(SELECT ts, CAST({c} AS DOUBLE) AS v FROM events WHERE {c} IS NOT NULL), {edges}")
        bas = f"SELECT {binexpr} AS bin FROM (SELECT CAST({c} AS DOUBLE) AS v FROM base WHERE {c} IS NOT NULL), {edges}"
        parts.append(f"""(SELECT '{c}' AS column_name, w, bin, a, e, na, ne FROM
  (SELECT w, b.bin FROM (SELECT DISTINCT w FROM ({cur})), (SELECT unnest(range(0, len(e) - 1)) AS bin FROM {edges}) b) g
  LEFT JOIN (SELECT w, bin, count(*) AS a FROM ({cur}) GROUP BY ALL) USING (w, bin)
  LEFT JOIN (SELECT bin, count(*) AS e FROM ({bas}) WHERE bin >= 0 GROUP BY bin) USING (bin)
  JOIN (SELECT w, count(*) AS na FROM ({cur}) GROUP BY w) USING (w),
  (SELECT count(*) AS ne FROM ({bas}) WHERE bin >= 0))""")
    full = " UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)
    return f"""WITH {_HALVES},
f AS (SELECT column_name, w, na, ne, coalesce(a, 0) AS a, coalesce(e, 0) AS e FROM ({full})),
p AS (SELECT *, CASE WHEN e / ne = 0 THEN 1e-4 ELSE e / ne END AS pe, CASE WHEN a / na = 0 THEN 1e-4 ELSE a / na END AS pa FROM f),
r AS (SELECT *, pe / sum(pe) OVER (PARTITION BY column_name, w) AS qe, pa / sum(pa) OVER (PARTITION BY column_name, w) AS qa FROM p)
SELECT make_timestamp(w) AS window_start, make_timestamp(w + {WEEK_US}) AS window_end, column_name, first(na)::BIGINT AS n,
       round(sum((qa - qe) * ln(qa / qe)), 6) AS psi,
       CASE WHEN sum((qa - qe) * ln(qa / qe)) < 0.1 THEN 'stable'
            WHEN sum((qa - qe) * ln(qa / qe)) < 0.2 THEN 'moderate' ELSE 'drift' END AS band
FROM r GROUP BY column_name, w"""


@query("stream_drift", sql=_stream_sql())
def q_stream_drift(spark, sf):
    """Events replayed in time order through a file stream; PSI per 7-day window."""
    base, _ = events_halves(spark, sf)
    edges = drift_monitor.edges_for(base, STREAM_COLS)
    # the landing folder receives the events in time order, one time range after the other, each written
    # by as many tasks as it has partitions; the monitor is run after each and goes on from its checkpoint
    # (the watermark drops events that arrive after their window closed)
    landing = scratch_path(spark, "events-landing")
    ev = load(spark, sf, "events")
    cuts = ev.agg(F.percentile_approx(F.col("ts"), [i / LANDING_FILES for i in range(1, LANDING_FILES)])).first()[0]
    bounds = [None, *cuts, None]
    sink, ckpt = scratch_path(spark, "drift-sink"), scratch_path(spark, "drift-ckpt")
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = ev
        if lo is not None:
            part = part.filter(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
        if hi is not None:
            part = part.filter(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(_events_schema()).parquet(landing)
        drift_monitor.start(stream, "ts", edges, sink, ckpt).awaitTermination()
    return drift_monitor.window_psi(spark, sink, drift_monitor.baseline_bins(base, edges),
                                    {c: len(e) - 1 for c, e in edges.items()})
