"""Schema identity and drift (D1-D6) and the drift flags.

PSI for all columns runs as one job: bin edges (exact linear percentiles of the
baseline, a handful of numbers per column) are literals in a narrow projection, the two
sides are unioned, unpivoted with ``stack`` and counted by one ``groupBy``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, dtype_name, is_numeric_type, long_rows, r6, unpivot
from ..functions.ranks import column_counts, exact_quantiles

# Fixed values of the PSI rule.
PSI_BINS = 10
PSI_EDGE_PAD = 1e-5
PSI_EPS = 1e-4
PSI_STABLE = 0.1
PSI_DRIFT = 0.2


def fingerprint(df: DataFrame, ordered: bool = False) -> str:
    """SHA-256 of ``col:dtype`` pairs sorted by name (``ordered=True`` keeps column order)."""
    pairs = [(f.name, dtype_name(f.dataType)) for f in df.schema.fields]
    if not ordered:
        pairs = sorted(pairs)
    return hashlib.sha256(",".join(f"{c}:{t}" for c, t in pairs).encode("utf-8")).hexdigest()


def schema_meta(df: DataFrame) -> DataFrame:
    """One row per column (name, dtype, position, numeric, values held) with the table's row count."""
    fields = df.schema.fields
    held = [F.count(F.col(f"`{f.name}`")).alias(f"v{i}") for i, f in enumerate(fields)]
    return long_rows(df.agg(F.count(F.lit(1)).alias("n_rows"), *held), [F.col("n_rows")],
                     ["column_name", "dtype", "position", "is_numeric", "n_values"],
                     [(f.name, dtype_name(f.dataType), i, is_numeric_type(f.dataType), F.col(f"v{i}"))
                      for i, f in enumerate(fields)])


def schema_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """D3 with D1: full outer join of the two schema tables, with the values each side holds."""
    b = schema_meta(baseline).select("column_name", F.col("dtype").alias("baseline_dtype"),
                                     F.col("is_numeric").alias("b_num"), F.col("n_values").alias("baseline_values"))
    c = schema_meta(current).select("column_name", F.col("dtype").alias("current_dtype"),
                                    F.col("is_numeric").alias("c_num"), F.col("n_values").alias("current_values"))
    fb, fc = fingerprint(baseline), fingerprint(current)
    j = b.join(c, "column_name", "full_outer")
    status = (F.when(F.col("baseline_dtype").isNull(), "added")
              .when(F.col("current_dtype").isNull(), "removed")
              .when(F.col("baseline_dtype") != F.col("current_dtype"), "dtype_changed")
              .otherwise("same"))
    return j.select(
        "column_name", "baseline_dtype", "current_dtype", "baseline_values", "current_values", status.alias("status"),
        (F.coalesce(F.col("b_num"), F.lit(False)) & ~F.coalesce(F.col("c_num"), F.lit(True))).alias("numeric_to_text"),
        F.lit(fb).alias("baseline_fingerprint"), F.lit(fc).alias("current_fingerprint"),
    )


def schema_flags(diff: DataFrame, approvals: Sequence[str] = ()) -> DataFrame:
    """R16 / R17 from the diff rows (nothing when the fingerprints agree or on approval)."""
    from .risk import APPROVE_SCHEMA, CRITICAL, DRIFT_DETECTED, SCHEMA_DTYPE_MISMATCH, WARNING, flag
    if APPROVE_SCHEMA in set(approvals):
        return flag(diff.limit(0), "drift", WARNING, DRIFT_DETECTED, None, F.lit(""), True)
    s = diff.filter(F.col("baseline_fingerprint") != F.col("current_fingerprint")).agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "dtype_changed", F.col("column_name")))).alias("changed"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "added", F.col("column_name")))).alias("added"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "removed", F.col("column_name")))).alias("removed"),
        F.count(F.lit(1)).alias("k"),
    ).filter(F.col("k") > 0)
    mismatch = flag(s.filter(F.size("changed") > 0), "drift", CRITICAL, SCHEMA_DTYPE_MISMATCH, None,
                    F.concat(F.lit("dtype changed: "), F.concat_ws(", ", "changed")), True)
    moved = flag(s.filter((F.size("changed") == 0) & ((F.size("added") > 0) | (F.size("removed") > 0))),
                 "drift", WARNING, DRIFT_DETECTED, None,
                 F.concat(F.lit("added: "), F.concat_ws(", ", "added"), F.lit("; removed: "), F.concat_ws(", ", "removed")),
                 True)
    return mismatch.unionByName(moved)


def _psi_from_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """counts: keys + bin/value + e (baseline count) + a (current count) + ne + na (side totals)."""
    pe = F.col("e") / F.col("ne")
    pa = F.col("a") / F.col("na")
    c = counts.withColumns({
        "pe": F.when(pe == 0, F.lit(PSI_EPS)).otherwise(pe),
        "pa": F.when(pa == 0, F.lit(PSI_EPS)).otherwise(pa),
    })
    # renormalise with per-column totals joined back by key (a high-cardinality column's
    # categories stay spread over tasks; a window per column would gather them in one)
    sums = c.groupBy(*keys).agg(F.sum("pe").alias("_se"), F.sum("pa").alias("_sa"))
    c = c.join(sums, list(keys)).withColumns({"pe": F.col("pe") / F.col("_se"), "pa": F.col("pa") / F.col("_sa")})
    return c.groupBy(*keys).agg(
        F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))).alias("psi"),
        F.count(F.lit(1)).alias("n_bins"))


def band(psi) -> F.Column:
    """D6."""
    return F.when(psi < PSI_STABLE, "stable").when(psi < PSI_DRIFT, "moderate").otherwise("drift")


def bin_edges(baseline: DataFrame, numeric: Sequence[str]) -> dict[str, list[float]]:
    """The edges of every numeric column with more than 10 distinct values: its 11 linear percentiles,
    without repeats, the outer ones padded."""
    b_exprs = {c: as_double(baseline, c) for c in numeric}
    bn = column_counts(baseline, b_exprs) if numeric else {}
    sketch = baseline.agg(*[F.approx_count_distinct(b_exprs[c]).alias(c) for c in numeric]).first() if numeric else {}
    near = [c for c in numeric if sketch[c] <= 4 * PSI_BINS]
    nd = {c: sketch[c] for c in numeric}
    if near:
        row = baseline.agg(*[F.count_distinct(b_exprs[c]).alias(c) for c in near]).first()
        nd.update({c: row[c] for c in near})
    binned = [c for c in numeric if bn[c] > 0 and nd[c] > PSI_BINS]
    probs = [i / PSI_BINS for i in range(PSI_BINS + 1)]
    q = exact_quantiles(baseline, {c: b_exprs[c] for c in binned}, probs, counts={c: bn[c] for c in binned}) \
        if binned else {}
    edges = {}
    for c in binned:
        e = sorted(set(q[(c, p)] for p in probs))
        if len(e) >= 2:
            e[0] -= PSI_EDGE_PAD
            e[-1] += PSI_EDGE_PAD
            edges[c] = e
    return edges


def psi(baseline: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D4 + D5 per column: numeric columns with more than 10 distinct baseline values are
    binned at the baseline's 11 linear percentiles; the others compare category shares.
    Values outside the outer edges are not counted but stay in the denominator."""
    cols = list(cols)
    numeric = [c for c in cols if is_numeric_type(baseline.schema[c].dataType)]
    edges = bin_edges(baseline, numeric)
    categorical = [c for c in cols if c not in edges]
    frames = []
    side_b, side_c = baseline.withColumn("_side", F.lit(0)), current.withColumn("_side", F.lit(1))
    if edges:
        def bins(df):
            out = []
            for c, e in edges.items():
                v = as_double(df, c)
                inner = sum((v >= F.lit(x)).cast("int") for x in e[1:-1]) if len(e) > 2 else F.lit(0)
                inside = F.when(v.isNotNull() & (v >= F.lit(e[0])) & (v <= F.lit(e[-1])), inner).otherwise(-1)
                out.append((c, inside, v.isNotNull()))
            return long_rows(df, [F.col("_side")], ["column_name", "bin", "present"], out)
        long = bins(side_b).unionByName(bins(side_c)).filter("present")
        cnt = long.groupBy("column_name", "bin").agg(
            F.count_if(F.col("_side") == 0).alias("e"), F.count_if(F.col("_side") == 1).alias("a"))
        tot = cnt.groupBy("column_name").agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
        # every bin 0..k-1 takes part (an empty bin gets the epsilon on both sides)
        allbins = baseline.sparkSession.createDataFrame(
            [(c, b) for c, e in edges.items() for b in range(len(e) - 1)], "column_name string, bin int")
        full = allbins.join(cnt.filter("bin >= 0"), ["column_name", "bin"], "left").fillna(0, ["e", "a"]) \
            .join(tot, "column_name").filter((F.col("ne") > 0) & (F.col("na") > 0))
        frames.append(_psi_from_counts(full, ["column_name"]).withColumn("method", F.lit("quantile_bins")))
    if categorical:
        def vals(df, side):
            return unpivot(df, [], categorical, name_col="column_name", value_type="string") \
                .filter(F.col("value").isNotNull()).withColumn("_side", F.lit(side))

        # a numeric column's categories compare as numbers (1 and 1.0 are one category)
        def cat_src(df):
            return df.select(*[as_double(df, c).alias(c) if c in numeric else F.col(f"`{c}`") for c in categorical])
        u = vals(cat_src(baseline), 0).unionByName(vals(cat_src(current), 1))
        cnt = u.groupBy("column_name", "value").agg(
            F.count_if(F.col("_side") == 0).alias("e"), F.count_if(F.col("_side") == 1).alias("a"))
        tot = cnt.groupBy("column_name").agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
        full = cnt.join(tot, "column_name").filter((F.col("ne") > 0) & (F.col("na") > 0))
        frames.append(_psi_from_counts(full, ["column_name"]).withColumn("method", F.lit("categories")))
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    # a column with an empty side scores 0
    every = baseline.agg(F.count(F.lit(1)).alias("_n")).select(
        F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))
    res = every.join(out, "column_name", "left").select(
        "column_name", F.coalesce("method", F.lit("empty")).alias("method"),
        F.coalesce(F.col("n_bins"), F.lit(0)).cast("bigint").alias("n_bins"),
        F.coalesce("psi", F.lit(0.0)).alias("psi"))
    # the band is decided on the exact value; only the shown one is rounded
    return res.withColumn("band", band(F.col("psi"))).withColumn("psi", r6(F.col("psi")))


def psi_flags(scores: DataFrame, target: str | None = None) -> DataFrame:
    """One warning listing every numeric column (not the target) with PSI >= 0.2."""
    from .risk import DRIFT_DETECTED, WARNING, flag
    s = scores.filter((F.col("band") == "drift") & (F.col("column_name") != F.lit(target or ""))) \
        .agg(F.sort_array(F.collect_list(F.struct("column_name", "psi"))).alias("cols")).filter(F.size("cols") > 0)
    desc = F.concat(F.lit("distribution shift in: "), F.array_join(
        F.transform("cols", lambda x: F.format_string("%s (PSI=%.3f)", x["column_name"], x["psi"])), ", "))
    return flag(s, "drift", WARNING, DRIFT_DETECTED, None, desc, False)
