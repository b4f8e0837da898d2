"""Query: similar earlier runs (Z7) over versions of all tables: monthly and daily batches, whole tables, and
the eight corruptions (C1-C8) of ``orders``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import pin
from ..operators import corrupt, similar
from ..sources import files
from . import sqlkit
from .registry import query
from .tables import SCHEMAS, kind, load

BATCHES = {"orders": ("o_orderdate", "month"), "lineitem": ("l_shipdate", "month"), "events": ("ts", "day")}
WHOLE = ["customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"]
# batches are numbered by their first day, whole tables and corruptions come after them
WHOLE_AT, CORRUPT_AT = 1_000_000, 2_000_000


def _corruptions(o: DataFrame) -> dict[str, DataFrame]:
    key = ["o_orderkey"]
    return {
        "c1": corrupt.missing_column_names(o), "c2": corrupt.duplicate_rows(o, key),
        "c3": corrupt.target_leakage_inject(o, "o_totalprice"), "c4": corrupt.dtype_change(o, "o_custkey"),
        "c5": corrupt.null_burst(o, "o_totalprice", key), "c6": corrupt.unseen_categories(o, "o_orderpriority", key),
        "c7": corrupt.extreme_outliers(o, "o_totalprice", key), "c8": corrupt.changed_column_order(o),
    }


def run_vectors(spark, sf) -> DataFrame:
    parts = []
    for t, (col, unit) in BATCHES.items():
        day = F.trunc(F.col(col).cast("date"), "month") if unit == "month" else F.col(col).cast("date")
        parts.append(similar.profile_vectors(load(spark, sf, t).filter(F.col(col).isNotNull()),
                                             F.concat(F.lit(f"{t}:"), day.cast("string")), F.unix_date(day)))
    for i, t in enumerate(WHOLE):
        parts.append(similar.profile_vectors(load(spark, sf, t), F.lit(t), F.lit(WHOLE_AT + i)))
    for i, (name, df) in enumerate(_corruptions(load(spark, sf, "orders")).items()):
        parts.append(similar.profile_vectors(df, F.lit(f"orders:{name}"), F.lit(CORRUPT_AT + i)))
    return reduce(DataFrame.unionByName, parts)


def _vector_sql(src: str, schema, run: str, at: str) -> str:
    cells = [["0.0"] for _ in range(similar.SLOTS * similar.ENTRIES)]

    def squash(x):
        return f"sign({x}) * ln(1 + abs({x})) / 10"
    for c, t, name in schema:
        q = f'"{c}"'
        v = {"numeric": f"CAST({q} AS DOUBLE)", "datetime": f"date_diff('day', DATE '1970-01-01', CAST({q} AS DATE))::DOUBLE",
             "categorical": f"length({q})::DOUBLE"}[kind(t)]
        if t in ("double", "float"):
            v = f"CASE WHEN NOT isnan({q}) THEN {q} END"
        at_ = similar.slot(name) * similar.ENTRIES
        own = ["1.0", f"1 - count({v})::DOUBLE / count(*)", squash(f"coalesce(avg({v}), 0.0)"), squash(f"coalesce(stddev_pop({v}), 0.0)")]
        for e, x in enumerate(own):
            cells[at_ + e].append(f"({x})")
    lead = ["ln(1 + count(*)::DOUBLE) / 10", f"{len(schema) / 10.0!r}"]
    body = ", ".join(lead + [" + ".join(c) for c in cells])
    return f"SELECT {run} AS run_id, CAST({at} AS BIGINT) AS run_at, [{body}]::DOUBLE[] AS v FROM ({src}) GROUP BY 1, 2 HAVING count(*) > 0"


def _runs_sql() -> str:
    parts = []

    def own(t):
        return [(c, k, c) for c, k in SCHEMAS[t]]
    for t, (col, unit) in BATCHES.items():
        day = f"CAST(date_trunc('{unit}', {col}) AS DATE)"
        parts.append(_vector_sql(f"SELECT *, {day} AS _day FROM {t} WHERE {col} IS NOT NULL", own(t),
                                 f"'{t}:' || CAST(_day AS VARCHAR)", "date_diff('day', DATE '1970-01-01', _day)"))
    for i, t in enumerate(WHOLE):
        parts.append(_vector_sql(f"SELECT * FROM {t}", own(t), f"'{t}'", f"{WHOLE_AT + i}"))
    o, key = "SELECT * FROM orders", ["o_orderkey"]
    cols = own("orders")
    versions = {
        "c1": (o, [(c, k, "" if i == 0 else n) for i, (c, k, n) in enumerate(cols)]),
        "c2": (sqlkit.duplicate_rows(o, key, 0.25), cols),
        "c3": ("SELECT *, o_totalprice AS o_totalprice_outcome, 2 * o_totalprice AS leakage_val FROM orders",
               [*cols, ("o_totalprice_outcome", "double", "o_totalprice_outcome"), ("leakage_val", "double", "leakage_val")]),
        "c4": ("SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey) FROM orders",
               [(c, "string" if c == "o_custkey" else k, n) for c, k, n in cols]),
        "c5": (sqlkit.null_burst(o, "o_totalprice", key, 0.4), cols),
        "c6": (sqlkit.leading_rows(o, "o_orderkey", "o_orderpriority", "'UNSEEN_CAT_XYZ'"), cols),
        "c7": (sqlkit.leading_rows(o, "o_orderkey", "o_totalprice", "(SELECT (max(o_totalprice) + 1) * 1000 FROM orders)"), cols),
        "c8": (o, cols[::-1]),
    }
    for i, (name, (src, schema)) in enumerate(versions.items()):
        parts.append(_vector_sql(src, schema, f"'orders:{name}'", f"{CORRUPT_AT + i}"))
    return sqlkit.union_all(parts)


@query("similar_runs", sql=f"""WITH r AS ({_runs_sql()}),
u AS (SELECT run_id, run_at, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM r),
p AS (SELECT q.run_id, s.run_id AS similar_run, s.run_at AS s_at,
             list_sum(list_transform(range(1, {similar.DIM + 1}), lambda i: q.v[i] * s.v[i])) / (q.norm * s.norm) AS cosine
      FROM u q JOIN u s ON s.run_at < q.run_at AND q.run_at >= {WHOLE_AT}),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(cosine, 9) DESC, similar_run, s_at) AS rank FROM p)
SELECT run_id, rank::INT AS rank, similar_run, round(cosine, 6) AS cosine FROM k WHERE rank <= 3""")
def q_similar_runs(spark, sf):
    """Whole tables and corrupted versions against every earlier stored version, top 3 by cosine."""
    runs = pin(run_vectors(spark, sf))
    path = files.scratch_path(spark, "runs")
    similar.write_index(runs, path)
    return similar.similar_runs(path, runs.filter(F.col("run_at") >= WHOLE_AT))
