"""SQL text for the oracle side: the same corruptions and rank rules in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.columns import phash_sql


def rank_over(key_cols: Sequence[str], seed: int, partition: Sequence[str] = (),
              hash_cols: Sequence[str] | None = None) -> str:
    part = f"PARTITION BY {', '.join(partition)} " if partition else ""
    return f"(row_number() OVER ({part}ORDER BY {phash_sql(hash_cols or key_cols, seed)}, {', '.join(key_cols)}) - 1)"


def count_over(partition: Sequence[str] = ()) -> str:
    part = f"PARTITION BY {', '.join(partition)}" if partition else ""
    return f"count(*) OVER ({part})"


def null_burst(src: str, col: str, key_cols: Sequence[str], frac: float, seed: int = 42) -> str:
    bp = int(round(frac * 10_000))
    return (f"SELECT * EXCLUDE (_r, _n) REPLACE (CASE WHEN _r < (_n * {bp}) // 10000 THEN NULL ELSE {col} END AS {col}) "
            f"FROM (SELECT *, {rank_over(key_cols, seed)} AS _r, {count_over()} AS _n FROM ({src}))")


def duplicate_rows(src: str, key_cols: Sequence[str], frac: float, seed: int = 42,
                   hash_cols: Sequence[str] | None = None) -> str:
    bp = int(round(frac * 10_000))
    return (f"SELECT * FROM ({src}) UNION ALL SELECT * EXCLUDE (_r, _n) FROM "
            f"(SELECT *, {rank_over(key_cols, seed, (), hash_cols)} AS _r, {count_over()} AS _n FROM ({src})) "
            f"WHERE _r < (_n * {bp}) // 10000")


def leading_rows(src: str, key: str, col: str, value_sql: str) -> str:
    return (f"SELECT * REPLACE (CASE WHEN {key} IN (SELECT {key} FROM ({src}) ORDER BY {key} LIMIT 5) "
            f"THEN {value_sql} ELSE {col} END AS {col}) FROM ({src})")


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def missing_sql(col: str, simple_type: str) -> str:
    if simple_type in ("double", "float"):
        return f"({col} IS NULL OR isnan({col}))"
    return f"({col} IS NULL)"


def clean_sql(col: str, simple_type: str) -> str:
    if simple_type in ("double", "float"):
        return f"(CASE WHEN NOT isnan({col}) THEN {col} END)"
    return col
