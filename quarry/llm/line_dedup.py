"""Line dedup: lines that many documents share stay in one document only.

Method (DataFrame functions only): explode the normalised lines as 128-bit hashes, count distinct
documents per hash, keep the hashes over the threshold with the document that keeps the line,
bring the positions to drop back to each document as one sorted array, and rebuild its text from
the runs of lines between those positions.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` never keeps a shared line
unless all its holders are null; rows that repeat a ``doc_id`` count as one document when documents
are counted, and each of them is cleaned; other columns pass through untouched, but
one named like an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, ascii_lower, hash128, heavy_split_join, pin

MIN_CHARS = 20
MIN_DOCS = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(d, t, pos, h1, h2) of every line long enough to be judged; t tells rows of one id apart."""
    lines = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"),
                        F.posexplode(lines_of(F.col(f"`{text_col}`"))).alias("pos", "line"))
    keys = lines.select("d", "t", "pos", line_key(F.col("line")).alias("key"))
    a, b = hash128(F.col("key"))
    return keys.filter(F.length("key") >= min_chars).select("d", "t", "pos", a.alias("h1"), b.alias("h2"))


def shared_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_rows, keeper) of every key found in at least ``min_docs`` documents.

    Two-step count: (hash, document) first, then hash; both steps combine before their shuffle,
    so a line held by a third of all documents arrives as one row from each task.
    """
    per_doc = hashes.groupBy("h1", "h2", "d").agg(F.count(F.lit(1)).alias("n"))
    return (per_doc.groupBy("h1", "h2")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_rows"), F.max("d").alias("keeper"))
            .filter(F.col("n_docs") >= min_docs).drop("n_docs"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the cleaned text in ``text_col`` and the columns ``n_lines`` and ``n_dropped`` added."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")])
    with Scratch(docs.sparkSession) as scratch:
        hashes = scratch.stash(line_hashes(docs, min_chars, id_col, text_col))
        shared = scratch.stash(shared_lines(hashes, min_docs))
        lost = heavy_split_join(hashes, shared, ["h1", "h2"], "n_rows").filter(
            ~F.col("d").eqNullSafe(F.col("keeper")))
        drops = pin(lost.groupBy("d", "t").agg(F.sort_array(F.collect_set("pos")).alias("__drop")))
    return _rebuild(docs, drops, id_col, text_col)


def _rebuild(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Join the drop positions to the rows; the lines travel as an array, split once."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.xxhash64(F.col(f"`{text_col}`")).alias("__t"),
                       lines_of(F.col(f"`{text_col}`")).alias("__lines"))
    drops = drops.select(F.col("d").alias("__d"), F.col("t").alias("__t2"), "__drop")
    joined = rows.join(
        drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__t2")), "left")
    lines, drop = F.col("__lines"), F.col("__drop")
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), drop).alias("a"),
                        F.concat(drop, F.array(F.size(lines))).alias("b"))
    runs = F.transform(ends, lambda r: F.slice(lines, r["a"] + 2, r["b"] - r["a"] - 1))
    text = F.when(drop.isNotNull(), F.array_join(F.flatten(runs), "\n")).otherwise(F.array_join(lines, "\n"))
    out = [text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, F.size(lines).cast("bigint").alias("n_lines"),
                         F.when(drop.isNotNull(), F.size(drop)).otherwise(0).cast("bigint").alias("n_dropped"))
