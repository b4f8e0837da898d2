"""Exact top-k search by distributed histogram selection.

Queries are handled in blocks of a bounded size.  For each block every task scores all its rows
against all queries of the block, counts the scores into a histogram per query and reports the bins
from the top down to its own kth score (the global kth score can't lie lower).  The summed bins show
in which bin each query's kth score lies; that bin becomes the next round's range, until bins are one
score wide and the kth value is known exactly.  A last pass keeps the scores above it and, of the
scores equal to it, each task's smallest ids; ranks then follow score and id.

Scores are recomputed in each round instead of being stored: the data that moves is a few bins a task
and query, whatever the number of rows.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows
with a null id; vectors meet only vectors of their own length (those of other lengths are no
candidates); a query that is listed twice is looked up once and answered twice; rows that share an id are candidates
each by itself, but never for a query of that id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, pin

SCALE = 256
BINS = 256
#: Bytes of query vectors in a block; with BINS counters a query this also bounds a task's histogram.
BLOCK_BYTES = 8 << 20
BLOCK_QUERIES = 16_384
_CELLS = 1 << 21


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<bigint>) with v = floor(scale * x) of every usable row."""
    v = F.col(f"`{vec_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~bad).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


class QueryBlock:
    """Queries of one block, by vector length; numbers them 0..n-1."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        rows = sorted(rows, key=lambda r: len(r[1]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.n, self.parts, at = len(rows), [], 0
        while at < self.n:
            dim = len(rows[at][1])
            end = next((k for k in range(at, self.n) if len(rows[k][1]) != dim), self.n)
            self.parts.append((dim, at, end, np.array([r[1] for r in rows[at:end]], np.int64).reshape(end - at, dim)))
            at = end

    def bound(self, largest: int) -> np.ndarray:
        """No score of a query is beyond this, if no component is beyond ``largest``."""
        return np.concatenate([np.abs(q).sum(axis=1) * largest for *_, q in self.parts])

    def scores(self, batch: pa.RecordBatch, largest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first query, last, ids, scores, own): integer products of candidates (rows) and queries (columns)."""
        ids = batch["id"].to_numpy(zero_copy_only=False)
        sizes = np.diff(batch["v"].offsets.to_numpy())
        flat = batch["v"].values.to_numpy(zero_copy_only=False)
        starts = batch["v"].offsets.to_numpy()[:-1]
        for dim, lo, hi, q in self.parts:
            rows = np.flatnonzero(sizes == dim)
            own = flat[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0), np.int64)
            # whole numbers below 2^53 are exact as doubles, which have the fast product
            exact = float(np.abs(q).max(initial=0)) * largest * max(1, dim) < 2.0 ** 53
            step = max(1, _CELLS // (hi - lo))
            for k in range(0, len(rows), step):
                x = own[k:k + step]
                s = (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64) if exact else x @ q.T
                yield lo, hi, ids[rows[k:k + step]], s, ids[rows[k:k + step]][:, None] == self.ids[None, lo:hi]


def _top_bins(table: DataFrame, block, state, k: int, largest: int) -> DataFrame:
    """(q, bin, n): histogram of the scores in each query's range, from the top down to k scores a task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (low, high, width, need) = block.value, state.value
        counts = np.zeros((queries.n, BINS), np.int64)
        for b in batches:
            for lo, hi, _, s, own in queries.scores(b, largest):
                cell = (s - low[lo:hi]) // width[lo:hi]
                use = (s >= low[lo:hi]) & (s < high[lo:hi]) & ~own
                flat = (cell + np.arange(hi - lo) * BINS)[use]
                counts[lo:hi] += np.bincount(flat, minlength=(hi - lo) * BINS).reshape(hi - lo, BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, cell = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[q, cell])],
                                         ["q", "bin", "n"])

    return table.mapInArrow(work, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_bins(bins: DataFrame, need: DataFrame) -> DataFrame:
    """(q, bin, above): the bin in which the sum from the top reaches what is needed, and the sum above it."""
    down = Window.partitionBy("q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = bins.withColumn("total", F.sum("n").over(down)).join(need, "q")
    hit = total.filter((F.col("total") >= F.col("need")) & (F.col("total") - F.col("n") < F.col("need")))
    return hit.select("q", "bin", (F.col("total") - F.col("n")).alias("above"))


def _block_top(table: DataFrame, rows: list[tuple[int, list[int]]], k: int, largest: int) -> DataFrame:
    """(query_id, q, vec_id, score) of all candidates at or above each query's kth score, ties thinned by task."""
    spark = table.sparkSession
    block = QueryBlock(rows)
    held = spark.sparkContext.broadcast(block)
    bound = block.bound(max(1, largest))
    low, high, width = -bound, bound + 1, (2 * bound) // BINS + 1
    need, open_ = np.full(block.n, k, np.int64), np.ones(block.n, bool)
    while open_.any():
        state = spark.sparkContext.broadcast((low, high, width, np.where(open_, need, 0)))
        wanted = spark.createDataFrame([(int(q), int(need[q])) for q in np.flatnonzero(open_)], "q int, need bigint")
        found = _kth_bins(_top_bins(table, held, state, k, largest), wanted).collect()  # one row a query of the block
        met = {r["q"]: r for r in found}
        for q in np.flatnonzero(open_):
            if q not in met:  # fewer candidates than asked for: all are taken
                open_[q] = False
                continue
            low[q] += met[q]["bin"] * width[q]
            high[q] = min(high[q], low[q] + width[q])
            need[q] -= met[q]["above"]
            open_[q] = width[q] > 1
            width[q] = -(-width[q] // BINS)
    final = spark.sparkContext.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floor = held.value, final.value
        ties: dict[int, list[int]] = {}
        for b in batches:
            for lo, hi, ids, s, own in queries.scores(b, largest):
                r, c = np.nonzero((s > floor[lo:hi]) & ~own)
                yield _rows(queries, c + lo, ids[r], s[r, c])
                r, c = np.nonzero((s == floor[lo:hi]) & ~own)
                order = np.lexsort((ids[r], c))
                r, c = r[order], c[order]
                first = np.arange(len(c)) - np.searchsorted(c, c) < k
                for q, i in zip((c[first] + lo).tolist(), ids[r[first]].tolist()):
                    ties.setdefault(q, []).append(i)
                for q in np.unique(c[first] + lo).tolist():
                    ties[q] = sorted(ties[q])[:k]
        q = np.array([q for q, own in ties.items() for _ in own], np.int64)
        yield _rows(queries, q, np.array([i for own in ties.values() for i in own], np.int64), final.value[q])

    return table.mapInArrow(keep, "query_id bigint, q int, vec_id bigint, score bigint")


def _rows(queries: QueryBlock, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(queries.ids[q]), pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())],
        ["query_id", "q", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``is_query(id)`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 10_000)
    with Scratch(spark) as scratch:
        table = scratch.stash(quantised(vectors, id_col, vec_col, scale))
        # repeated queries would fill one block, so each is asked once
        queries = scratch.stash(table.filter(is_query).groupBy("id", "v").agg(F.count("*").alias("times")))
        size = table.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.max(F.size("v"))).first()
        largest, dim = size[0] or 0, max(1, size[1] or 0)
        per_block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * dim)))
        n_blocks = max(1, -(-2 * queries.count() // per_block))  # half full on average: none overflows
        best, order = None, Window.partitionBy("query_id", "block", "q").orderBy(F.desc("score"), "vec_id")
        for b in range(n_blocks):
            own = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == b)
            # at most per_block rows, in the order in which a block numbers them
            rows = sorted(((r["id"], r["v"], r["times"]) for r in own.collect()), key=lambda r: len(r[1]))
            if rows:
                near = _block_top(table, [r[:2] for r in rows], k, largest).withColumn("block", F.lit(b))
                ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                times = spark.createDataFrame([(q, r[2]) for q, r in enumerate(rows)], "q int, times bigint")
                each = F.explode(F.sequence(F.lit(1), F.col("times")))  # a row of answers for every row that asked
                top = pin(ranked.join(F.broadcast(times), "q").withColumn("_each", each)
                          .select("query_id", "rank", "vec_id", "score"))
                best = top if best is None else best.unionByName(top)
    return best if best is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
