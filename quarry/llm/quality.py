"""Quality classifier: kernel ridge on document statistics by random Fourier features, then isotonic calibration.

Statistics of each whole text (byte classes, words, repetition, lines) are standardised and mapped to
cos(Wx + b) features, which approximate a Gaussian kernel.  Every task adds its labelled rows to the
normal equations of their fold; Spark sums these small matrices, and the driver solves one system per
fold left out and one for all.  Scores of left-out folds, counted by score bin, are calibrated by the
pool-adjacent-violators rule.

Defined cases: a null text counts as empty, and empty texts get the score their statistics (all zero)
get; null labels are ignored and repeated labels of a document are averaged; without any usable
label every score is 1 (nothing is rejected); other columns pass through, and a column named like an
added one is replaced.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_remainder, pin

FEATURES = 256
BANDWIDTH = 4.0
RIDGE = 0.3
FOLDS = 3
CLIP = 4.0
THRESHOLD = 0.7
SEED = 7
ROWS_PER_SUM = 20_000
_BINS, _LOW, _HIGH = 2000, -0.5, 1.5

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n",
            b".", b",", b"!?", b";:'\"()-", b"|<>{}[]\\/=_~^`+@", b"%$&#*", bytes(range(0x80, 0x100))]
_CLASS_OF = np.stack([np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in _CLASSES], axis=1).astype(np.float64)
N_STATS = len(_CLASSES) + 12


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all zero for the empty text."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = hist / n
    seen = share[share > 0]
    words, lines = text.lower().split(), text.split(b"\n")
    nw = len(words) or 1
    first, second = words, words[1:]
    return [
        *np.sqrt(share @ _CLASS_OF).tolist(),
        math.log1p(n), math.log1p(len(words)), n / nw if words else 0.0,
        float(-(seen * np.log2(seen)).sum()), float(seen.max()),
        len(set(words)) / math.sqrt(nw), len(set(words)) / nw,
        sum(map(operator.eq, first, second)) / nw,
        len(set(zip(first, second))) / nw,
        len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(n / len(lines)),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(stats, pa.list_(pa.float32()))], ["doc_id", "stats"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<float>")


class Model:
    """Standardisation, Fourier map, ridge weights and calibration (a few hundred kilobytes)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(0, 1 / BANDWIDTH, (len(mean), FEATURES))
        self.b = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        z = np.cos(x @ self.w + self.b) * math.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or self.curve is None:
            return np.ones(len(stats))
        return np.interp(self.map(stats) @ self.weights, *self.curve)


def _solve(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    penalty = np.full(len(gram), RIDGE)
    penalty[-1] = 1e-6  # the constant is hardly penalised
    return np.linalg.solve(gram + np.diag(penalty), target)


def isotonic(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weighted pool-adjacent-violators: the non-decreasing fit of total / n, one value per bin."""
    blocks: list[list[float]] = []
    for count, s in zip(n.tolist(), total.tolist()):
        blocks.append([count, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c, s, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c, blocks[-1][1] + s, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), s / c) for c, s, k in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``stats``: (doc_id, stats); ``labels``: (doc_id, label).  All labelled rows are used."""
    label = labels.filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.avg("label").alias("y"))
    rows = pin(stats.join(label, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")))
    x = [F.col("stats")[i].cast("double") for i in range(N_STATS)]
    sums = rows.agg(F.count(F.lit(1)), F.countDistinct("y"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    count = sums[0]
    if count < 2 or sums[1] < 2:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    scale = np.array(sums[2 + N_STATS:], dtype=float)
    model = Model(np.array(sums[2:2 + N_STATS], dtype=float), np.where(scale > 1e-9, scale, 1.0))
    held = rows.sparkSession.sparkContext.broadcast(model)
    d = FEATURES + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d, d + 1))
        for b in batches:
            z = held.value.map(_matrix(b["stats"]))
            y, fold = b["y"].to_numpy(zero_copy_only=False), b["fold"].to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                own = z[fold == k]
                total[k] += own.T @ np.concatenate([own, y[fold == k, None]], axis=1)
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * d, pa.int32()), pa.array(range(d), pa.int32()),
                 pa.array(list(total[k]), pa.list_(pa.float64()))], ["fold", "i", "v"])

    # tasks in proportion to the labelled rows, so that the summed matrices stay a small share of them
    parts = rows.coalesce(max(1, min(rows.rdd.getNumPartitions(), -(-count // ROWS_PER_SUM))))
    sums = (parts.mapInArrow(add_up, "fold int, i int, v array<double>")
            .select("fold", "i", F.posexplode("v").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
            .groupBy("fold", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v")))["v"].alias("v")))
    total = np.zeros((FOLDS, d, d + 1))
    for r in sums.collect():  # FOLDS matrices of a fixed size
        total[r["fold"], r["i"]] = r["v"]
    whole = total.sum(axis=0)
    left_out = np.stack([_solve((whole - t)[:, :d], (whole - t)[:, d]) for t in total], axis=1)
    model.weights = _solve(whole[:, :d], whole[:, d])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (held.value.map(_matrix(b["stats"])) @ left_out)[
                np.arange(b.num_rows), b["fold"].to_numpy(zero_copy_only=False)]
            cell = np.clip((raw - _LOW) / (_HIGH - _LOW) * _BINS, 0, _BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b["y"]], ["cell", "y"])

    cells = sorted(tuple(r) for r in rows.mapInArrow(out_of_fold, "cell int, y double").groupBy("cell")
                   .agg(F.count(F.lit(1)), F.sum("y")).collect())  # at most _BINS rows
    cell, n, s = (np.array(v, dtype=float) for v in zip(*cells))
    fitted = isotonic(n, s)
    at = _LOW + (cell + 0.5) * (_HIGH - _LOW) / _BINS
    model.curve = (at, np.clip(fitted, 0.0, 1.0))
    return model


def _matrix(stats: pa.Array) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, stats)."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(held.value.score(_matrix(b["stats"])))],
                                             ["doc_id", "score"])

    return stats.mapInArrow(work, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def training_labels(labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows that may be learned from."""
    own = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    return own.filter(crc_remainder(F.col("doc_id"), modulus) != held_out)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; ``labels`` is (doc_id, label)."""
    stats = pin(with_statistics(docs, id_col, text_col))
    return score_statistics(stats, fit(stats, labels))


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows.  Texts are scored where they lie: no row is shuffled."""
    model = fit(pin(with_statistics(docs, id_col, text_col)), labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in b[text_col]])
            good = held.value.score(stats.reshape(-1, N_STATS).astype(np.float32).astype(np.float64)) >= THRESHOLD
            yield b.filter(pa.array(good))

    return docs.mapInArrow(work, T.StructType(docs.schema.fields))
