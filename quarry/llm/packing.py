"""Bounded-space best-fit packing of tokenised documents into sequences of a fixed length.

Every task encodes its documents, cuts only those that are longer than a sequence (the first piece takes
the remainder, all others are full) and packs the pieces as they come: at most ``OPEN_BINS`` bins are open,
a bitset keyed by free space names those that exist, and a piece goes to the bin whose space fits best.
Where none fits a new bin is opened, for which the fullest open one closes if all are in use.  A bin's
pieces are held until it closes and leave as one whole sequence, so memory is bounded by the open bins.
Pieces arrive in stretches of ``STRETCH``, the longest of a stretch first.

Nothing is shuffled at that level.  Bins that are still open and not nearly full when a task ends (at most
``OPEN_BINS`` of them) are emptied; their pieces, and only these, are dealt to a few streams and packed
once more, so that small input splits don't cost sequences.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` is kept; rows that repeat an id
are packed each by itself; a text of any length is cut into as many pieces as it needs; no text is
dropped; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches
from .piecewise import encoder

CAPACITY = 2048
END = 0
#: Open bins of a packer; each holds less than one sequence of ids.
OPEN_BINS = 4096
#: Pieces of which the longest is placed first.
STRETCH = 8192
#: Characters of text encoded at a time.
TEXT = 12 << 20
#: Pieces of one stream of the second level.
STREAM = 1 << 16

_COLUMNS = ("doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint, "
            "left_over boolean")
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]

Piece = tuple  # (doc_id, piece, start, length, ids)


class Packer:
    """Best fit over at most ``limit`` open bins; closed bins wait in ``closed`` as (number, pieces)."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.free = 0  # bit f is set if some open bin has f ids of space
        self.bins: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0
        self.closed: list[tuple[int, list[Piece]]] = []

    def _take(self, space: int) -> tuple[int, list[Piece]]:
        own = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1
        return own

    def add(self, piece: Piece) -> None:
        length = piece[3]
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number, own = self._take(space)
        else:
            if self.open == self.limit:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            number, own, space = self.made, [], self.capacity
            self.made += 1
        own.append(piece)
        space -= length
        if space:
            self.bins[space].append((number, own))
            self.free |= 1 << space
            self.open += 1
        else:
            self.closed.append((number, own))

    def add_all(self, pieces: list[Piece]) -> None:
        for p in sorted(pieces, key=lambda p: -p[3]):
            self.add(p)

    def done(self) -> list[tuple[int, list[Piece]]]:
        """The bins closed since the last call."""
        out, self.closed = self.closed, []
        return out

    def rest(self) -> list[tuple[int, int, list[Piece]]]:
        """(free space, number, pieces) of the bins that are still open."""
        return [(space, *b) for space, own in enumerate(self.bins) for b in own]


def cut(doc_id: int | None, ids: np.ndarray, capacity: int = CAPACITY) -> list[Piece]:
    """The pieces of one document: whole, or a remainder followed by full pieces."""
    n = len(ids)
    if n <= capacity:
        return [(doc_id, 0, 0, n, ids.astype("<u4").tobytes())]
    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return [(doc_id, k, a, b - a, ids[a:b].astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def _batch(bins: list[tuple[int, list[Piece]]], name, left_over: bool = False) -> pa.RecordBatch:
    rows = []
    for number, own in bins:
        at = 0
        for p in own:
            rows.append((*p, name(number), at, left_over))
            at += p[3]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _NAMES)


def _sequence_names(level: int):
    """Numbers of sequences that no other task and no other level gives."""
    part = TaskContext.get().partitionId()
    return lambda number: part << 40 | number << 1 | level


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``TEXT`` characters at a time, or of one longer text."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids.append(doc)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= TEXT:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of every document.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers; ``start`` counts the document's
    ids before the piece, ``offset`` the sequence's.  Sequence numbers are unique and have gaps.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, name = encoder(held.value), Packer(capacity), _sequence_names(0)
        stop, waiting = np.array([end], tokens.kind).tobytes(), []
        for doc_ids, texts in _texts(batches):
            for doc, ids in zip(doc_ids, tokens.encode(texts)):
                waiting += cut(doc, np.frombuffer(ids + stop, tokens.kind), capacity)
                if len(waiting) >= STRETCH:
                    packer.add_all(waiting)
                    waiting = []
                    yield _batch(packer.done(), name)
        packer.add_all(waiting)
        rest = packer.rest()
        yield _batch(packer.done() + [(n, own) for space, n, own in rest if space <= capacity // 64], name)
        yield _batch([(n, own) for space, n, own in rest if space > capacity // 64], name, left_over=True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, name, waiting = Packer(capacity), _sequence_names(1), []
        for b in batches:
            waiting += zip(*(b.column(c).to_pylist() for c in _NAMES[:5]))
            if len(waiting) >= STRETCH:
                packer.add_all(waiting)
                waiting = []
                yield _batch(packer.done(), name)
        packer.add_all(waiting)
        yield _batch(packer.done() + [(n, own) for _, n, own in packer.rest()], name)

    scratch = Scratch(spark)
    scratch.keep()  # the written tables are the result: they stay until the driver ends
    first = scratch.stash(rows.mapInArrow(work, _COLUMNS))
    left = first.filter("left_over")
    streams = -(-left.count() // STREAM)
    placed = first.filter("NOT left_over")
    if streams:
        placed = placed.unionByName(scratch.stash(left.repartition(streams, "sequence_id").mapInArrow(again, _COLUMNS)))
    return placed.drop("left_over")
