"""SimHash near-dedup by a Gray-order hierarchical index.

Fingerprints: bit i of a document's fingerprint is set when it is set in over half of the XXH64
hashes of its word shingles.  Equal fingerprints collapse to one entry before any comparison.

Index: the distinct fingerprints are sorted by Gray rank, so neighbours share bits, and cut into
blocks of consecutive ranks.  Within a block every FANOUT consecutive nodes have a parent that holds
the bits all its fingerprints share (a mask) and their values (the pattern).  Two nodes are compared
by the differences accumulated on the bits both masks hold; beyond the radius the whole pair of
groups is pruned, else their children are paired, down to single fingerprints, whose difference is
the exact Hamming distance.

Distribution: the roots' (mask, pattern) pairs, one per block, go to every task (their number is
bounded, see ``block_size``); each block is sent to the pairs of blocks that its root cannot prune,
and each pair is joined in its own task.  A task returns a spanning forest of the links it found, so
a group of near copies gives as many rows as it has members, not as many as it has pairs; the forest
keeps every connection.  Components are then found by star contraction.

Defined cases: null or empty texts have fingerprint 0 and link like any other; a null ``doc_id`` gets
its group's smallest id that is not null; repeated rows are members of one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import space_words
from .common import Scratch, bounded_batches, heavy_split_join, pin
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
FANOUT = 16
BLOCKS = 48
MIN_BLOCK = 2048
MAX_BLOCK = 1 << 20
_CHUNK = 1 << 16
_PAIRS = 1 << 20
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    n = len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo = np.concatenate([[0], ends[:n - 1]])
    hi = ends[shingle - 1:] - 1
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(lo[k:k + _CHUNK].tolist(), hi[k:k + _CHUNK].tolist())),
                             np.uint64, min(_CHUNK, n - k))
        counts += _bit_counts(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: by byte value, so 8 small histograms do the work."""
    if len(hashes) < 256:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)
    cols = hashes.view(np.uint8).reshape(-1, 8)
    hist = np.stack([np.bincount(cols[:, i], minlength=256) for i in range(8)])
    return (hist @ _BYTE_BITS).reshape(64)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) with fp the fingerprint's 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
                       F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"", shingle) for v in b["text"]],
                           dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The position of each 64-bit word in the reflected Gray code (the running parity of its bits)."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(col: str) -> Column:
    """The Gray rank as a sortable long column (the unsigned rank with its top bit flipped)."""
    rank = F.col(col)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def block_size(n: int) -> int:
    """Fingerprints a block: about BLOCKS blocks in all, up to MAX_BLOCK (8 MB) a block."""
    return max(MIN_BLOCK, min(MAX_BLOCK, -(-n // BLOCKS)))


def parents(mask: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of every FANOUT consecutive nodes: the bits that all of them hold alike."""
    at = np.arange(0, len(mask), FANOUT)
    ones = np.bitwise_and.reduceat(pattern & mask, at)
    zeros = np.bitwise_and.reduceat(~pattern & mask, at)
    return ones | zeros, ones


class GrayTree:
    """Levels of (mask, pattern) over fingerprints sorted by Gray rank; level 0 are the fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.levels = [(np.full(len(fps), _ONES), fps)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(parents(*self.levels[-1]))

    def root(self) -> tuple[int, int]:
        mask, pattern = self.levels[-1]
        return int(mask[0]), int(pattern[0])


def links(a: GrayTree, b: GrayTree, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of fingerprints within ``radius`` bits, by descending both trees at once.

    The trees are first brought to one height; a stack of node pairs keeps memory bounded.
    ``same``: the two trees are one, and each pair is given once, with i < j.
    """
    top = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > _PAIRS:
            half = len(i) // 2
            stack += [(k, i[half:], j[half:]), (k, i[:half], j[:half])]
            continue
        (ma, pa_), (mb, pb) = level(a, k), level(b, k)
        near = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= radius
        i, j = i[near], j[near]
        if not len(i):
            continue
        if k == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        for lo in range(0, len(i), _PAIRS // (FANOUT * FANOUT)):
            ci = _children(i[lo:lo + _PAIRS // (FANOUT * FANOUT)], a, k)
            cj = _children(j[lo:lo + _PAIRS // (FANOUT * FANOUT)], b, k)
            left = np.broadcast_to(ci[:, :, None], (len(ci), ci.shape[1], cj.shape[1])).reshape(-1)
            right = np.broadcast_to(cj[:, None, :], (len(cj), ci.shape[1], cj.shape[1])).reshape(-1)
            ok = (left < len(level(a, k - 1)[0])) & (right < len(level(b, k - 1)[0]))
            if same:
                ok &= left <= right
            stack.append((k - 1, left[ok], right[ok]))


def _children(nodes: np.ndarray, tree: GrayTree, k: int) -> np.ndarray:
    """Numbers of the nodes' children on level k - 1 (past the end: no such child)."""
    if k >= len(tree.levels):
        return nodes[:, None]
    return nodes[:, None] * FANOUT + np.arange(FANOUT)


class Forest:
    """Disjoint sets over 0..n-1, joined by whole arrays of pairs; keeps the smallest member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def blocks_of(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, fps binary, mask, pattern): the distinct fingerprints in Gray order, block by block."""
    size = block_size(fps.count())
    parts = fps.select("fp").repartitionByRange(gray_order("fp")).sortWithinPartitions(gray_order("fp"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, no, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)

        def out(values: np.ndarray) -> pa.RecordBatch:
            mask, pattern = GrayTree(values).root()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + no], pa.int64()), pa.array([values.tobytes()], pa.binary()),
                 pa.array([np.uint64(mask).view(np.int64)]), pa.array([np.uint64(pattern).view(np.int64)])],
                ["block", "fps", "mask", "pattern"])

        for b in batches:
            held = np.concatenate([held, b["fp"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            while len(held) >= size:
                yield out(held[:size])
                held, no = held[size:], no + 1
        if len(held):
            yield out(held)

    return scratch.stash(parts.mapInArrow(pack, "block bigint, fps binary, mask bigint, pattern bigint"))


def near_links(fps: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within ``radius`` bits, as forests (checkpointed)."""
    spark = fps.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as scratch:
        blocks = blocks_of(fps, scratch)
        # at most one root for every MIN_BLOCK fingerprints, and past BLOCKS * MAX_BLOCK of them
        # one for every MAX_BLOCK: 24 bytes for a million documents
        roots = sorted(tuple(r) for r in blocks.select("block", "mask", "pattern").collect())
        held = spark.sparkContext.broadcast((np.array([r[0] for r in roots], np.int64),
                                             np.array([r[1] for r in roots], np.int64).view(np.uint64),
                                             np.array([r[2] for r in roots], np.int64).view(np.uint64)))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            no, mask, pattern = held.value
            for b in batches:
                for block, data in zip(b["block"].to_pylist(), b["fps"]):
                    k = int(np.searchsorted(no, block))
                    near = np.bitwise_count((pattern ^ pattern[k]) & mask & mask[k]) <= radius
                    for other in no[near].tolist():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([min(block, other)]), pa.array([max(block, other)]), pa.array([block]),
                             pa.array([data.as_py()], pa.binary())], ["a", "b", "own", "fps"])

        def match(key: tuple, table: pa.Table) -> pa.Table:
            a, b = key[0].as_py(), key[1].as_py()
            data = {o: np.frombuffer(f.as_buffer(), np.uint64) for o, f in zip(table["own"].to_pylist(), table["fps"])}
            x, y = data[a], data[b]
            tree = GrayTree(x)
            other, shift = (tree, 0) if a == b else (GrayTree(y), len(x))
            forest = Forest(len(x) + (0 if a == b else len(y)))
            for i, j in links(tree, other, radius, a == b):
                forest.join(i, j + shift)
            every = (x if a == b else np.concatenate([x, y])).view(np.int64)
            linked = np.flatnonzero(forest.root != np.arange(len(every)))
            return pa.table({"u": every[linked], "v": every[forest.root[linked]]})

        sent = blocks.mapInArrow(send, "a bigint, b bigint, own bigint, fps binary")
        return pin(sent.groupBy("a", "b").applyInArrow(match, "u bigint, v bigint"))


def group_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row.

    ``root`` is the fingerprint that names the group, ``component_id`` the smallest id in it.
    """
    fps = pin(fingerprints(docs, shingle, id_col, text_col))
    distinct = pin(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    member = components(near_links(distinct, radius))
    roots = pin(distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")))
    least = pin(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("parts")))
    named = pin(heavy_split_join(roots.select("fp", "root", "n"), least, ["root"], "parts"))
    return heavy_split_join(fps, named, ["fp"], "n").select("doc_id", "text_hash", "fp", "root", "component_id")


def dedup_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the smallest id, null ids last, then the text's hash.

    Of rows that repeat both id and text one stays.
    """
    groups = pin(group_near(docs, shingle, radius, id_col, text_col))
    keep = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("k"))
    keep = pin(keep.select(F.col("k.doc_id").alias("__d"), F.col("k.text_hash").alias("__h")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h"))
    rows = docs.withColumn("__t", F.xxhash64(F.col(f"`{text_col}`"))).join(keep, same, "left_semi")
    repeated = groups.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates([id_col, "__t"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
