"""Token ids in grammar-compressed files (Re-Pair), written in document order and read back.

Texts are put in ascending order of their id by a range partition, encoded, and cut into shards of
about ``SHARD`` ids.  Each shard is compressed on its own: the most frequent pairs of neighbouring
symbols become nonterminals, round after round, until no pair occurs twice or the 16-bit symbols are used up.  A shard's file holds the
rules, the length of each rule's expansion and the symbols by document, so any stretch of ids of any
document can be decoded without the rest (``extract``).

File of a shard, little-endian: ``RPG1``; 32-bit numbers of terminals, rules and documents; 64-bit
number of symbols; rules (32-bit left and right); expansion lengths (32-bit); symbols and ids of each
document (64-bit each); symbols (16-bit).  The files lie in a Parquet table of one row a shard, which
Spark writes to and reads from the shared store.

Defined cases: a null or empty text has the end id alone; a null ``doc_id`` comes before all others;
rows that repeat an id follow each other in order of their text's hash; a text of any length is one
stretch of its shard; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, pin
from .piecewise import encoder

END = 0
SHARD = 1 << 21
#: Pairs replaced in one round, and how often a pair must occur.
PAIRS = 1024
MIN_COUNT = 2
#: Characters of text encoded at a time.
TEXT = 12 << 20
#: log2 of the places that pairs are hashed to.
PLACES = 18
#: A key that no pair has: the last symbol is made when no room is left for others.
_NO_PAIR = np.uint32((1 << 32) - 1)


def _place_in_run(at: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of positions that follow one another."""
    order = np.arange(len(at), dtype=np.int32)
    starts = order.copy()
    starts[1:][at[1:] == at[:-1] + 1] = 0
    return order - np.maximum.accumulate(starts)


def _frequent(key: np.ndarray, take: int, guess: int) -> tuple[np.ndarray, int]:
    """(the ``take`` most frequent pairs in order, a count that all of them reach); ties go to the smaller pair.

    Every pair occurs ``MIN_COUNT`` times.  ``guess`` is where the search begins; it falls until enough pairs
    occur so often."""
    key = np.sort(key)
    key = key[:np.searchsorted(key, _NO_PAIR)]
    guess = min(guess, len(key) // take)  # not more can occur so often
    while True:
        guess = max(guess, MIN_COUNT)
        often = key[guess - 1:][key[guess - 1:] == key[:len(key) - guess + 1]]
        pair = often[np.concatenate([[True], often[1:] != often[:-1]])[:len(often)]]
        if len(pair) >= take or guess == MIN_COUNT:
            break
        guess = guess * 3 // 4 if guess > 8 else guess - 1
    if len(pair) <= take:
        return pair, guess
    count = np.searchsorted(key, pair, "right") - np.searchsorted(key, pair)
    least = int(np.partition(count, -take)[-take])
    above, ties = pair[count > least], pair[count == least]
    return np.sort(np.concatenate([above, ties[:take - len(above)]])), least


def _matches(key: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that hold one of the pairs, which one)."""
    factor, no = 2654435761, np.arange(1, len(pair) + 1)
    while True:  # a factor under which no two pairs share a place
        hashed = lambda k, f=np.uint32(factor): (k * f) >> np.uint32(32 - PLACES)
        table = np.zeros(1 << PLACES, np.uint16)
        table[hashed(pair)] = no
        if (table[hashed(pair)] == no).all():
            break
        factor = (factor * 1664525 + 1013904222) % (1 << 32) | 1
    which = table[hashed(key)]
    at = np.flatnonzero(which != 0)
    which = which[at].astype(np.int64) - 1
    hit = pair[which] == key[at]
    return at[hit], which[hit]


def compress(ids: np.ndarray, lengths: np.ndarray, terminals: int) -> bytes:
    """The file of one shard: ``ids`` of its documents one after the other, ``lengths`` ids each."""
    s = ids.astype(np.uint32)
    last = np.cumsum(lengths) - 1  # each document's last symbol
    left, right, sizes = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.ones(terminals, np.uint32)
    room, most, guess = (1 << 16) - terminals, PAIRS, len(s)
    while len(s) > 1 and len(left) < room:
        key = s[:-1] << np.uint32(16)
        key |= s[1:]
        key[last[:-1]] = _NO_PAIR  # a pair never holds symbols of two documents
        same = np.flatnonzero(s[:-1] == s[1:])
        same = same[key[same] != _NO_PAIR]
        same = same[_place_in_run(same) % 2 == 1]  # "aaa" holds "aa" once
        double = key[same]
        key[same] = _NO_PAIR
        take = min(most, room - len(left))
        # counts fall about as the inverse of the rules made
        pair, guess = _frequent(key, take, int(0.94 * guess * max(len(left), take // 8) / (len(left) + take)))
        if not len(pair):
            break
        key[same] = double
        at, no = _matches(key, pair)
        # of matches that overlap in a row, every other one is taken, from the left
        taken = _place_in_run(at) % 2 == 0
        at, no = at[taken], no[taken]
        used = np.bincount(no, minlength=len(pair)) >= MIN_COUNT  # overlaps may leave a pair too few matches
        if not used.any():
            most = 1  # the most frequent pair alone meets no other
            continue
        most = PAIRS
        at, no = at[used[no]], (np.cumsum(used) - 1)[no[used[no]]]
        pair = pair[used]
        s[at] = terminals + len(left) + no
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s = s[stay]
        last = last - np.searchsorted(at + 1, last, "right")
        a, b = pair >> np.uint32(16), pair & np.uint32(0xFFFF)
        left, right, sizes = np.concatenate([left, a]), np.concatenate([right, b]), np.concatenate([sizes, sizes[a] + sizes[b]])
    symbols = np.diff(last, prepend=-1)
    return b"".join([
        b"RPG1", struct.pack("<IIIQ", terminals, len(left), len(lengths), len(s)), left.astype("<u4").tobytes(),
        right.astype("<u4").tobytes(), sizes[terminals:].astype("<u4").tobytes(), symbols.astype("<u8").tobytes(),
        np.asarray(lengths).astype("<u8").tobytes(), s.astype("<u2").tobytes()])


class ShardFile:
    """A shard's file, read: rules, expansion lengths, and the symbols of its documents."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a shard file")
        self.terminals, rules, docs, n = struct.unpack_from("<IIIQ", data, 4)
        at = 24

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.left, self.right, self.sizes = take(rules, "<u4"), take(rules, "<u4"), take(rules, "<u4")
        self.doc_symbols, self.doc_ids, self.symbols = take(docs, "<u8"), take(docs, "<u8"), take(n, "<u2")
        # expansions of all symbols, one after the other; a rule only holds terminals and earlier rules, and is
        # written once all that it holds have been
        self.size = np.concatenate([np.ones(self.terminals, np.int64), self.sizes.astype(np.int64)])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.arange(self.size.sum(), dtype=np.uint32)
        sides, done = np.stack([self.left, self.right]).astype(np.int64), self.terminals
        while done < len(self.size):
            later = np.flatnonzero(sides[:, done - self.terminals:].max(axis=0) >= done)
            upto = done + int(later[0]) if len(later) else len(self.size)
            held = self.expand(sides[:, done - self.terminals:upto - self.terminals].T.ravel())
            self.flat[self.start[done]:self.start[done] + len(held)] = held
            done = upto

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        first = np.cumsum(size) - size
        at = np.repeat(self.start[symbols] - first, size)
        at += np.arange(len(at))
        return self.flat[at]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn, a bounded stretch of symbols at a time."""
        ids = self.expand(self.symbols.astype(np.int64))
        at = 0
        for n in self.doc_ids.astype(np.int64).tolist():
            yield ids[at:at + n]
            at += n

    def extract(self, doc: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of the shard's document number ``doc``; only the symbols over them are expanded."""
        at = int(self.doc_symbols[:doc].sum())
        own = self.symbols[at:at + int(self.doc_symbols[doc])].astype(np.int64)
        ends = np.cumsum(self.size[own])
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        skip = lo - (int(ends[a - 1]) if a else 0)
        return self.expand(own[a:b])[skip:skip + hi - lo]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, about ``TEXT`` characters at a time."""
    docs, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            docs.append(doc)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= TEXT:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


_FILE_COLUMNS = "part bigint, seq bigint, start_in_part bigint, n_ids bigint, ids array<bigint>, file binary"


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end: int = END, id_col: str = "doc_id",
                text_col: str = "text") -> None:
    """Write the token files of ``docs`` to the folder ``path`` of a store that Spark can write."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own = encoder(held.value)
        if own.kind != "<u2":
            raise ValueError("token files hold ids of 16 bits")
        terminals = max(own.size, end + 1)
        part, seq, done, count = TaskContext.get().partitionId(), 0, 0, 0
        ids, data, stop = [], [], np.array([end], "<u2").tobytes()

        def out() -> pa.RecordBatch:
            lengths = np.fromiter((len(x) // 2 for x in data), np.int64, len(data))
            file = compress(np.frombuffer(b"".join(data), "<u2"), lengths, terminals)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([done], pa.int64()),
                 pa.array([count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([file], pa.binary())],
                ["part", "seq", "start_in_part", "n_ids", "ids", "file"])

        for docs, texts in _stretches(batches):
            for doc, coded in zip(docs, own.encode(texts)):
                ids.append(doc)
                data.append(coded + stop)
                count += len(coded) // 2 + 1
                if count >= SHARD:
                    yield out()
                    seq, done, count, ids, data = seq + 1, done + count, 0, [], []
        if data:
            yield out()

    rows.mapInArrow(work, _FILE_COLUMNS).write.option("compression", "zstd").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start_in_part, token_ids binary) of every document, decoded from its shard's file.

    ``token_ids`` are 32-bit little-endian integers.
    """
    bounded_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                shard = ShardFile(b["file"][row].as_py())
                part, at = b["part"][row].as_py(), b["start_in_part"][row].as_py()
                own: list[tuple] = []
                for doc, ids in zip(b["ids"][row].as_py(), shard.documents()):
                    own.append((doc, at, ids.astype("<u4").tobytes()))
                    at += len(ids)
                    if len(own) == 256:
                        yield _token_rows(part, own)
                        own = []
                if own:
                    yield _token_rows(part, own)

    files = spark.read.schema(_FILE_COLUMNS).parquet(path)
    return files.select("part", "start_in_part", "ids", "file").mapInArrow(
        work, "part bigint, doc_id bigint, start_in_part bigint, token_ids binary")


def _token_rows(part: int, own: list[tuple]) -> pa.RecordBatch:
    doc, start, ids = zip(*own)
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(own), pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()),
         pa.array(ids, pa.binary())], ["part", "doc_id", "start_in_part", "token_ids"])


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): ids in all parts before each; one row for each task that wrote files."""
    sums = spark.read.schema(_FILE_COLUMNS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def index_documents(docs: DataFrame, tokenizer_path: str, end: int = END, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Write the token files to scratch, read them back: (doc_id, start, n_tokens, ids_crc32) of each document."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/tokens"
        write_files(docs, path, tokenizer_path, end, id_col, text_col)
        rows = read_files(spark, path).select(
            "part", "doc_id", "start_in_part", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
            F.crc32("token_ids").alias("ids_crc32"))
        starts = F.broadcast(part_starts(spark, path))  # a row a task
        return pin(rows.join(starts, "part").select(
            "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"))
