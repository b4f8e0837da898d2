"""Benchmark decontamination: find and remove passages of test items in training documents.

Method: the word windows (13 words) of the test items become a hash set that is broadcast to every
task; a task maps a document's words to the ids of the items' vocabulary, hashes each window whose
words all are in it, looks the hash up, verifies the words of every hit, and marks the hit words.

The broadcast holds at most ``BLOCK_SEGMENTS`` segments of ``SEGMENT_WORDS`` words.  A larger
benchmark is dealt into blocks of that size and the documents pass each block in turn, their hits
so far travelling with them; no case is dropped at any size.

Defined cases: a null or empty text has no words and no hits; an item without words is ignored;
items that share an ``item_id`` count once, repeated items are looked up once; a null ``item_id`` counts as the id ''.  A column of
the documents that is named like an added column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import alnum_words, folded
from .common import Scratch, bounded_batches

WINDOW = 13
SEGMENT_WORDS = 4096
BLOCK_SEGMENTS = 256

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS),
                       T.StructField("hit_items", T.ArrayType(T.StringType()))])


def _all_words(text: bytes) -> list[bytes]:
    return [w for ws in alnum_words(text) for w in ws]


class NgramIndex:
    """The windows of one block of item segments: vocabulary, window hashes, and items by window."""

    def __init__(self, segments: list[tuple[str, str]], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in segments})
        item_no = {x: i for i, x in enumerate(self.names)}
        windows: dict[tuple, set[int]] = {}
        for item, text in segments:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in text.encode().split()]
            for i in range(max(1, len(ids) - n + 1)):
                windows.setdefault(tuple(ids[i:i + n]), set()).add(item_no[item])
        self.by_length = {}
        for length in sorted({len(w) for w in windows}):
            own = [w for w in windows if len(w) == length]
            ids = np.array(own, dtype=np.int64).reshape(len(own), length)
            for seed in range(100):  # another draw in the unlikely case that two windows share a hash
                mult = np.random.default_rng(seed).integers(1, 1 << 62, length, dtype=np.int64) | 1
                hashes = (ids * mult).sum(axis=1)
                if len(np.unique(hashes)) == len(own):
                    break
            order = np.argsort(hashes)
            items = [np.array(sorted(windows[own[k]]), dtype=np.int64) for k in order]
            self.by_length[length] = (mult, hashes[order], ids[order], items)

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, mask of hit words, names of the items that occur."""
        get, parts = self.vocab.get, []
        for words in alnum_words(text):
            parts.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
        ids = np.concatenate(parts)
        n, found = len(ids), set()
        marks = np.zeros(n + 1, dtype=np.int64)
        if n and (ids >= 0).any():
            unknown = np.concatenate([[0], np.cumsum(ids < 0)])
            for length, (mult, hashes, exact, items) in self.by_length.items():
                if n < length:
                    continue
                at = np.flatnonzero(unknown[length:] == unknown[:-length])
                for lo in range(0, len(at), 1 << 16):
                    pos = at[lo:lo + (1 << 16)]
                    seen = ids[pos[:, None] + np.arange(length)]
                    k = np.searchsorted(hashes, (seen * mult).sum(axis=1))
                    k[k == len(hashes)] = 0
                    hit = (exact[k] == seen).all(axis=1)  # the words themselves decide, not the hash
                    np.add.at(marks, pos[hit], 1)
                    np.add.at(marks, pos[hit] + length, -1)
                    for w in np.unique(k[hit]):
                        found.update(self.names[i] for i in items[w])
        return n, np.cumsum(marks[:-1]) > 0, found


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span of words."""
    is_word = np.frombuffer(folded(text), dtype=np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]])))
    starts, ends, out, at = edge[::2], edge[1::2], [], 0
    for s, e in spans:
        out.append(text[at:starts[s]])
        at = ends[e - 1]
    return b"".join([*out, text[at:]])


def item_segments(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the items' words, long items in overlapping segments that hold every window whole."""
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                            F.col(f"`{text_col}`").alias("words"))
    step = SEGMENT_WORDS - n + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b["item"].to_pylist(), b["words"].to_pylist()):
                words = _all_words((text or "").encode())
                for i in range(0, max(1, len(words) - n + 1), step):
                    if part := words[i:i + SEGMENT_WORDS]:
                        out.append((item, b" ".join(part).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)],
                                             ["item", "words"])

    return rows.mapInArrow(cut, "item string, words string")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text",
         remove_spans: bool = False, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (ranges of word numbers) and ``hit_items`` added.

    ``remove_spans`` cuts the hit passages out of the text; ``drop_text`` leaves the text column out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = [c for c in docs.columns if c not in _ADDED.names]
    docs = docs.select(*[F.col(f"`{c}`") for c in base])
    with Scratch(spark) as scratch:
        segments = scratch.stash(item_segments(benchmark, n).distinct())  # repeated items would fill one block
        count = segments.count()
        n_blocks = 1 if count <= BLOCK_SEGMENTS else -(-count // (BLOCK_SEGMENTS // 2))
        if n_blocks == 1:
            index = NgramIndex([tuple(r) for r in segments.collect()], n)
            return _pass(docs, index, text_col, True, remove_spans, drop_text)
        out = docs
        for k in range(n_blocks):
            part = segments.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == k)
            last = k == n_blocks - 1
            index = NgramIndex([tuple(r) for r in part.collect()], n)
            out = _pass(out, index, text_col, k == 0, remove_spans and last, drop_text and last)
            out = out.checkpoint() if last else scratch.stash(out)
        return out


def _pass(docs: DataFrame, index: NgramIndex, text_col: str, first: bool, remove_spans: bool,
          drop_text: bool) -> DataFrame:
    """One narrow pass over the documents with one block of items; merges the hits of earlier passes."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    keep = [c for c in docs.columns if c not in _ADDED.names and not (drop_text and c == text_col)]
    schema = T.StructType([docs.schema[c] for c in keep] + _ADDED.fields)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            counts, spans, items, texts = [], [], [], []
            before = [([], [])] * b.num_rows if first else zip(b["hit_spans"].to_pylist(), b["hit_items"].to_pylist())
            for value, (old_spans, old_items) in zip(b[text_col], before):
                text = b"" if not value.is_valid else value.as_buffer().to_pybytes()
                n, mask, found = own.scan(text)
                for x in old_spans:
                    mask[x["start"]:x["end"]] = True
                hit = runs(mask)
                counts.append(n)
                spans.append([{"start": s, "end": e} for s, e in hit])
                items.append(sorted(found | set(old_items)))
                if remove_spans:
                    texts.append(value.as_py() if not hit else cut_spans(text, hit).decode())
            cols = [pa.array(texts, b.schema.field(c).type) if remove_spans and c == text_col else b[c] for c in keep]
            added = [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols + added, keep + _ADDED.names)

    return docs.mapInArrow(work, schema)


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def contaminated() -> Column:
    """The rule: some word is hit, and the hit words are a twentieth of all words or more."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``) or without the hit passages ("spans")."""
    if remove == "spans":
        return scan(docs, benchmark, n, text_col, remove_spans=True).drop(*_ADDED.names)
    marked = scan(docs, benchmark, n, text_col)
    return marked.filter(~contaminated()).drop(*_ADDED.names)
