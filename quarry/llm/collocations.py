"""Phrase collocations: every phrase of 2 to 5 words that occurs often, scored by its weakest cut.

Frequent phrases are found length by length.  A phrase of n words is counted only if both phrases of n-1
words in it may be frequent, which loses none.  For one length every task summarises the hashes of its
phrases in Misra-Gries summaries, one for each hash partition.  A phrase that one summary alone shows to
be frequent is kept at once and takes no part in the merge.  The summaries of a partition are merged into one
whose capacity exceeds the partition's mass divided by the threshold, so that all that was subtracted
stays below the threshold: every frequent phrase survives.  Survivors leave as bits of a bitmap of bounded
size, which the next length and the second pass look up.  The second pass counts, exactly and by the words
themselves, all phrases whose bits are set; those that only shared a bit fall out by their count.

All counts are by language; a phrase lies within a piece of text between the marks ``. , ; : ! ?`` and
line breaks.

Defined cases: a null or empty text has no words; a null language is ``und``; a text of any length is
read in stretches, and phrases across two stretches are counted once; repeated rows count as often as
they occur; ``doc_id`` and other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Bytes of text handled at a time (texts are cut between words).
STRETCH = 2 << 20
#: Distinct hashes a task holds before it hands out its summaries.
HELD = 3_000_000
#: Bytes of text for each hash partition, and the largest number of partitions.
PARTITION_BYTES = 32 << 20
MOST_PARTITIONS = 1 << 14
#: Counters of a merged summary, as a multiple of mass / threshold: what is subtracted stays below threshold / ROOM.
ROOM = 4
#: Bits of the bitmap of one length: 32 for each phrase that can reach the threshold, at most 2^28 (32 MB),
#: and how many of them a survivor sets.
BITS_EACH = 32
MOST_BITS = 1 << 28
PROBES = 4
#: Phrases a task counts before it hands out their counts.
COUNTED = 300_000
UNKNOWN = "und"

# Marks between pieces, white space between words.
_MARKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_MARKS)] = 2
_KIND[[0x20, 0x09]] = 1
_BREAK = re.compile(rb"[.,;:!?\x0a-\x0d\x20\x09]")

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]  # published multipliers
_OF_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a published 64-bit hash: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _Powers:
    """Powers of the hash base and of its inverse, grown as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def run(base: int) -> np.ndarray:
                x = np.full(n, base, np.uint64)
                x[0] = 1
                return np.cumprod(x)
            self.up, self.down = run(_BASE), run(_INVERSE)
        return self.up, self.down


_POWERS = _Powers()


class Stretch:
    """The words of some texts: places, hashes, and which of them follow each other in one piece."""

    def __init__(self, texts: list[bytes], langs: list[str], carried: list[int]):
        """``carried``: so many bytes at a text's start were read before; words that end there aren't new."""
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        kind = _KIND[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[1], (kind > 0).view(np.int8), [1]])))
        self.starts, self.ends = edge[::2], edge[1::2]
        up, down = _POWERS.get(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[raw] * up[:len(raw)])])
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        self.langs = langs
        seed = {x: lang_hash(x) for x in set(langs)}
        of_text = np.array([seed[x] for x in langs], np.uint64)
        self.words = _mix((sums[self.ends] - sums[self.starts]) * down[self.starts]) ^ of_text[self.text]
        marks = np.cumsum(kind == 2)
        self.piece = marks[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.new = self.ends > (begins + np.array(carried, np.int64))[self.text]

    def grams(self, bitmaps: list[Bitmap], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, first words, hashes) of the new phrases of 1 to ``longest`` words.

        Phrases of ``n`` words pass if the ``n - 1`` words at either end passed bitmap ``n - 1``.
        """
        at, h = np.arange(len(self.words)), self.words
        for n in range(1, longest + 1):
            if n > 1:
                if len(bitmaps) < n - 1:
                    return
                keep = bitmaps[n - 2].holds(h)
                passed = np.zeros(len(self.words) + 1, bool)
                passed[at[keep]] = True
                both = keep & passed[at + 1]
                at, h = at[both], h[both]
                last = at + n - 1
                inside = last < len(self.words)
                at, h, last = at[inside], h[inside], last[inside]
                inside = self.piece[at] == self.piece[last]
                at, h, last = at[inside], h[inside], last[inside]
                h = _mix(h * _U(_BASE) + self.words[last])
            fresh = self.new[at + n - 1]
            yield n, at[fresh], h[fresh]

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[at:at + n].tolist(), self.ends[at:at + n].tolist())).decode()


def lang_hash(lang: str) -> int:
    raw = np.frombuffer(lang.encode() + b"\x00", np.uint8)
    up, _ = _POWERS.get(len(raw))
    with np.errstate(over="ignore"):
        return int(_mix(np.sum(_OF_BYTE[raw] * up[:len(raw)], keepdims=True))[0])


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """The rows' texts, about ``STRETCH`` bytes at a time; a long text's words each are new in one stretch."""
    texts: list[bytes] = []
    langs: list[str] = []
    carried: list[int] = []
    size = 0
    for b in batches:
        for value, lang in zip(b.column("text"), b.column("lang").to_pylist()):
            data = value.as_buffer().to_pybytes().lower() if value.is_valid else b""  # bytes fold A-Z only
            at = old = 0
            while at + old < len(data):
                cut = _BREAK.search(data, at + old + STRETCH)
                end = cut.start() if cut else len(data)
                texts.append(data[at:end])
                langs.append(lang)
                carried.append(old)
                size += end - at
                if size >= STRETCH:
                    yield Stretch(texts, langs, carried)
                    texts, langs, carried, size = [], [], [], 0
                # the last four words go along, so that phrases over the cut are seen
                tail = _tail(data, at, end)
                at, old = end - tail, tail
                if end == len(data):
                    break
    if texts:
        yield Stretch(texts, langs, carried)


def _tail(data: bytes, at: int, end: int) -> int:
    """Bytes at the end of ``data[at:end]`` that hold its last ``LONGEST - 1`` words, if no mark parts them."""
    if end == len(data):
        return 0
    to, words = end, 0
    while to > at and words < LONGEST - 1:
        while to > at and data[to - 1] in b" \t":
            to -= 1
        if to == at or data[to - 1] in _MARKS:
            break
        while to > at and _KIND[data[to - 1]] == 0:
            to -= 1
        words += 1
    return end - to


def probes(slots: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ``PROBES`` places of each slot among 2^bits."""
    return [((slots * odd) >> np.uint32(32 - bits)).astype(np.int64) for odd in _ODD]


class Bitmap:
    """Survivors' hashes, each as a few bits: each hash partition owns the same number of bits."""

    def __init__(self, partitions: int, bits: int, words: np.ndarray):
        self.partitions, self.bits, self.words = partitions, bits, words  # bits: log2 of a partition's bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        part, slot = place(h, self.partitions)
        base = part.astype(np.int64) << self.bits
        out = np.ones(len(h), bool)
        for place_ in probes(slot, self.bits):
            at = base | place_
            out &= (self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def place(h: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash partition, 32-bit slot within it); phrases that share both are counted together until the second pass."""
    return (h >> _U(32)) % _U(partitions), (h & _U(0xFFFFFFFF)).astype(np.uint32)


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """Misra-Gries: at most ``capacity`` counters, each at most ``taken`` below the true count."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        self.keys, self.counts = tally(*map(np.concatenate, zip((self.keys, self.counts), *self.waiting)))
        self.waiting, self.size = [], 0
        if len(self.keys) > self.capacity:
            cut = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            above = self.counts > cut
            self.keys, self.counts, self.taken = self.keys[above], self.counts[above] - cut, self.taken + cut

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys whose true count may reach the threshold; all that reach it are among them if taken < threshold."""
        self.merge()
        return self.keys[self.counts + self.taken >= threshold]


_SUMMARIES = "part int, mass bigint, keys binary, counts binary"


def _summaries(rows: DataFrame, bitmaps, n: int, partitions: int, threshold: int) -> DataFrame:
    """First pass over the phrases of ``n`` words: each task's summaries by hash partition."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmaps.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            keys, counts = tally(*map(np.concatenate, zip(*held)))
            part, slot = place(keys, partitions)
            order = np.argsort(part, kind="stable")
            part, slot, counts = part[order], slot[order], np.minimum(counts[order], threshold)
            found = []
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:]):
                own = counts[a:b]
                found.append((int(part[a]), int(own[own < threshold].sum()), slot[a:b].tobytes(), own.astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.binary()])],
                ["part", "mass", "keys", "counts"])

        size = 0
        for s in stretches(batches):
            for m, _, h in s.grams(known, n):
                if m == n and len(h):
                    held.append(np.unique(h, return_counts=True))
                    size += len(held[-1][0])
            if size > HELD:
                held = [tally(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(work, _SUMMARIES)


def _survivors(summaries: DataFrame, partitions: int, threshold: int) -> Bitmap:
    """Merge the summaries of each partition; the survivors as one bitmap (at most ``MOST_BITS`` bits)."""
    mass = {r["part"]: r["mass"] for r in  # at most MOST_PARTITIONS rows
            summaries.groupBy("part").agg(F.sum("mass").alias("mass")).collect()}
    most = max(mass.values(), default=0)
    wanted = min(MOST_BITS // partitions, BITS_EACH * (most // threshold + 1))
    bits = max(3, min(31, wanted.bit_length() - 1))
    held = summaries.sparkSession.sparkContext.broadcast(mass)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, Summary] = {}
        sure: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(1 << (bits - 3), np.uint8))

        def mark(part: int, slots: np.ndarray) -> None:
            for at in probes(slots, bits):
                np.bitwise_or.at(sure[part], at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

        for b in batches:
            for part, keys, counts in zip(*(b.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                keys, counts = np.frombuffer(keys, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64)
                alone = counts >= threshold
                mark(part, keys[alone])
                own = merged.setdefault(part, Summary(ROOM * (held.value[part] // threshold + 1)))
                own.add(keys[~alone], counts[~alone])
        for part, own in merged.items():
            mark(part, own.survivors(threshold))
        for part, own in sure.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())],
                                             ["part", "own"])

    words = np.zeros(partitions << (bits - 3), np.uint8)
    merged = summaries.repartition(partitions, "part").mapInArrow(work, "part int, own binary")
    for r in merged.collect():
        at = r["part"] << (bits - 3)
        words[at:at + (1 << (bits - 3))] = np.frombuffer(r["own"], np.uint8)
    return Bitmap(partitions, bits, words)


_COUNTS = "part int, lang array<string>, words array<int>, phrase array<string>, n array<bigint>"


def _counts(rows: DataFrame, bitmaps, partitions: int, longest: int) -> DataFrame:
    """Second pass: each task's counts, one row for each hash partition it met.

    The entries of no words hold the number of all words of each language."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmaps.value
        total: dict[tuple[int, str, int, str], int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            by: dict[int, list] = defaultdict(list)
            for (part, lang, n, phrase), k in total.items():
                by[part].append((lang, n, phrase, k))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            lists = [pa.array([[e[i] for e in own] for own in by.values()], pa.list_(t)) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), *lists], ["part", "lang", "words", "phrase", "n"])

        for s in stretches(batches):
            for lang, k in zip(s.langs, np.bincount(s.text[s.new], minlength=len(s.langs)).tolist()):
                if k:
                    total[lang_hash(lang) % partitions, lang, 0, ""] += k
            for n, at, h in s.grams(known, longest):
                keep = known[n - 1].holds(h)
                at, h = at[keep], h[keep]
                h, first, counts = np.unique(h, return_index=True, return_counts=True)
                part, _ = place(h, partitions)
                for p, i, k in zip(part.tolist(), at[first].tolist(), counts.tolist()):
                    total[p, s.langs[s.text[i]], n, s.phrase(i, n)] += k
            if len(total) > COUNTED:
                yield out()
                total.clear()
        if total:
            yield out()

    return rows.mapInArrow(work, _COUNTS)


def _summed(counts: DataFrame, partitions: int, min_count: int) -> DataFrame:
    """(lang, words, phrase, n): the tasks' counts of each hash partition added up, rare phrases left out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, str], int] = defaultdict(int)
        for b in batches:
            entries = [b.column(c).flatten().to_pylist() for c in ("lang", "words", "phrase", "n")]
            for lang, words, phrase, n in zip(*entries):
                total[lang, words, phrase] += n
        kept = [(*key, n) for key, n in total.items() if n >= min_count or key[1] == 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in kept], t) for i, t in enumerate([pa.string(), pa.int32(), pa.string(), pa.int64()])],
            ["lang", "words", "phrase", "n"])

    return counts.repartition(partitions, "part").mapInArrow(work, "lang string, words int, phrase string, n bigint")


def frequent_phrases(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, longest: int = LONGEST,
                     text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, phrase, n) of every phrase of 1 to ``longest`` words with ``n >= min_count``, exactly.

    Rows of no words hold the number of all words of each language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(8, min(MOST_PARTITIONS, -(-size // PARTITION_BYTES)))
    bitmaps: list[Bitmap] = []
    for n in range(1, longest + 1):
        found = scratch.stash(_summaries(rows, spark.sparkContext.broadcast(list(bitmaps)), n, partitions, min_count))
        bitmaps.append(_survivors(found, partitions, min_count))
        scratch.remove(scratch.n)
    counted = _counts(rows, spark.sparkContext.broadcast(bitmaps), partitions, longest)
    return scratch.stash(_summed(counted, partitions, min_count))


def _part(phrase: Column, first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` (from 1) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, last - first + 1), " ")


def collocations(docs: DataFrame, top: int | None = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST,
                 inside: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best-scored phrases of each language (None: all).

    ``a``, ``l`` and ``r`` count the phrase, and the parts before and behind its weakest cut; ``n`` counts the
    language's words; the score is floor(1000 a n / (l r)).  A phrase within a longer one that has
    ``inside`` per cent of its count or more is left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    scratch.keep()
    all_counts = frequent_phrases(docs, scratch, min_count, longest, text_col, lang_col)
    totals = all_counts.filter("words = 0").select("lang", F.col("n").alias("n"))
    counts = all_counts.filter("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    phrases = counts.filter("words > 1")

    # contiguous parts of two words or more that a longer phrase holds, with the largest count of such a phrase
    spans = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _part(F.col("phrase"), i, i + m - 1)))))
    within = (phrases.filter("words > 2").select("lang", "a", spans.alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = phrases.join(within, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * inside))

    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part(F.col("phrase"), F.lit(1), F.col("k")),
                             "right": _part(F.col("phrase"), F.col("k") + 1, F.col("words"))})
    of_left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    of_right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    wide = "decimal(19,0)"
    scored = cuts.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"]).join(totals, "lang")
    score = F.expr(f"(cast(a as {wide}) * cast(n as {wide}) * 1000) div (cast(l as {wide}) * cast(r as {wide}))")
    best = scored.withColumn("score", score.cast("bigint")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                       F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
