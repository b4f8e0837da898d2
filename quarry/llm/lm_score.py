"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words between ASCII white space, then one end.  A word is spelled byte by
byte, closed by a space; the end is a lone space.  A byte is spelled by the bits of its Huffman code (frequent
bytes take few), and each bit is predicted by six predictors.  Their contexts are the last one to four
bytes, which run across the space into the word before; the word so far; and the word so far with the
word before.  Before any of the word is known, the former of these two has the last byte beyond ASCII that the text has
shown, which tells its language.  A predictor looks up
how often either bit followed its hashed context in the training documents.  The predictions'
logits are mixed by a set of weights that a gate (how often the two longest contexts have been seen)
selects; an adaptive table, indexed by the node of the byte code and the mixed logit, refines the
mixture.  Every step is a binary decision whose two probabilities add to one, so a text's product is
a probability; -log2 of it over the text's bytes is its bits per byte.  Last, a
word's spelled probability is mixed with its share of all training tokens; the shares that the two get
are chosen from ``SHARES`` by the training documents' cost, each counted without its own occurrence.

Learning, as Spark jobs over all training documents: the texts are tokenised once into chunks (rows
of word lists and word numbers, written to the shared folder).  What spells a word is settled by the word before, the
script mark and the word; chunks send their distinct ones of these with their counts to the part that the
word before belongs to, where they are added up, so each is spelled once for the whole corpus.
All counts of the last predictor (the word so far with the word before) arise inside that part and never travel.
A word that occurs more than ``OFTEN`` times has several parts, by its followers' first ``HEAD`` bytes; only the counts
of those bytes are added up over its parts (``heads``), so that no part grows with the followers of one word.
The other predictors' bits are counted from the distinct words (contexts inside a word) and the distinct
pairs of a word's end and the next word's start (contexts across a space), and summed block by block.
One training document in eight is left out of the first counts, and on these each task learns the weights online,
batch by batch, and fills the refining table; weights are averaged by tokens, refinements summed, and the
left-out documents' bits added to the tables.  Counts are summed under ``WIDE``-bit hashes of (context, node); how
many of these occur gives each predictor's table its size (``table_bits``), so tables grow with the corpus and at
most two thirds of a table's slots are in use; the last predictor has such a table for each run of words before.
Tables are broadcast in pieces and mapped from each executor's disk; neither the driver nor a task holds one in memory.
Costs go back to the chunks as one number for each of their distinct triples.

The base score is add-one unigram over exact counts of all training words: chunks send their distinct
words to be counted, and get the counts back by a shuffled join on the word.

Defined cases: a null or empty text is an end alone; a null ``doc_id`` counts as empty text in the
split and comes back as null; repeated rows are scored each; without training documents the predictors
know nothing and every decision costs one bit (and the base score is 0); other columns are not read.
"""

from __future__ import annotations

import ctypes
import heapq
import math
import mmap
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, pin, release

#: Predictors: last byte, two, three, four bytes, word so far, word so far after the word before.
N = 6
#: Bits of the hash under which counts are summed; a predictor's slot is the upper bits of it.
WIDE = 37
#: log2 of a table's least size, and of the least number of blocks in which its counts are summed.
LEAST_BITS = 12
BLOCK_BITS = 6
#: Entries that a task holds of a predictor before it adds them up and sends them.
HELD = 1 << 19
#: log2 of the slots of a table that the driver, or a broadcast, holds at a time.
PIECE_BITS = 25
#: Text bytes of a chunk; words and spelled bytes handled at a time.
CHUNK = 12 << 20
WORDS = 40_000
#: Distinct (word before, mark, word) handled at a time, unless one word before has more; steps looked up at a time.
TRIPLES = 10_000
STEPS_HELD = 1 << 14
#: Decisions between two steps of the weights.
BATCH = 1024
#: Parts by the word before, for each chunk of text, and the least number of them.
PARTS = 2
LEAST_PARTS = 8
#: A word's occurrences beyond which its followers are dealt to parts of their own, by their first HEAD bytes.
OFTEN = 1 << 18
HEAD = 3
PRIOR = 0.4
LIMIT = 7.9
STEPS = 16
LEVELS = (8, 4)
GATES = LEVELS[0] * LEVELS[1]
RATE = 0.05
REFINE_STEPS = 33
REFINE_PRIOR = 30.0
MIX_SHARE = 8
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, (N + 4,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def script_mark(word: bytes) -> int:
    """1..64 by the last byte beyond ASCII of the word (it tells alphabets and languages apart); 0 without one."""
    if word.isascii():
        return 0
    return 1 + next(c for c in reversed(word) if c >= 0x80) % 64


def word_ends(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its last three bytes from the last on; 300 where it has fewer)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum(size)
    place = np.arange(len(raw)) - np.repeat(end - size, size)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _FACTORS[0], np.uint64), dtype=np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)])
    mixed = (run[end] - run[end - size] + size.astype(np.uint64)) * _FACTORS[1]
    mixed ^= mixed >> np.uint64(31)
    tail = np.full((len(words), 3), 300)
    for k in range(3):
        has = size > k
        tail[has, k] = raw[end[has] - 1 - k]
    return mixed * _FACTORS[2], tail


class ByteCode:
    """A Huffman code of bytes: the binary decisions that spell a byte.

    Frequent bytes take few decisions.  ``node[b, t]`` and ``bit[b, t]`` are the t-th decision of byte
    b, ``size[b]`` their number; every byte has a code, whatever the counts.
    """

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: dict[int, list[tuple[int, int]]] = {b: [] for b in range(256)}
        for inner in range(255):
            (n0, _, zero), (n1, _, one) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, members in enumerate((zero, one)):
                for b in members:
                    paths[b].append((inner, bit))
            heapq.heappush(heap, (n0 + n1, 256 + inner, zero + one))
        self.size = np.array([len(paths[b]) for b in range(256)])
        self.node = np.zeros((256, self.size.max()), np.int64)
        self.bit = np.zeros((256, self.size.max()), np.int64)
        for b, path in paths.items():
            for t, (node, bit) in enumerate(reversed(path)):
                self.node[b, t], self.bit[b, t] = node, bit

    def decisions(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which bytes have a t-th decision, its node, its bit) for t = 0, 1, ..."""
        own = np.arange(len(data))
        for t in range(self.node.shape[1]):
            own = own[self.size[data[own]] > t]
            if not len(own):
                return
            yield own, self.node[data[own], t], self.bit[data[own], t]


class Spelling:
    """The distinct steps that spell some words: each step is a byte in its contexts.

    Words that begin alike after the same word share their first steps, so sorted words have few steps of
    their own.  ``data`` and ``contexts`` are by step; ``step`` and ``word`` say which step each byte of each
    word is.  ``mark``: the script mark in force before each word (0: none); ``before``: hash of the word
    before; ``tail``: its last three bytes (see ``word_ends``).
    """

    def __init__(self, words: list[bytes], mark: np.ndarray, before: np.ndarray, tail: np.ndarray):
        raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(words)), size)
        spot = np.arange(len(raw))
        place = spot - start[self.word]
        power = np.cumprod(np.full(int(place.max(initial=0)) + 2, _FACTORS[N], np.uint64), dtype=np.uint64)
        run = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)
        # a byte is a step of its own if the word differs from the one in front of it up to there
        shift, least = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(words) > 1:
            shift[1:] = size[:-1]
            least[1:] = np.where((before[1:] == before[:-1]) & (mark[1:] == mark[:-1]) & (tail[1:] == tail[:-1]).all(axis=1), size[:-1], 0)
        differs = (raw != raw[spot - shift[self.word]]) | (place >= least[self.word])
        new = np.maximum.accumulate(np.where(differs, spot, -1)) >= start[self.word]
        first = np.flatnonzero(new)
        by_place = np.argsort(place.astype(np.uint16) if len(power) < 1 << 16 else place, kind="stable")
        filled = np.maximum.accumulate(np.where(new[by_place], spot, 0))
        self.step = np.empty(len(raw), np.int64)
        self.step[by_place] = (np.cumsum(new) - 1)[by_place[filled]]
        self.place = place[first]
        so_far = run[first] - (raw[first].astype(np.uint64) + np.uint64(1)) * power[place[first]]
        opened = start[self.word[first]]
        so_far -= run[opened] - (raw[opened].astype(np.uint64) + np.uint64(1)) * power[0]
        self.data = raw[first]
        at, own = self.place, self.word[first]
        # what stands before the word: a space, and the bytes before that
        gone = np.concatenate([np.full((len(words), 1), 32), tail], axis=1)
        mixed, parts = np.zeros(len(first), np.uint64), []
        for k in range(1, 5):
            last = np.where(at >= k, raw[np.maximum(first - k, 0)], gone[own, np.clip(k - 1 - at, 0, 3)]).astype(np.uint64)
            mixed = mixed * np.uint64(512) + last
            parts.append(mixed)
        parts.append(np.where(at == 0, (256 + mark[own]).astype(np.uint64), so_far))
        parts.append(so_far * _FACTORS[N + 1] + before[own])
        self.contexts = [(p + np.uint64(i + 1)) * _FACTORS[i] for i, p in enumerate(parts)]

    def often(self, times: np.ndarray) -> np.ndarray:
        """How often each step is taken, for words that occur ``times``."""
        return np.bincount(self.step, times[self.word], len(self.data))


def wide_slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Hash of ``WIDE`` bits for each context and node of the byte code."""
    h = context + node.astype(np.uint64) * _FACTORS[N + 1]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[N + 2]
    return (h >> np.uint64(64 - WIDE)).astype(np.int64)


def table_bits(distinct: int) -> int:
    """log2 of the slots of a table for so many (context, node) pairs: a third to two thirds of them are used."""
    return min(max(LEAST_BITS, math.ceil(math.log2(max(1.5 * distinct, 1)))), WIDE)


class Table:
    """A predictor's slots: a byte each, the logit in steps of 1 / STEPS; for the gate also a level, four slots a byte.

    Each piece of them is a broadcast of its own.  A task maps the copy that its executor has on disk, so tables are
    in no process's memory, however large they are.
    """

    def __init__(self, bits: int, pieces: list[Broadcast]):
        self.pieces = pieces
        self.width = bits - (len(pieces) - 1).bit_length()

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "width": self.width}

    def opened(self) -> list[np.ndarray]:
        if "held" not in self.__dict__:
            self.held = [_mapped(x) for x in self.pieces]
        return self.held

    def logits(self, at: np.ndarray) -> np.ndarray:
        return self._read(at, self.width, 0).view(np.int8)

    def levels(self, at: np.ndarray) -> np.ndarray:
        return self._read(at >> 2, self.width - 2, 1 << self.width) >> ((at & 3) << 1).astype(np.uint8) & 3

    def _read(self, at: np.ndarray, width: int, skip: int) -> np.ndarray:
        pieces = [x[skip:skip + (1 << width)] for x in self.opened()]
        if len(pieces) == 1:
            return pieces[0][at]
        out, piece = np.empty(len(at), np.uint8), at >> width
        for k, x in enumerate(pieces):
            own = np.flatnonzero(piece == k)
            out[own] = x[at[own] & ((1 << width) - 1)]
        return out


#: What a table's piece begins with in its broadcast.
_BEGIN = b"piece of a table"


def _mapped(piece: Broadcast) -> np.ndarray:
    """A piece's bytes, from the file that holds the broadcast's pickled value where there is such a file."""
    path = getattr(piece, "_path", None)
    if path and not hasattr(piece, "_value"):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = data.find(_BEGIN, 0, 1024)
        if at >= 0:
            return np.frombuffer(data, np.uint8, offset=at + len(_BEGIN))
    return np.frombuffer(piece.value, np.uint8, offset=len(_BEGIN))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


class BitModel:
    """Tables (but the last predictor's), mixing weights by gate, and the refining table."""

    def __init__(self, code: ByteCode, bits: list[int], weights: np.ndarray | None = None,
                 refine: np.ndarray | None = None):
        self.code, self.bits = code, bits
        self.tables: list[Table] = []
        self.weights = np.full((GATES, N), 1.0 / N) if weights is None else weights
        self.pace = np.full((GATES, N), 1e-4)
        self.refine = np.zeros((256 * REFINE_STEPS, 2)) if refine is None else refine

    def blocks(self, own: Spelling, steps: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """(steps, decisions of each, its step, node, bit, hash for the last predictor), STEPS_HELD steps at a time."""
        deep = self.code.node.shape[1]
        steps = np.arange(len(own.data)) if steps is None else steps
        for lo in range(0, len(steps), STEPS_HELD):
            part = steps[lo:lo + STEPS_HELD]
            data = own.data[part].astype(np.int64)
            size = self.code.size[data]
            which = np.repeat(part, size)
            at = np.repeat(data * deep - np.cumsum(size) + size, size)
            at += np.arange(len(which))
            node = self.code.node.ravel()[at]
            yield part, size, which, node, self.code.bit.ravel()[at], wide_slots(np.repeat(own.contexts[N - 1][part], size), node)

    def inputs(self, own: Spelling, block: tuple, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits of the predictors, gate); ``last``: the last predictor's counts by slot and bit."""
        part, size, _, node, _, wide = block
        x = np.empty((N, len(node)), np.float32)
        salt = _SALTS[node]
        for i in range(N - 1):
            h = np.repeat(own.contexts[i][part], size)
            h += salt
            h ^= h >> np.uint64(29)
            h *= _FACTORS[N + 2]
            h >>= np.uint64(64 - self.bits[i])
            at = h.view(np.int64)
            x[i] = self.tables[i].logits(at)
            if i == N - 2:
                gate = self.tables[i].levels(at).astype(np.int64)
        x[:N - 1] *= np.float32(1 / STEPS)
        at = wide & (len(last) // 2 - 1)
        zero, one = last[2 * at], last[2 * at + 1]
        x[N - 1] = np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR))).clip(-LIMIT, LIMIT)
        gate += _LEVEL[np.minimum(zero + one, len(_LEVEL) - 1).astype(np.int64)]
        return x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logit, probability) of a one under the gate's weights."""
        weights = self.weights.T.astype(np.float32)
        logit = x[0] * weights[0][gate]
        for i in range(1, N):
            logit += x[i] * weights[i][gate]
        logit = logit.clip(-LIMIT, LIMIT)
        return logit, 1 / (1 + np.exp(-logit))

    def cells(self, node: np.ndarray, logit: np.ndarray) -> np.ndarray:
        """Cells of the refining table."""
        return node * REFINE_STEPS + np.rint((logit + np.float32(LIMIT)) * np.float32((REFINE_STEPS - 1) / (2 * LIMIT))).astype(np.int64)

    def counted(self, runs: list[tuple], times: np.ndarray, head: tuple | None = None) -> tuple[np.ndarray, list | None]:
        """The last predictor's counts by slot and bit, of triples that occur ``times``; the spelling if it is one run.

        ``head``: first bytes of all words after the word before, whose followers are in several parts, and their
        occurrences."""
        kept, last = None, None
        if len(runs) == 1:
            own = Spelling(*runs[0][1:])
            kept = own, list(self.blocks(own))
        total = sum(len(b[2]) for b in kept[1]) if kept else sum(int(self.code.size[Spelling(*r[1:]).data].sum()) for r in runs)
        every = [(run, times[at], slice(0, None) if head is None else slice(HEAD, None)) for at, *run in runs]
        if head is not None:
            words, n = head
            begun = words, np.zeros(len(words), np.int64), np.repeat(runs[0][3][:1], len(words)), np.full((len(words), 3), 300)
            every.append((begun, n, slice(0, HEAD)))
            total += int(self.code.size[Spelling(*begun).data].sum())
        slots = 1 << table_bits(total)
        for k, (run, n, places) in enumerate(every):
            own, blocks = kept if kept and k == 0 else (o := Spelling(*run), self.blocks(o))
            often = own.often(n)
            if head is not None:
                often[(own.place < places.start) if places.start else (own.place >= places.stop)] = 0
            cells, n = [], []
            for _, _, which, _, bit, wide in blocks:
                cells.append((wide & (slots - 1)) << 1 | bit)
                n.append(often[which])
            if len(every) == 1:
                last = np.bincount(np.concatenate(cells), np.concatenate(n), 2 * slots).astype(np.float32)
            else:
                last = np.zeros(2 * slots, np.float32) if last is None else last
                np.add.at(last, np.concatenate(cells), np.concatenate(n).astype(np.float32))
        return last, kept

    def word_costs(self, runs: list[tuple], times: np.ndarray, head: tuple | None = None) -> np.ndarray:
        """-log2 of the probability of each triple of ``runs`` (see ``_runs``); ``times``: occurrences in training."""
        last, kept = self.counted(runs, times, head)
        cost = np.zeros(len(times), np.float32)
        refined = ((self.refine[:, 1] + 0.0) / (total := self.refine.sum(axis=1) + REFINE_PRIOR)).astype(np.float32)
        pull = (REFINE_PRIOR / total).astype(np.float32)
        for at, *run in runs:
            own, blocks = kept or (o := Spelling(*run), self.blocks(o))
            each = np.zeros(len(own.data))
            for block in blocks:
                part, size, which, node, bit, _ = block
                logit, p = self.mixed(*self.inputs(own, block, last))
                cell = self.cells(node, logit)
                p = (np.float32(0.5) * (p + refined[cell] + pull[cell] * p)).clip(1e-6, 1 - 1e-6)
                nats = np.log(np.where(bit == 1, p, 1 - p))
                each[part] = np.add.reduceat(nats, np.cumsum(size) - size)
            cost[at] = np.bincount(own.word, each[own.step], len(run[0])) / -math.log(2)
        return cost

    def learn(self, runs: list[tuple], first: np.ndarray, times: np.ndarray, head: tuple | None = None) -> float:
        """Online steps over triples that occur ``times`` in the left-out documents, and ``first`` in the others.

        Returns the tokens learned from.  Weights move against the gradient of the coding cost, each at a
        pace that falls with the gradients it has met.
        """
        last, kept = self.counted(runs, first, head)
        for at, *run in runs:
            own = kept[0] if kept else Spelling(*run)
            often = own.often(times[at])
            for block in self.blocks(own, np.flatnonzero(often)):
                _, _, which, node, bit, _ = block
                x, gate = self.inputs(own, block, last)
                held = often[which]
                order = np.random.default_rng(len(held)).permutation(len(held))
                x, gate, node, bit, held = x[:, order], gate[order], node[order], bit[order], held[order]
                for k in range(0, len(order), BATCH):
                    b = slice(k, k + BATCH)
                    logit, p = self.mixed(x[:, b], gate[b])
                    np.add.at(self.refine, (self.cells(node[b], logit), bit[b]), held[b])
                    step = held[b] * (bit[b] - p)
                    total = np.maximum(np.bincount(gate[b], held[b], GATES), 1e-9)
                    for i in range(N):
                        change = np.bincount(gate[b], step * x[i, b], GATES) / total
                        self.pace[:, i] += change * change
                        self.weights[:, i] += RATE * change / np.sqrt(self.pace[:, i])
        return float(times.sum())

    def destroy(self) -> None:
        for table in self.tables:
            for piece in table.pieces:
                piece.destroy()


_SALTS = np.arange(256, dtype=np.uint64) * _FACTORS[N + 1]
#: The gate's upper part by how often the last predictor's slot was counted.
_LEVEL = np.minimum(np.log2(np.arange(1 << LEVELS[0]) + 1).astype(np.int64), LEVELS[0] - 1) * LEVELS[1]


def stretches(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of at most WORDS words and about 16 bytes for each of those."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo = 0
    while lo < len(words):
        held = ends[lo - 1] if lo else 0
        hi = min(int(np.searchsorted(ends, held + 16 * WORDS)) + 1, lo + WORDS, len(words))
        yield lo, hi
        lo = hi


def chunks(docs: DataFrame, held_out: int, modulus: int) -> DataFrame:
    """One row a chunk: its documents, their words as numbers, and the words by number.

    ``numbers`` is zlib-packed: per token a 16-bit number, or 65535 and two more for a larger one
    (words are numbered by falling frequency, so most are small).
    """
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, no = TaskContext.get().partitionId(), 0
        ids, sizes, roles, counts, found, held = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            code = pa.concat_arrays(found).dictionary_encode()
            lengths = np.concatenate(counts) + 1
            # number 0 is the end, the last token of each text
            flat = np.zeros(int(lengths.sum()), np.int64)
            token = np.ones(len(flat), bool)
            token[np.cumsum(lengths) - 1] = False
            flat[token] = code.indices.to_numpy() + 1
            words = pa.concat_arrays([pa.array([b""], pa.binary()), code.dictionary])
            role = np.array(roles)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.int32)
            number[order] = np.arange(len(words), dtype=np.int32)
            flat = number[flat]
            trained, apart = (np.bincount(flat[np.repeat(of, lengths)], minlength=len(words)) for of in (role > 0, role == 2))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + no], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([roles], pa.list_(pa.int8())),
                 listed(pa.array(lengths.astype(np.int32))), pa.array([pack(flat)], pa.binary()),
                 listed(words.take(pa.array(order))), listed(pa.array(trained.astype(np.int64))),
                 listed(pa.array(apart.astype(np.int64)))], _CHUNK_COLUMNS)

        for b in batches:
            texts = b["text"].cast(pa.string()).fill_null("")
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            lo = 0
            while lo < len(texts):
                # as many texts as the chunk has room for, one at least
                hi = min(lo + int(np.searchsorted(np.cumsum(size[lo:] + 8), CHUNK - held)) + 1, len(texts))
                lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[lo:hi]))
                flat = lists.flatten()
                real = pc.not_equal(flat, "")
                ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
                places = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
                counts.append(np.diff(ends[places]))
                found.append(flat.filter(real).cast(pa.binary()))
                for doc in b["doc_id"][lo:hi].to_pylist():
                    mark = zlib.crc32(b"" if doc is None else str(doc).encode())
                    ids.append(doc)
                    roles.append(0 if mark % modulus == held_out else 2 if mark // modulus % MIX_SHARE == 0 else 1)
                sizes += size[lo:hi].tolist()
                held += int(size[lo:hi].sum()) + 8 * (hi - lo)
                if held >= CHUNK:
                    yield out()
                    give_back()
                    ids, sizes, roles, counts, found, held, no = [], [], [], [], [], 0, no + 1
                lo = hi
        if ids:
            yield out()

    return docs.mapInArrow(work, "chunk bigint, ids array<bigint>, n_bytes array<bigint>, roles array<tinyint>, "
                                 "lengths array<int>, numbers binary, words array<binary>, trained array<bigint>, apart array<bigint>")


_CHUNK_COLUMNS = ["chunk", "ids", "n_bytes", "roles", "lengths", "numbers", "words", "trained", "apart"]


def pack(numbers: np.ndarray) -> bytes:
    large = numbers >= 65535
    at = np.arange(len(numbers)) + 2 * (np.cumsum(large) - large)
    out = np.empty(len(numbers) + 2 * int(large.sum()), "<u2")
    out[at] = np.where(large, 65535, numbers)
    out[at[large] + 1] = numbers[large] & 0xFFFF
    out[at[large] + 2] = numbers[large] >> 16
    return zlib.compress(out.tobytes(), 1)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on (small numbers compress well so)."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def unpack(data: bytes, lengths: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)
    # a number's first cell: not one of the two cells after a mark; marks themselves start a number
    n = int(lengths.sum())
    if len(raw) == n:
        return raw
    first = np.ones(len(raw), bool)
    marks = np.flatnonzero(raw == 65535)
    at = 0
    real = []
    for m in marks.tolist():  # a cell of 65535 may also be the low half of a large number
        if m >= at:
            real.append(m)
            at = m + 3
    real = np.array(real, np.int64)
    first[real + 1] = first[real + 2] = False
    out = raw[first]
    out[out == 65535] = raw[real + 1] | raw[real + 2] << 16
    return out


def _decoded(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(tokens a document, distinct keys, each token's place among them, words in order).

    A key is the word before (an end: the empty word), the script mark before and the word, words by
    their place in order.
    """
    lengths = np.array(batch["lengths"][row].as_py(), np.int64)
    flat = unpack(batch["numbers"][row].as_py(), lengths)
    words = batch["words"][row].values
    mark = np.array([script_mark(w) if w else 65 for w in words.to_pylist()], np.int8)[flat]  # an end sets the mark back
    last = np.where(mark > 0, np.arange(len(mark), dtype=np.int32), np.int32(0))
    np.maximum.accumulate(last, out=last)
    before = np.zeros(len(mark), np.int8)
    before[1:] = mark[last[:-1]] % 65
    order = pc.sort_indices(words)
    rank = np.empty(len(words), np.int32)
    rank[order.to_numpy()] = np.arange(len(words))
    own = rank[flat]
    del flat, mark, last
    key = np.zeros(len(own), np.int64)
    key[1:] = own[:-1]  # the word before; the empty word is the first in order
    key *= 65
    key += before
    key *= len(words)
    key += own
    del own, before
    keys, at = np.unique(key, return_inverse=True)
    return lengths, keys, at, words.take(order)


def _part_of(words: list[bytes], parts: int) -> np.ndarray:
    """The part that each word's followers belong to."""
    return ((word_ends(words)[0] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


class Layout:
    """The part of each triple: by the word before; of a word that occurs ``often`` also by the first bytes of its follower.

    So no part grows with the followers of one word.  ``split`` has the first part and the number of parts of such
    words; what of them is counted over all their parts is in ``heads``.
    """

    def __init__(self, parts: int, often: dict[bytes, int] | None = None):
        self.parts = self.total = parts
        self.split: dict[bytes, tuple[int, int]] = {}
        for word, n in sorted((often or {}).items()):
            self.split[word] = self.total, -(-n // OFTEN)
            self.total += self.split[word][1]

    def of(self, words: pa.Array, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """``before`` and ``word`` are places in the distinct ``words``, ``before`` in ascending order."""
        every = words.to_pylist()
        part = _part_of(every, self.parts)[before]
        if not self.split:
            return part
        begin = word_ends([w[:HEAD] for w in every])[0] >> np.uint64(20)
        for place, (lo, n) in zip(pc.index_in(pa.array(list(self.split), pa.binary()), words).to_pylist(), self.split.values()):
            if place is not None:
                own = slice(*np.searchsorted(before, [place, place + 1]))
                part[own] = lo + (begin[word[own]] % np.uint64(n)).astype(np.int64)
        return part


def layout(counts: DataFrame, chunked: int) -> Layout:
    """``counts``: see ``word_counts``; at most a word for every OFTEN training tokens is collected."""
    return Layout(part_number(chunked), {bytes(r["word"]): r["c"] for r in counts.filter(F.col("c") > OFTEN).select("word", "c").collect()})


def heads(parts: DataFrame, layout: Layout) -> dict[bytes, list[tuple[bytes, bytes, bytes]]]:
    """By word with parts of its own: the first bytes of all its followers, with their counts as ``triples`` has them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                words, before, _, word, *counts = _part(b, row)
                code = pa.array([w[:HEAD] for w in words], pa.binary()).dictionary_encode()
                at = code.indices.to_numpy()[word]
                used, at = np.unique(at, return_inverse=True)
                n = [np.bincount(at, x, len(used)).astype("<i8") for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (words[before[0]], zlib.compress(b" ".join(code.dictionary.take(pa.array(used)).to_pylist()), 1),
                                                          *(zlib.compress(planes(x), 1) for x in n))], ["before", "heads", "first", "others"])

    found: dict[bytes, list[tuple[bytes, bytes, bytes]]] = {}
    if layout.split:
        own = parts.filter(F.col("part") >= layout.parts).select("words", "keys", "first", "others")
        for r in pin(own.mapInArrow(work, "before binary, heads binary, first binary, others binary")).toLocalIterator():
            found.setdefault(bytes(r["before"]), []).append(tuple(bytes(r[c]) for c in ("heads", "first", "others")))
    return found


def _head(found: dict, part: int, layout: Layout, before: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray] | None:
    """(first bytes of all words after ``before``, counts kept for the tables, left-out counts), if it has parts of its own."""
    if part < layout.parts:
        return None
    words, first, others = zip(*((zlib.decompress(w).split(b" "), *(unplanes(zlib.decompress(x), "<i8") for x in n)) for w, *n in found[before]))
    words = [w for ws in words for w in ws]
    order = sorted(range(len(words)), key=words.__getitem__)
    return [words[k] for k in order], np.concatenate(first)[order], np.concatenate(others)[order]


def triples(table: DataFrame, layout: Layout | int) -> DataFrame:
    """One row a part: its distinct (word before, mark, word) in order, with their counts, and where chunks have them.

    ``keys`` are gaps between keys (as ``_decoded`` has them, over the part's own ``words``); ``first`` and
    ``others`` count training documents kept for the tables and left out; ``at`` has the places of the
    triples of each of ``chunks``, ``sizes`` many, in the chunk's order.
    """
    layout = Layout(layout) if isinstance(layout, int) else layout
    parts = layout.total

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                lengths, keys, at, words = _decoded(b, row)
                role = np.repeat(np.array(b["roles"][row].as_py(), np.int8), lengths)
                first, others = (np.bincount(at[role == r], minlength=len(keys)) for r in (1, 2))
                before, word = np.divmod(keys, len(words))
                before, mark = np.divmod(before, 65)
                part = layout.of(words, before, word).astype(np.int16 if parts < 1 << 15 else np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                rank = np.empty(len(words), np.int32)
                for p in range(parts):
                    own = order[ends[p]:ends[p + 1]]
                    if not len(own):
                        continue
                    x, y = before[own], word[own]
                    uses = np.zeros(len(words), bool)
                    uses[x] = uses[y] = True
                    used = np.flatnonzero(uses)
                    rank[used] = np.arange(len(used), dtype=np.int32)
                    data = [np.diff(rank[x], prepend=np.int32(0)), np.diff(rank[y], prepend=np.int32(0)), mark[own].astype(np.uint8),
                            first[own], others[own]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), b["chunk"].slice(row, 1), pa.array([zlib.compress(b" ".join(words.take(pa.array(used)).to_pylist()), 1)], pa.binary()),
                         *(pa.array([planes(d)], pa.binary()) for d in data)],
                        ["part", "chunk", "words", "before", "word", "mark", "first", "others"])
                del lengths, keys, at, words, role, first, others, before, word, mark, part, order
                give_back()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        lists = pc.split_pattern(pa.chunked_array([pa.array([zlib.decompress(w)], pa.large_binary()) for w in rows["words"].to_pylist()]), b" ")
        many = pc.list_value_length(lists).to_pylist()
        code = pc.cast(lists.combine_chunks().flatten(), pa.binary()).dictionary_encode()
        order = pc.sort_indices(code.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        place = rank[code.indices.to_numpy()]
        read = lambda c, kind: [unplanes(x, kind) for x in rows[c].to_pylist()]
        mark = read("mark", "u1")
        sizes = [len(x) for x in mark]
        shift = np.repeat(np.cumsum([0, *many])[:-1], sizes)
        before, word = (place[np.concatenate([np.cumsum(x) for x in read(c, "<i4")]) + shift] for c in ("before", "word"))
        keys, at = np.unique((before * 65 + np.concatenate(mark)) * len(order) + word, return_inverse=True)
        n = [np.bincount(at, np.concatenate(read(c, "<i8")), len(keys)).astype("<i8") for c in ("first", "others")]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([b" ".join(code.dictionary.take(order).to_pylist())], pa.binary()),
                         *(pa.array([planes(x)], pa.binary()) for x in (np.diff(keys, prepend=0), *n)),
                         pa.array([rows["chunk"].to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                         pa.array([planes(np.diff(at, prepend=0).astype("<i4"))], pa.binary())], schema=_PARTS)

    sent = table.select("chunk", "roles", "lengths", "numbers", "words").mapInArrow(
        send, "part int, chunk bigint, words binary, before binary, word binary, mark binary, first binary, others binary")
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(
        merge, "part int, words binary, keys binary, first binary, others binary, chunks array<bigint>, sizes array<bigint>, at binary")


_PARTS = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("keys", pa.binary()), ("first", pa.binary()), ("others", pa.binary()),
                    ("chunks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("at", pa.binary())])


def _part(batch: pa.RecordBatch, row: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words before, marks, words' places, counts kept for the tables, left-out counts) of a part's triples."""
    words = batch["words"][row].as_py().split(b" ")
    gaps, first, others = (unplanes(batch[c][row].as_py(), "<i8") for c in ("keys", "first", "others"))
    before, word = np.divmod(np.cumsum(gaps), len(words))
    before, mark = np.divmod(before, 65)
    return words, before, mark, word, first, others


def _runs(words: list[bytes], ends: tuple[np.ndarray, np.ndarray], before: np.ndarray, mark: np.ndarray,
          word: np.ndarray) -> Iterator[tuple[slice, list[tuple]]]:
    """Stretches of triples that hold all of their words before, each cut into runs (slice in it, what ``Spelling`` takes)."""
    cuts = [*np.flatnonzero(np.diff(before, prepend=-1)).tolist(), len(before)]
    lo = 0
    for k, hi in enumerate(cuts[1:], 1):
        if hi - lo < TRIPLES and hi < len(before) and cuts[k + 1] - lo <= 2 * TRIPLES:
            continue
        own = [words[w] for w in word[lo:hi].tolist()]
        yield slice(lo, hi), [
            (slice(a, b), own[a:b], mark[lo + a:lo + b], ends[0][before[lo + a:lo + b]], ends[1][before[lo + a:lo + b]])
            for a, b in stretches(own)]
        lo = hi


def byte_code(counts: DataFrame) -> ByteCode:
    """The code of bytes by their counts in the training words (each word's own byte and one space)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            words, c = b["word"].to_pylist(), b["c"].to_numpy()
            size = np.fromiter(map(len, words), np.int64, len(words))
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(c, size), 256).astype(np.int64)
            total[32] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["byte", "n"])

    sums = counts.select("word", "c").mapInArrow(work, "byte int, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
    out = np.zeros(256, np.int64)
    for r in sums.collect():  # 256 rows
        out[r["byte"]] = r["n"]
    return ByteCode(out)


def slot_values(zero: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logit, seen) of slots that counted so many zeros and ones, a byte each."""
    logit = np.rint(np.log((one + PRIOR) / (zero + PRIOR)).clip(-LIMIT, LIMIT) * STEPS)
    return logit.astype(np.int8), np.log2(zero + one + 1.0).astype(np.int8)


def summed(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct cells in order, the sum of each)."""
    if not len(cells):
        return cells, n
    if n.max() < 1 << 24:  # 38 bits of a cell and 24 of its count sort together, faster than argsort
        both = cells << 24
        both |= n
        both.sort()
        cells, n = both >> 24, both & ((1 << 24) - 1)
    else:
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(n, first)


class _Held:
    """Counts by cell (slot and bit) that a task has not sent yet."""

    def __init__(self):
        self.cells, self.counts, self.size, self.limit = [], [], 0, HELD

    def add(self, cells: np.ndarray, counts: np.ndarray) -> bool:
        """Take counts; whether so many cells are held that they should be sent."""
        full = False
        if self.size + len(cells) > self.limit:
            self.merge()
            full = self.size > HELD // 2
            self.limit = max(HELD, 2 * self.size)
        self.cells.append(cells)
        self.counts.append(counts)
        self.size += len(cells)
        return full

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.cells:
            cells, counts = summed(np.concatenate(self.cells), np.concatenate(self.counts))
            self.cells, self.counts, self.size = [cells], [counts], len(cells)
            return cells, counts
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _bit_counts(counts: DataFrame, parts: DataFrame, code: ByteCode, chunked: int) -> DataFrame:
    """(predictor, block, distinct, first, others, blocks): a block's summed counts by cell (hash and bit).

    ``first`` are those of the training documents kept for the tables, ``others`` those of the left-out
    ones; ``distinct`` is the block's number of hashes, ``blocks`` log2 of a predictor's number of blocks.
    All predictors but the last: their contexts inside a word from the distinct words, those that reach
    the word before from the distinct pairs of its end and the word's start.
    """
    blocks = max(BLOCK_BITS, chunked.bit_length() + 2)
    width = WIDE + 1 - blocks

    class Sending:
        def __init__(self):
            self.held = {(role, i): _Held() for role in (1, 2) for i in range(N - 1)}

        def out(self, role: int, i: int) -> pa.RecordBatch:
            cells, n = self.held[role, i].merge()
            self.held[role, i] = _Held()
            own, first = np.unique(cells >> width, return_index=True)
            ends = [*first[1:].tolist(), len(cells)]
            data = [pack_counts(cells[a:b] & ((1 << width) - 1), n[a:b]) for a, b in zip(first.tolist(), ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array([role] * len(own), pa.int32()), pa.array([i] * len(own), pa.int32()),
                 pa.array(own, pa.int64()), pa.array(data, pa.binary())], ["role", "predictor", "block", "counts"])

        def take(self, inside: bool, times: tuple, words: list[bytes], *around: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo, hi in stretches(words):
                own = Spelling(words[lo:hi], *(x[lo:hi] for x in around))
                often = [own.often(n[lo:hi]).astype(np.int64) for n in times]
                for which, node, bit in code.decisions(own.data):
                    place = own.place[which]
                    for i in range(N - 1):
                        near = place <= i if i < N - 2 else place == 0
                        for role in (1, 2):
                            use = np.flatnonzero((near != inside) & (often[role - 1][which] > 0))
                            cells = wide_slots(own.contexts[i][which[use]], node[use]) << 1 | bit[use]
                            if self.held[role, i].add(cells, often[role - 1][which[use]]):
                                yield self.out(role, i)

        def rest(self) -> Iterator[pa.RecordBatch]:
            for role, i in self.held:
                yield self.out(role, i)

    def from_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, words, n = Sending(), [], []

        def taken() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(words)), key=words.__getitem__)
            both = np.concatenate(n, axis=1)[:, order]
            none = np.zeros(len(words), np.int64)
            yield from to.take(True, tuple(both), [words[k] for k in order], none, none.astype(np.uint64), np.full((len(words), 3), 300))

        for b in batches:
            words += b["word"].to_pylist()
            n.append(np.stack([b["c"].to_numpy() - b["apart"].to_numpy(), b["apart"].to_numpy()]))
            if len(words) >= 4 * WORDS:
                yield from taken()
                words, n = [], []
        if words:
            yield from taken()
        yield from to.rest()

    def from_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Sending()
        for b in batches:
            for row in range(b.num_rows):
                words, before, mark, word, first, others = _part(b, row)
                tails = word_ends(words)[1]
                _, first_of, tail = np.unique((tails[:, 0] * 512 + tails[:, 1]) * 512 + tails[:, 2], return_index=True, return_inverse=True)
                tails = tails[first_of]
                heads = pa.array([w[:4] for w in words], pa.binary()).dictionary_encode()
                order = pc.sort_indices(heads.dictionary)
                rank = np.empty(len(order), np.int64)
                rank[order.to_numpy()] = np.arange(len(order))
                key = (tail[before] * 65 + mark) * len(order) + rank[heads.indices.to_numpy()][word]
                own, at = np.unique(key, return_inverse=True)
                heads = heads.dictionary.take(order).to_pylist()
                times = tuple(np.bincount(at, n, len(own)) for n in (first, others))
                del words, before, mark, word, first, others, key, at, tail
                yield from to.take(False, times, [heads[h] for h in (own % len(heads)).tolist()],
                                   own // len(heads) % 65, (own // len(heads) // 65).astype(np.uint64), tails[own // len(heads) // 65])
                give_back()
        yield from to.rest()

    def add(key: tuple, part: pa.Table) -> pa.Table:
        roles, data, sums = part["role"].to_pylist(), part["counts"], []
        for role in (1, 2):
            held = _Held()
            for r, own in zip(roles, data):
                if r == role:
                    held.add(*unpack_counts(own.as_py()))
            sums.append(held.merge())
        distinct = len(np.unique(np.concatenate([sums[0][0], sums[1][0]]) >> 1))
        return pa.table({"predictor": [key[0].as_py()], "block": [key[1].as_py()], "distinct": [distinct],
                         "first": [pack_counts(*sums[0])], "others": [pack_counts(*sums[1])]}, schema=_BLOCKS)

    schema = "role int, predictor int, block bigint, counts binary"
    sent = counts.select("word", "c", "apart").mapInArrow(from_words, schema).unionByName(
        parts.select("words", "keys", "first", "others").mapInArrow(from_parts, schema))
    return sent.groupBy("predictor", "block").applyInArrow(
        add, "predictor int, block bigint, distinct bigint, first binary, others binary").withColumn("blocks", F.lit(blocks))


_BLOCKS = pa.schema([("predictor", pa.int32()), ("block", pa.int64()), ("distinct", pa.int64()), ("first", pa.binary()),
                     ("others", pa.binary())])


def fill(model: BitModel, counts: DataFrame, blocks: int, both: bool) -> None:
    """Set the model's tables from summed counts, block by block; ``both``: also from the left-out documents'."""
    bits, width = model.bits, WIDE + 1 - blocks
    # a piece holds whole blocks
    pieces = [max(0, min(b - PIECE_BITS, blocks)) for b in bits]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block, first, others in zip(*(b[c].to_pylist() for c in ("predictor", "block", "first", "others"))):
                cells, n = unpack_counts(first)
                if both:
                    more = unpack_counts(others)
                    cells, n = np.concatenate([cells, more[0]]), np.concatenate([n, more[1]])
                # a block is a stretch of the table's slots, for a slot is the upper bits of the hash
                slot = cells >> (1 + WIDE - bits[i])
                sums = np.zeros((1 << (bits[i] - blocks), 2), np.int64)
                np.add.at(sums, (slot, cells & 1), n)
                logit, seen = slot_values(sums[:, 0], sums[:, 1])
                level = np.minimum(seen >> 1, LEVELS[1] - 1).astype(np.uint8).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
                seen = np.bitwise_or.reduce(level, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([block >> blocks - pieces[i]], pa.int64()), pa.array([block], pa.int64()),
                     pa.array([zlib.compress(logit.tobytes(), 1)], pa.binary()),
                     pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], ["predictor", "piece", "block", "logit", "seen"])

    made = pin(counts.select("predictor", "block", "first", "others").mapInArrow(
        work, "predictor int, piece bigint, block bigint, logit binary, seen binary"))
    model.tables = []
    for i, b in enumerate(bits):
        held, size = [], 1 << b - pieces[i]
        for piece in range(1 << pieces[i]):
            data = bytearray(len(_BEGIN) + size + (size >> 2 if i == N - 2 else 0))
            data[:len(_BEGIN)] = _BEGIN
            for r in made.filter((F.col("predictor") == i) & (F.col("piece") == piece)).collect():  # one piece of a table
                for c, part, skip in (("logit", 1 << b - blocks, 0), ("seen", 1 << b - blocks - 2, size)):
                    if c == "logit" or i == N - 2:
                        at = len(_BEGIN) + skip + (r["block"] - (piece << blocks - pieces[i])) * part
                        data[at:at + part] = zlib.decompress(r[c])
            held.append(counts.sparkSession.sparkContext.broadcast(data))
            del data
            give_back()
        model.tables.append(Table(b, held))


def pack_counts(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending cells by the gaps between them, and a byte for each count, with the large ones apart."""
    gaps = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    large = n[n >= 255].astype("<i8")
    head = np.array([len(cells)], "<i8")
    return zlib.compress(b"".join([head.tobytes(), gaps.T.tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), large.tobytes()]), 1)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k, 8).reshape(4, k).T).view("<u4").ravel()
    n = np.frombuffer(raw, np.uint8, k, 8 + 4 * k).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<i8", -1, 8 + 5 * k)
    return np.cumsum(gaps.astype(np.int64)), n


def fit(table: DataFrame, counts: DataFrame | None = None, parts: DataFrame | None = None, dealt: Layout | None = None,
        begun: Broadcast | None = None) -> BitModel:
    """Tables, weights and refinement from the chunks' training documents (``word_counts``, ``triples``, ``layout``, ``heads``)."""
    spark = table.sparkSession
    chunked = table.count()
    counts = pin(word_counts(table)) if counts is None else counts
    dealt = dealt or Layout(part_number(chunked))
    parts = pin(triples(table, dealt)) if parts is None else parts
    code = byte_code(counts)
    with Scratch(spark) as scratch:
        cells = scratch.stash(_bit_counts(counts, parts, code, chunked))
        release(spark)
        sizes = {r["predictor"]: r for r in cells.groupBy("predictor").agg(
            F.sum("distinct").alias("n"), F.max("blocks").alias("blocks")).collect()}  # a row a predictor
        blocks = max((r["blocks"] for r in sizes.values()), default=BLOCK_BITS)
        bits = [max(table_bits(sizes[i]["n"] if i in sizes else 0), blocks + 2) for i in range(N - 1)]
        model = BitModel(code, bits)
        fill(model, cells, blocks, both=False)
        start = model

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, tokens = start, 0.0
            model.weights, model.pace, model.refine = np.full((GATES, N), 1.0 / N), np.full((GATES, N), 1e-4), 0 * model.refine
            for b in batches:
                for row in range(b.num_rows):
                    words, before, mark, word, first, others = _part(b, row)
                    # a word before without left-out followers has nothing to learn from
                    use = np.flatnonzero((np.bincount(before, others, len(words)) > 0)[before] & (first + others > 0))
                    head = _head(begun.value, b["part"][row].as_py(), dealt, words[before[0]]) if begun and len(before) else None
                    ends, first, others = word_ends(words), first[use], others[use]
                    for own, runs in _runs(words, ends, before[use], mark[use], word[use]):
                        tokens += model.learn(runs, first[own], others[own], head and head[:2])
                    give_back()
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tokens]), pa.array([model.weights.tobytes()], pa.binary()),
                     pa.array([model.refine.tobytes()], pa.binary())], ["tokens", "weights", "refine"])

        with _single_rows(spark):
            learned = pin(parts.select("part", "words", "keys", "first", "others").mapInArrow(
                work, "tokens double, weights binary, refine binary"))
        total, weights, refine = 0.0, np.zeros((GATES, N)), np.zeros((256 * REFINE_STEPS, 2))
        for r in learned.toLocalIterator():  # one row a task, added one at a time
            total += r["tokens"]
            weights += r["tokens"] * np.frombuffer(r["weights"]).reshape(GATES, N)
            refine += np.frombuffer(r["refine"]).reshape(-1, 2)
        start.destroy()
        model = BitModel(code, bits, weights / total if total else None, refine)
        fill(model, cells, blocks, both=True)
        return model


@contextmanager
def _single_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of one row, for a part's row has all its triples."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, now)


def part_number(chunked: int) -> int:
    return max(LEAST_PARTS, PARTS * chunked)


def word_counts(table: DataFrame) -> DataFrame:
    """(word, c, apart): how often each word (the end: the empty word) occurs in training documents, where it does.

    ``apart``: of these, in the documents left out of the first tables."""
    pairs = table.select(F.explode(F.arrays_zip("words", "trained", "apart")).alias("t")).filter("t.trained > 0")
    return pairs.groupBy(F.col("t.words").alias("word")).agg(F.sum("t.trained").alias("c"), F.sum("t.apart").alias("apart"))


def score_documents(docs: DataFrame, held_out: int = 2, modulus: int = 7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Scores of every row; documents whose crc32(id) mod ``modulus`` is ``held_out`` are not learned from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with Scratch(spark) as scratch:
        table = scratch.stash(chunks(rows, held_out, modulus))
        counts = scratch.stash(word_counts(table))
        sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        tokens, distinct = sums[0] or 0, sums[1]
        dealt = layout(counts, table.count())
        with _single_rows(spark):
            parts = scratch.stash(triples(table, dealt))
            begun = spark.sparkContext.broadcast(heads(parts, dealt))
        release(spark)
        model = fit(table, counts, parts, dealt, begun)
        release(spark)

        def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    words, before, mark, word, first, others = _part(b, row)
                    cost = np.empty(len(word), "<f4")
                    head = _head(begun.value, b["part"][row].as_py(), dealt, words[before[0]]) if len(before) else None
                    for own, runs in _runs(words, word_ends(words), before, mark, word):
                        cost[own] = model.word_costs(runs, (first + others)[own], head and (head[0], head[1] + head[2]))
                    at = np.cumsum(unplanes(b["at"][row].as_py(), "<i4"), dtype=np.int64)
                    sent = np.split(cost[at], np.cumsum(b["sizes"][row].as_py())[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [b["chunks"][row].values, pa.array([b["part"][row].as_py()] * len(sent), pa.int32()),
                         pa.array([planes(x) for x in sent], pa.binary())], ["piece", "part", "cost"])
                    give_back()

        with _single_rows(spark):
            costs = scratch.stash(parts.mapInArrow(spelled, "piece bigint, part int, cost binary"))
        model.destroy()
        begun.destroy()
        scratch.remove(3)  # the parts: their costs are written
        release(spark)
        wanted = table.select(F.col("chunk").alias("piece"), F.posexplode("words").alias("i", "word"))
        known = scratch.stash(wanted.join(counts.hint("shuffle_merge"), "word").select("piece", "i", "c"))
        release(spark)
        known = known.unionByName(costs, allowMissingColumns=True)

        def base(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _SCORES.empty_table()
            row = left.combine_chunks().to_batches()[0]
            _, keys, at, words = _decoded(row, 0)
            part = dealt.of(words, keys // (65 * len(words)), keys % len(words))
            order = np.argsort(part.astype(np.int16 if dealt.total < 1 << 15 else np.int64), kind="stable")
            ends = np.searchsorted(part[order], np.arange(dealt.total + 1))
            cost = np.empty(len(keys))
            sent = right.filter(pc.is_valid(right["part"]))
            for p, own in zip(sent["part"].to_pylist(), sent["cost"].to_pylist()):
                cost[order[ends[p]:ends[p + 1]]] = unplanes(own, "<f4")
            del keys, words, part, order, ends, sent
            give_back()
            row = row.select(["ids", "roles", "n_bytes", "lengths", "numbers"]).append_column(
                "cost", pa.array([cost[at].tobytes()], pa.binary()))
            return _chunk_scores(row, right.filter(pc.is_valid(right["i"])), tokens, distinct)

        left = table.select("chunk", "ids", "roles", "n_bytes", "lengths", "numbers", "words")
        scored = scratch.stash(left.groupBy("chunk").cogroup(known.groupBy("piece")).applyInArrow(
            base, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, n_bytes bigint, "
                  "scores array<double>, own array<double>"))
        sums = scored.select(F.posexplode("own").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        best = max(((r["v"], -r["k"]) for r in sums), default=(0.0, 0))[1] * -1
        score = F.col("scores")[best]
        return pin(scored.select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score",
            score.alias("score"), (-score / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte")))


#: Shares of the exact word counts in the mixture, of which one is chosen (0: spelling alone).
SHARES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("n_bytes", pa.int64()), ("scores", pa.list_(pa.float64())),
                     ("own", pa.list_(pa.float64()))])


def _chunk_scores(row: pa.RecordBatch, right: pa.Table, tokens: int, distinct: int) -> pa.Table:
    """The scores of a chunk's documents from its spelled costs and the exact counts of its words.

    Everything is added as logarithms, so a word of any length costs what its bytes cost."""
    lengths = np.array(row["lengths"][0].as_py(), np.int64)
    role = np.array(row["roles"][0].as_py())
    flat = unpack(row["numbers"][0].as_py(), lengths)
    spelled = -np.frombuffer(row["cost"][0].as_buffer(), "<f8") * math.log(2)
    c = np.zeros(int(flat.max()) + 1)
    c[right["i"].to_numpy()] = right["c"].to_numpy()
    c = c[flat]
    start = np.cumsum(lengths) - lengths
    total = lambda each: np.add.reduceat(each, start)
    with np.errstate(divide="ignore"):  # a word that wasn't seen has the logarithm of 0
        counted = np.log(c) - math.log(max(tokens, 1))
        without = np.log(np.maximum(c - 1, 0)) - math.log(max(tokens - 1, 1))
    scores, own = [], []
    for share in SHARES:
        share = share if tokens else 0.0
        mixed = lambda seen, s=share: spelled if s == 0 else np.logaddexp(math.log(1 - s) + spelled, math.log(s) + seen)
        scores.append(total(mixed(counted)) / math.log(10))
        own.append(total(mixed(without)) / math.log(10) * (role > 0))
    whole = math.log10(tokens + distinct + 1) if tokens else 0.0
    table = lambda xs: pa.array(np.stack(xs, axis=1).tolist(), pa.list_(pa.float64()))
    return pa.table([row["ids"][0].values, pa.array(role == 0), pa.array(lengths), pa.array(total((c > 0).astype(np.int64))),
                     pa.array(total(np.log10(c + 1)) - lengths * whole), row["n_bytes"][0].values, table(scores), table(own)],
                    schema=_SCORES)
