"""BPE encoding and decoding with a contiguous rank array.

A word is a row of parts; next to it lies the row of ranks of adjacent pairs.  Each step scans the
ranks for the leftmost minimum, replaces the left part by the merged one, deletes the boundary by
moving the rest of both rows one place, and looks up the two neighbouring ranks again.  All distinct
words of a batch advance together as the rows of one matrix, so a step is a handful of array
operations.  Words of more than ``SHORT`` bytes, for which moving rows is quadratic, use a linked
list with a heap that follows the same order of merges.

Text goes through the vocabulary's own steps: special tokens are cut out first, then NFC and lower
case where the file asks for them, then its word pattern, then bytes.  White space never joins two
words of such a file, so the pieces between ASCII white space are encoded once and kept in a bounded
table of each Python worker.

Defined cases: a null or empty text has no tokens and decodes to the empty text; a text of any
length is handled whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import bounded_batches

SHORT = 128
#: Pieces of text kept by a worker; beyond it the table is emptied (it then holds about 60 MB).
KEPT = 300_000
_NONE = np.int32(1 << 30)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Fixed rule of that format: printable bytes of Latin-1 stand for themselves, the others take the
    characters from U+0100 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE file with a word pattern whose matches never hold white space."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model, steps = conf["model"], (conf.get("normalizer") or {}).get("normalizers", [])
        splits = [p for p in (conf.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if model["type"] != "BPE" or len(splits) != 1 or not splits[0]["invert"]:
            raise ValueError("not a BPE file with a word pattern")
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        kinds = {s["type"] for s in steps}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.special = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.base = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.utf8 = [x.encode() for x in self.names]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.joined = joined  # by rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.byte_level = (conf.get("decoder") or {}).get("type") == "ByteLevel"
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.table: dict[bytes, bytes] = {}
        self.spec, self.library = spec, None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NONE where the pair has no merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = 2
        while width <= SHORT:
            own = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            if len(own):
                self._matrix(words, own, sizes[own], width, out)
            width *= 2
        for k in np.flatnonzero(sizes > SHORT).tolist():
            out[k] = self._long(words[k])
        return out

    def _matrix(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows.tolist()), np.uint8).reshape(-1, width)
        parts = self.base[raw]
        every = np.arange(len(rows))
        parts[every, size - 1] = self.last[raw[every, size - 1]]
        inside = np.arange(width - 1) < (size - 1)[:, None]
        ranks = np.where(inside, self.ranks(parts[:, :-1], parts[:, 1:]), _NONE)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            least = ranks[every, at]
            done = least == _NONE
            for k, p, n in zip(rows[done].tolist(), parts[done].astype("<u4"), size[done].tolist()):
                out[k] = p[:n].tobytes()
            go = ~done
            if not go.any():
                return
            rows, size, parts, ranks, at, least = rows[go], size[go] - 1, parts[go], ranks[go], at[go], least[go]
            every = np.arange(len(rows))
            parts[every, at] = self.joined[least]
            # delete the boundary right of the merged part: both rows move up by one place
            cols = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, cols + (cols > at[:, None]), axis=1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), axis=1) if len(cols) else np.full((len(rows), 1), _NONE)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < size - 1)
            ranks[right, at[right]] = self.ranks(parts[right, at[right]], parts[right, at[right] + 1])

    def _long(self, word: bytes) -> bytes:
        """The same merges for one long word, in n log n steps."""
        raw = np.frombuffer(word, np.uint8)
        first = self.base[raw]
        first[-1] = self.last[raw[-1]]
        part, n = first.tolist(), len(raw)
        ahead, back = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = lambda i: int(self.ranks(np.array([part[i]]), np.array([part[ahead[i]]]))[0])
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(self.ranks(first[:-1], first[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = ahead[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j], ahead[i] = int(self.joined[r]), -1, ahead[j]
            if ahead[i] >= 0:
                back[ahead[i]] = i
            for k in (back[i], i):
                if k >= 0 and ahead[k] >= 0 and (r := rank(k)) != _NONE:
                    heapq.heappush(heap, (r, k, part[k], part[ahead[k]]))
        ids, i = [], 0
        while i >= 0:
            ids.append(part[i])
            i = ahead[i]
        return np.array(ids, "<u4").tobytes()

    def words(self, text: str) -> list[bytes]:
        """The words of one piece of text, as bytes.

        Characters that this Python's Unicode tables do not know yet may have a class in the
        tokenizer's: such pieces take its own normal form and word split.
        """
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text if c > "\u02ff"):
            if self.library is None:
                self.library = Tokenizer.from_str(self.spec)
            known = self.library.normalizer.normalize_str(text)
            return [bytes(self.byte_of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(known)]
        return [w.encode() for w in self.pattern.findall(self.normal(text))]

    def normal(self, text: str) -> str:
        """NFC, then each character in lower case by itself (no rule looks at its neighbours)."""
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return text

    def learn(self, chunks: set[bytes]) -> None:
        """Encode pieces of text that the worker's table lacks."""
        if len(self.table) + len(chunks) > KEPT:
            self.table.clear()
        todo = [c for c in chunks if c not in self.table]
        split = [self.words(c.decode()) for c in todo]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.encode_words(words)))
        for c, ws in zip(todo, split):
            self.table[c] = b"".join([ids[w] for w in ws])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self._sections(t) for t in texts]
        lists = [[s if isinstance(s, int) else s.split() for s in sections] for sections in cut]
        pieces = {c for sections in lists for s in sections if not isinstance(s, int) for c in s}
        self.learn(pieces)
        get = self.table.__getitem__
        return [b"".join([s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(get, s)) for s in sections])
                for sections in lists]

    def _sections(self, text: bytes) -> list:
        """Stretches of ordinary text, and the ids of the special tokens between them."""
        if self.cut is None or b"<" not in text:
            return [text]
        out, at, whole = [], 0, text.decode()
        for m in self.cut.finditer(whole):
            out += [whole[at:m.start()].encode(), self.special[m[0]]]
            at = m.end()
        return [*out, whole[at:].encode()]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for, special tokens included."""
        names = np.frombuffer(ids, "<u4").tolist()
        if not self.byte_level:
            return b" ".join([self.utf8[i] for i in names])
        raw = bytes(self.byte_of[c] for i in names for c in self.names[i])
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(spec: str) -> Vocabulary:
    """The worker's tables of a vocabulary file, built once."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


#: Bytes of text encoded at a time, so that long texts of one batch don't add up.
GROUP = 1 << 22


def groups(values: list[bytes], size: int = GROUP) -> Iterator[list[bytes]]:
    own, held = [], 0
    for v in values:
        if own and held + len(v) > size:
            yield own
            own, held = [], 0
        own.append(v)
        held += len(v)
    if own:
        yield own


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids: bool = True, digests: bool = False,
                     drop_text: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and, as asked, ``token_ids``, and the digests of ids and decoded text.

    Texts are encoded where they lie; nothing is shuffled.  ``path`` is read by the caller's process
    and its content is broadcast (a vocabulary file, a few megabytes).  A column of ``docs`` that is
    named like an added one is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if ids else []
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else []
    names = [a.name for a in added]
    keep = [c for c in docs.columns if c not in names and not (drop_text and c == text_col)]
    schema = T.StructType([docs.schema[c] for c in keep] + added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(held.value)
        for b in batches:
            texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in b[text_col]]
            coded = [x for g in groups(texts) for x in own.encode(g)]
            cols = [pa.array([len(x) // 4 for x in coded], pa.int64())]
            if ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4"))))
            if digests:
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in coded]))
                cols.append(pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in coded]))
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + cols, keep + names)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).mapInArrow(work, schema)


def decode_documents(coded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """``coded`` with the column ``decoded``: the text that each array of ids stands for."""
    spark = coded.sparkSession
    bounded_batches(spark)
    with open(path, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    keep = [c for c in coded.columns if c != "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(held.value)
        for b in batches:
            texts = [own.decode(np.asarray(v.as_py() or [], "<u4").tobytes()).decode() for v in b[ids_col]]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(texts, pa.string())], [*keep, "decoded"])

    return coded.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(
        work, T.StructType([coded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())]))
