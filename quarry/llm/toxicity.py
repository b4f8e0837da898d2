"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding makes disguises equal: compatibility forms, accents and invisible characters go, look-alike
letters of other scripts become Latin, and digits or signs inside words become the letters they stand
for.  The lexicon (words and word beginnings) and its weights (log odds) are learned from labelled
documents; phrases in which a listed word is common in clean documents are exceptions, whose match
cancels the words inside.  A document's score is its summed weight over its length, calibrated on
the labelled documents by the pool-adjacent-violators rule.

Learning uses at most ``LABELLED`` labelled documents, taken by a hash of their id (a documented
bound); all documents are scored, whole.

Defined cases: null and empty texts have no words and get the score of a text without matches; null
labels are ignored and repeated ones averaged; without labels of both kinds every score is 0; other
columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import folded
from .common import bounded_batches
from .quality import isotonic

LABELLED = 200_000
MIN_DOCS = 4
MIN_WEIGHT = 1.5
MIN_G2 = 20.0
PREFIXES = (5, 6, 7)
EXCEPTION_DOCS = 3
EXCEPTION_WEIGHT = 0.5
THRESHOLD = 0.5
#: Words added to a text's length, so that one match in a very short text doesn't outweigh all.
LENGTH_PRIOR = 30
_FLUSH = 200_000
_BINS = 2000

# Letters of other scripts and Latin variants that look like a Latin letter.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "вьƅ", "c": "сϲⅽ", "d": "ԁđⅾ", "e": "еεє℮", "f": "ƒ", "g": "ɡց", "h": "һнհ", "i": "іιıɩӏ",
    "j": "јϳ", "k": "кκ", "l": "ⅼłɭ", "m": "мⅿ", "n": "пηո", "o": "оοօøס", "p": "рρ", "q": "ԛ", "r": "гɾ",
    "s": "ѕꜱ", "t": "тτŧ", "u": "υսц", "v": "νѵⅴ", "w": "ԝωш", "x": "хχⅹ", "y": "уүγ", "z": "ᴢƶ",
}
# Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}

_LETTERS = str.maketrans({**{c: k for k, cs in HOMOGLYPHS.items() for c in cs}, **DIGITS, "l": "i"})
# A run of signs before a letter or digit, or after one; "!" and "|" at the end of a word, or doubled, are punctuation.
_SIGN = re.compile(r"(?:[@$€£]|(?<![!|])[!|](?![!|]))+(?=[^\W_])|(?<=[^\W_])[@$€£]+")
_DIGITS = str.maketrans({**DIGITS, "l": "i"})


def words(text: bytes) -> list[bytes]:
    """Folded words; "l" and "i" are one letter, as "1", "!" and "|" stand for either."""
    s = text.decode("utf-8", "replace")
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = "".join([c for c in s if c < "\x80" or unicodedata.category(c) not in ("Mn", "Cf")])
    s = s.lower()
    if any(c in s for c in SIGNS):
        s = _SIGN.sub(lambda m: "".join(map(SIGNS.__getitem__, m[0])), s)
    return folded(s.translate(_DIGITS if s.isascii() else _LETTERS).encode("utf-8", "replace")).split()


def spaced(ws: list[bytes]) -> str:
    """The text that is matched: each word with a space of its own on either side."""
    return (b" " + b"  ".join(ws) + b" ").decode("latin-1")


def terms_of(ws: list[bytes]) -> set[bytes]:
    """Candidate terms of a document: its words (" word ") and their beginnings (" wor")."""
    own = set(ws)
    return {b" " + w + b" " for w in own} | {b" " + w[:k] for w in own for k in PREFIXES if len(w) > k}


class Lexicon:
    """Weights of terms, exception phrases, and the calibration curve; matched by one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        self.weights, self.exceptions = weights, exceptions
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}  # each worker builds its own

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            self.automaton.add_word(term, (len(term), weight, False))
        for phrase in self.exceptions:
            self.automaton.add_word(phrase, (len(phrase), 0.0, True))
        self.automaton.make_automaton()

    def hits(self, ws: list[bytes]) -> list[tuple[int, float]]:
        """(position, weight) of the longest listed term at each word, without those inside exceptions."""
        if not ws or not (self.weights or self.exceptions):
            return []
        if self.automaton is None:
            self._build()
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight, exception) in self.automaton.iter(spaced(ws)):
            start = end - size + 1
            if exception:
                spared.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        if not spared:
            return [(s, w) for s, (_, w) in best.items()]
        spared.sort()
        lows = np.array([s for s, _ in spared])
        reach = np.maximum.accumulate([e for _, e in spared])
        inside = lambda s, e: (k := int(np.searchsorted(lows, s, "right")) - 1) >= 0 and reach[k] >= e
        return [(s, w) for s, (size, w) in best.items() if not inside(s, s + size - 1)]

    def density(self, text: bytes) -> tuple[float, int]:
        """Summed weight over length, and the number of matches that count."""
        ws = words(text)
        found = self.hits(ws)
        return sum(w for _, w in found) / (len(ws) + LENGTH_PRIOR), len(found)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most LABELLED labelled documents; ``labels`` is (doc_id, label)."""
    own = (labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id")
           .agg((F.avg("label") >= 0.5).cast("int").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED))
    own = F.broadcast(own)  # at most LABELLED ids and bits
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(own, "doc_id").select("text", "y")


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch["text"]]


def _count(rows: DataFrame, find) -> DataFrame:
    """(term, toxic, clean): documents of either kind that hold each term ``find`` gives; counted by task first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(held[0] | held[1])
            done = pa.RecordBatch.from_arrays(
                [pa.array(every, pa.binary()), pa.array([held[1][t] for t in every], pa.int64()),
                 pa.array([held[0][t] for t in every], pa.int64())], ["term", "toxic", "clean"])
            held[0].clear()
            held[1].clear()
            return done

        for b in batches:
            for text, y in zip(_texts(b), b["y"].to_pylist()):
                held[y].update(find(text))
                if len(held[0]) + len(held[1]) > _FLUSH:
                    yield out()
        yield out()

    counted = rows.mapInArrow(work, "term binary, toxic bigint, clean bigint")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _with_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """Adds the smoothed log odds and the likelihood ratio statistic of each term."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n = float(n_toxic + n_clean)
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * (share / n)))).otherwise(0.0)
    return counts.withColumn("weight", F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))).withColumn(
        "g2", 2 * (part(a, n_toxic) + part(b, n_clean)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn lexicon, exceptions and calibration from the labelled documents."""
    bounded_batches(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col)
    kinds = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = kinds.get(1, 0), kinds.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, [])
    listed = _with_odds(_count(rows, lambda t: terms_of(words(t))).filter(F.col("toxic") >= MIN_DOCS), n_toxic, n_clean)
    listed = listed.filter((F.col("weight") >= MIN_WEIGHT) & (F.col("g2") >= MIN_G2))
    best = listed.orderBy(F.desc("g2"), "term").select("term", "weight").collect()  # terms of the labelled sample
    lexicon = Lexicon({bytes(r["term"]).decode("latin-1"): r["weight"] for r in best}, [])
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(text: bytes) -> set[bytes]:
        """Each match with the word before it, and with the word after it."""
        ws = words(text)
        found = {s for s, _ in held.value.hits(ws)}
        out, at = set(), 0
        for k, w in enumerate(ws):
            if at in found:
                out |= {b" " + b"  ".join(ws[i:i + 2]) + b" " for i in (k - 1, k) if 0 <= i < len(ws) - 1}
            at += len(w) + 2
        return out

    odds = _with_odds(_count(rows, phrases).filter(F.col("clean") >= EXCEPTION_DOCS), n_toxic, n_clean)
    spared = (odds.filter(F.col("weight") <= EXCEPTION_WEIGHT).orderBy(F.desc("clean"), "term")
              .select("term").collect())
    lexicon.exceptions = sorted(bytes(r["term"]).decode("latin-1") for r in spared)
    lexicon.automaton = None
    final = docs.sparkSession.sparkContext.broadcast(lexicon)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([final.value.density(t)[0] for t in _texts(b)])
            cell = np.minimum(x * _BINS, 4 * _BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b["y"]], ["cell", "y"])

    cells = sorted(tuple(r) for r in rows.mapInArrow(densities, "cell int, y int").groupBy("cell")
                   .agg(F.count(F.lit(1)), F.sum("y")).collect())  # at most 4 * _BINS + 1 rows
    cell, n, s = (np.array(v, dtype=float) for v in zip(*cells))
    lexicon.curve = ((cell + 0.5) / _BINS, np.clip(isotonic(n, s), 0.0, 1.0))
    lexicon.automaton = None
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_matches) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            found = [own.density(t) for t in _texts(b)]
            x = np.array([d for d, _ in found])
            score = np.zeros(len(x)) if own.curve is None else np.interp(x, *own.curve)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score), pa.array([n for _, n in found], pa.int64())],
                                             ["doc_id", "score", "n_matches"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_matches bigint")


def predicted(score: Column) -> Column:
    return (score >= THRESHOLD).cast("int")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_matches) of every row, learned from ``labels`` (doc_id, label)."""
    return score_documents(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
