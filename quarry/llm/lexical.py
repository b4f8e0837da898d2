"""Ranked lexical search of a set of items (queries) over all documents by a dual-tree search.

A document's score for an item is the inner product of the item's term weights and the document's
saturated term counts, all in whole numbers.  The items form a tree whose nodes hold the largest weight
of each term among their items; every task forms trees over stretches of its documents, whose nodes hold
the largest term value among their documents.  The product of two nodes bounds the score of every pair
below them, so a pair of nodes goes no further if its bound lies below the weakest kth score among the
node's items: whole batches of documents fall for whole batches of items, and no pair that counts is lost.

Kth scores start from a first round that visits, for every item, the leaf with the highest bound in each
stretch; the second round visits all that isn't pruned.  What moves between tasks are k rows an item
and task.  Items are answered in blocks of bounded text; a block's items and term weights are broadcast.

Defined cases: a document whose text is null or has no term takes no part (nor do its statistics); a null
``doc_id`` comes last among equal scores; rows that share an id are ranked each by itself; an item
without terms has no rows; items of equal text are answered once and each gets its own rows; texts of any
length are read whole; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import alnum_words
from .common import Scratch, bounded_batches, heavy_split_join

K = 10
#: Fixed values of the scoring formula: saturation and length share in per cent, in the units of the contract.
LENGTH_SHARE = 75
UNIT = 1_000_000_000
SCALE = 1000
FLATTEN = 8

#: Bytes of item text answered at a time; a larger set of items is dealt into blocks.
BLOCK_BYTES = 1 << 18
#: Documents of one stretch at most, and cells of its dense table of terms by documents.
STRETCH = 8192
CELLS = 8 << 20
#: Children of a node, in both trees.
FAN = 8


def _terms(text: bytes) -> list[bytes]:
    return [w for ws in alnum_words(text) for w in ws]


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The distinct items of one block: vocabulary, and each item's (term, occurrences)."""

    def __init__(self, texts: list[str]):
        self.vocab: dict[bytes, int] = {}
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        for t in texts:
            own = [self.vocab.setdefault(w, len(self.vocab)) for w in _terms(t.encode())]
            self.bags.append(np.unique(np.array(own, np.int64), return_counts=True))


class Node:
    """A node of the tree of items: the largest weight of each of its terms, and its children or its item."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, children: list[Node] | None = None, item: int = -1):
        self.terms, self.weights, self.children, self.item = terms, weights, children, item


def item_tree(items: Items, weights: np.ndarray) -> Node | None:
    """Items whose heaviest term is the same lie next to each other; ``FAN`` children a node."""
    leaves = []
    for no, (terms, times) in enumerate(items.bags):
        own = times * weights[terms]
        if own.any():
            leaves.append(Node(terms[own > 0], own[own > 0], item=no))
    level = sorted(leaves, key=lambda x: (int(x.terms[np.argmax(x.weights)]), x.item))
    while len(level) > 1:
        parents = []
        for k in range(0, len(level), FAN):
            own = level[k:k + FAN]
            terms, at = np.unique(np.concatenate([c.terms for c in own]), return_inverse=True)
            most = np.zeros(len(terms), np.int64)
            np.maximum.at(most, at, np.concatenate([c.weights for c in own]))
            parents.append(Node(terms, most, own))
        level = parents
    return level[0] if level else None


class Best:
    """The k best (score, id) of every item seen so far; ties to smaller ids, null ids last."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor  # floor: a score that k documents are known to reach
        self.scores = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.null = [np.zeros(0, bool)] * n

    def least(self, item: int) -> int:
        """Documents below this score can't be among the item's k best."""
        own = self.scores[item]
        return max(1, int(self.floor[item]), int(own[-1]) if len(own) == self.k else 0)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.least(item)
        if good.any():
            s = np.concatenate([self.scores[item], scores[good]])
            i = np.concatenate([self.ids[item], ids[good]])
            z = np.concatenate([self.null[item], null[good]])
            first = np.lexsort((i, z, -s))[:self.k]
            self.scores[item], self.ids[item], self.null[item] = s[first], i[first], z[first]

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.scores]
        item = np.repeat(np.arange(len(n)), n)
        ids = pa.array(np.concatenate(self.ids), pa.int64(), mask=np.concatenate(self.null))
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids, pa.array(np.concatenate(self.scores))],
                                          ["item", "doc_id", "score"])


class Stretch:
    """Some documents as a dense table of term values, and the tree of maxima over them."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, terms: np.ndarray, values: np.ndarray,
                 weights: np.ndarray):
        """``doc``, ``terms``, ``values``: the cells that aren't zero, by document."""
        n = len(ids)
        # documents lie next to each other if the same term gives most of what they can score
        gain = values * weights[terms]
        order = np.lexsort((-gain, doc))
        first = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        strongest = np.zeros(n, np.int64)
        strongest[doc[first]] = terms[first]
        by = np.lexsort((-np.bincount(doc, gain, n), strongest))
        place = np.empty(n, np.int64)
        place[by] = np.arange(n)
        self.ids, self.null = ids[by], null[by]
        pad = -n % FAN
        leaf = np.zeros((len(weights), n + pad), np.float64)
        leaf[terms, place[doc]] = values
        self.levels = [leaf]  # from documents to the root; columns beyond the last document are empty
        while self.levels[-1].shape[1] > 1:
            x = self.levels[-1]
            if x.shape[1] % FAN:
                x = np.pad(x, ((0, 0), (0, -x.shape[1] % FAN)))
                self.levels[-1] = x
            self.levels.append(x.reshape(len(weights), -1, FAN).max(axis=2))

    def products(self, node: Node, level: int, at: np.ndarray) -> np.ndarray:
        """Bounds (or, for an item and documents, scores) of the node with the given nodes of a level."""
        own = self.levels[level][np.ix_(node.terms, at)]
        if int(node.weights.sum()) * UNIT // SCALE < 1 << 53:
            return (node.weights.astype(np.float64) @ own).astype(np.int64)  # whole numbers, exact as doubles
        return node.weights @ own.astype(np.int64)

    def least(self, node: Node, best: Best) -> int:
        if node.children is None:
            return best.least(node.item)
        return min(self.least(c, best) for c in node.children)

    def visit(self, node: Node, level: int, at: np.ndarray, best: Best) -> None:
        """Search the pairs below the item node and the nodes ``at`` of the documents' tree."""
        bound = self.products(node, level, at)
        if node.children is None and level == 0:
            real = at < len(self.ids)
            best.add(node.item, bound[real], self.ids[at[real]], self.null[at[real]])
            return
        stay = bound >= self.least(node, best)
        at = at[stay][np.argsort(-bound[stay], kind="stable")]
        if not len(at):
            return
        if level:  # the nodes with the highest bounds first: they raise the kth scores for the rest
            level -= 1
            at = (at[:, None] * FAN + np.arange(FAN)).ravel()
        parts = [at[:FAN * FAN], at[FAN * FAN:]] if len(at) > FAN * FAN else [at]
        for child in node.children or [node]:
            for own in parts:
                self.visit(child, level, own, best)

    def dive(self, node: Node, best: Best) -> None:
        """For each item only the documents below the leaf node with the highest bound."""
        if node.children is not None:
            for c in node.children:
                self.dive(c, best)
            return
        level = min(1, len(self.levels) - 1)
        every = np.arange(self.levels[level].shape[1])
        top = every[np.argmax(self.products(node, level, every))]
        at = np.arange(top * FAN, top * FAN + FAN) if level else np.array([0])
        at = at[at < len(self.ids)]
        best.add(node.item, self.products(node, 0, at), self.ids[at], self.null[at])

    def search(self, root: Node, best: Best) -> None:
        self.visit(root, len(self.levels) - 1, np.zeros(1, np.int64), best)


_VECTORS = "doc_id bigint, n bigint, terms binary, times binary"


def _vectors(docs: DataFrame, held) -> DataFrame:
    """(doc_id, n, terms, times): number of terms of each document, and its occurrences of the block's vocabulary."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.vocab.get
        for b in batches:
            n, terms, times = [], [], []
            for v in b.column("text"):
                count, parts = 0, []
                for words in alnum_words(v.as_buffer().to_pybytes() if v.is_valid else b""):
                    count += len(words)
                    parts.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
                own, k = np.unique(np.concatenate(parts), return_counts=True)
                known = own >= 0
                n.append(count)
                terms.append(own[known].astype("<i4").tobytes())
                times.append(k[known].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()),
                                              pa.array(times, pa.binary())], ["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(work, _VECTORS)


def _document_counts(vectors: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term of the block, summed by task before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<i4"), minlength=len(total))
            own[:len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    return vectors.select("terms").mapInArrow(work, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _stretches(batches: Iterator[pa.RecordBatch], total: int, weights: np.ndarray, n_docs: int) -> Iterator[Stretch]:
    room = max(FAN, min(STRETCH, CELLS // max(1, len(weights)) // FAN * FAN))

    def built(part: pa.Table) -> Iterator[Stretch]:
        vectors = part.column("terms").to_pylist()
        doc = np.repeat(np.arange(len(vectors)), [len(x) // 4 for x in vectors])
        if len(doc):
            terms = np.frombuffer(b"".join(vectors), "<i4").astype(np.int64)
            times = np.frombuffer(b"".join(part.column("times").to_pylist()), "<i8")
            flat = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * n_docs // total
                             for x in part.column("n").to_pylist()], np.int64)
            # more than 2^63 / UNIT occurrences in one text don't fit the contract's 64-bit arithmetic either
            values = (UNIT * times) // (SCALE * times + FLATTEN * flat[doc])
            ids = part.column("doc_id")
            yield Stretch(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), doc, terms, values.astype(np.float64),
                          weights)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        while rows >= room:
            table = pa.Table.from_batches(held)
            yield from built(table.slice(0, room))
            held, rows = table.slice(room).to_batches(), rows - room
    if rows:
        yield from built(pa.Table.from_batches(held))


def _round(vectors: DataFrame, state, dive: bool) -> DataFrame:
    """Each task's k best documents of every item."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, n_items, k, floor, total, weights, n_docs = state.value
        best = Best(n_items, k, floor)
        for s in _stretches(batches, total, weights, n_docs):
            if dive:
                s.dive(root, best)
            else:
                s.search(root, best)
        yield best.rows()

    return vectors.mapInArrow(work, "item int, doc_id bigint, score bigint")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, scratch: Scratch, texts: list[tuple[str, str]], k: int) -> DataFrame | None:
    """(key, rank, doc_id, score) of one block of distinct items."""
    spark = docs.sparkSession
    items = Items([t for _, t in texts])
    vectors = scratch.stash(_vectors(docs, spark.sparkContext.broadcast(items)))
    n_docs, total = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(items.vocab), np.int64)
    for r in _document_counts(vectors).collect():  # a row for each term of the block
        df[r["term"]] = r["df"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    root = item_tree(items, weights)
    if root is None or not n_docs:
        return None

    def state(floor: np.ndarray):
        return spark.sparkContext.broadcast((root, len(texts), k, floor, total, weights, n_docs))

    floor = np.zeros(len(texts), np.int64)
    seeds = _ranked(_round(vectors, state(floor), dive=True), k).filter(F.col("rank") == k)
    for r in seeds.collect():  # a row for each item of the block
        floor[r["item"]] = r["score"]
    keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(texts)], "item int, key string")
    best = _ranked(_round(vectors, state(floor), dive=False), k)
    return scratch.stash(best.join(F.broadcast(keys), "item").select("key", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 of every row of ``items``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    scratch.keep()
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    rows = rows.filter(F.col("text").isNotNull()).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    rows = scratch.stash(rows)
    texts = scratch.stash(rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("times")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 if size <= BLOCK_BYTES else -(-2 * size // BLOCK_BYTES)  # half full on average
    found = None
    for b in range(n_blocks):
        own = texts if n_blocks == 1 else texts.filter(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b)
        held = [(r["key"], r["text"]) for r in own.select("key", "text").collect()]  # a block of text
        best = _block(docs, scratch, held, k) if held else None
        if best is not None:
            found = best if found is None else found.unionByName(best)
    kind = rows.schema["item_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    lists = found.groupBy("key").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("best"))  # k an item
    lists = scratch.stash(lists.join(texts.select("key", "times"), "key"))
    return heavy_split_join(rows.select("item_id", "key"), lists, ["key"], "times").select(
        "item_id", F.explode("best").alias("b")).select("item_id", "b.rank", "b.doc_id", "b.score")
