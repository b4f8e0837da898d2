"""Ranked search, packing and phrase mining against plain versions: odd rows, ties, hot keys, any stretch length."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import collocations, lexical, packing, piecewise
from quarry.llm import queries as Q
from quarry.llm.common import Scratch

from . import brute
from .test_edges import documents, tables

SF = "/root/testdata/sf0.001"
TOKENIZER = Q.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("odd3"), documents())


# ---- ranked search

def terms(text):
    return brute.WORD.findall((text or "").translate(brute.AZ))


def plain_search(docs, items, k=10):
    bags = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for d, bag, n in bags:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                    for t in terms(text) if bag[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_op11_equals_scoring_everything(spark):
    got = Counter(tuple(r) for r in Q.QUERIES["op11_ranked_search"](spark, SF).collect())
    want = plain_search([(r["doc_id"], r["text"]) for r in brute.rows(SF, "documents")],
                        [(r["item_id"], r["text"]) for r in brute.rows(SF, "benchmark")])
    assert got == want and len(want) > 100


def test_op11_on_odd_rows(spark, odd):
    got = Counter(tuple(r) for r in Q.QUERIES["op11_ranked_search"](spark, odd).collect())
    want = plain_search(documents(), [(r["item_id"], r["text"]) for r in brute.rows(odd, "benchmark")])
    assert got == want  # two rows of item 1, a null item, a null text, one without terms


@pytest.mark.parametrize("stretch,block", [(8, 1 << 18), (64, 2000), (8192, 150)])
def test_op11_does_not_depend_on_stretches_or_blocks(spark, monkeypatch, stretch, block):
    rnd = random.Random(stretch)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(300)] + [(7, docs[7][1])] * 3  # a third are copies: ties at the cut
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 20)))) for i in range(40)] + [(99, docs[5][1])] * 2
    monkeypatch.setattr(lexical, "STRETCH", stretch)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    if block == 150:
        items = items[:4]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("times", F.lit(0))
    assert Counter(tuple(r) for r in lexical.search(d, q).collect()) == plain_search(docs, items)


def test_op11_prunes(spark):
    """Far from every pair of an item and a document is scored once kth scores are known."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"t{x}" for x in rnd.zipf(1.3, 12) % 5000) for _ in range(60)]
    items = lexical.Items(texts)
    weights = np.array([lexical.weight(2048, 1 + k % 700) for k in range(len(items.vocab))], np.int64)
    root = lexical.item_tree(items, weights)
    cells = sorted({(d, t) for d in range(2048) for t in rnd.integers(0, len(weights), 6)})
    doc, term = np.array(cells).T
    scored = Counter()

    class Counting(lexical.Best):
        def add(self, item, scores, *rest):
            scored[item] += len(scores)
            super().add(item, scores, *rest)

    args = (np.arange(2048), np.zeros(2048, bool), doc, term, np.full(len(doc), 5e5), weights)
    first = Counting(60, 3, np.zeros(60, np.int64))
    lexical.Stretch(*args).search(root, first)
    floor = np.array([s[-1] if len(s) == 3 else 0 for s in first.scores])
    scored.clear()
    second = Counting(60, 3, floor)
    lexical.Stretch(*args).search(root, second)
    assert [x.tolist() for x in first.scores] == [x.tolist() for x in second.scores]
    assert sum(scored.values()) < 0.5 * 60 * 2048


def test_op11_leaves_no_document_in_the_trees_out():
    n = 77
    weights = np.array([3, 5], np.int64)
    items = lexical.Items(["a b b"])
    s = lexical.Stretch(np.arange(n), np.zeros(n, bool), np.arange(n), np.arange(n) % 2, np.full(n, 7.0), weights)
    best = lexical.Best(1, n, np.zeros(1, np.int64))
    s.search(lexical.item_tree(items, weights), best)
    assert sorted(best.ids[0].tolist()) == list(range(n))
    assert best.scores[0].tolist() == [70] * (n // 2) + [21] * (n - n // 2)


# ---- packing

def check_packing(rows, docs, capacity=2048):
    """``rows``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    tok = Tokenizer.from_file(TOKENIZER)
    tok.no_truncation()
    tok.no_padding()
    want = Counter()
    for d, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        if edges[-1] != len(ids):
            edges.append(len(ids))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r[5]].append((r[6], r[3]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def decreasing(lengths, capacity=2048):
    p = packing.Packer(capacity, 10**9)
    p.add_all([(0, 0, 0, n, b"") for n in lengths])
    return len(p.done()) + len(p.rest())


@pytest.mark.parametrize("name", ["small", "odd"])
def test_op12_packs_every_id_once(spark, odd, name):
    folder = SF if name == "small" else odd
    rows = [tuple(r) for r in Q.QUERIES["op12_best_fit_packing"](spark, folder).collect()]
    bins = check_packing(rows, [(r["doc_id"], r["text"]) for r in brute.rows(folder, "documents")])
    assert len(bins) <= decreasing([r[3] for r in rows]) + 1


def test_op12_small_splits_cost_few_sequences(spark):
    docs = [(r["doc_id"], r["text"]) for r in brute.rows(SF, "documents")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(24).withColumn("ids", F.lit(1)).withColumn("offset", F.lit("x"))
    packed = packing.pack_documents(df, TOKENIZER)
    rows = [tuple(r) for r in packed.select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset").collect()]
    bins = check_packing(rows, docs)
    assert len(bins) <= 1.02 * decreasing([r[3] for r in rows]) + 2


def test_packer_bounds_its_open_bins():
    rnd = random.Random(1)
    p = packing.Packer(100, 7)
    sizes = [rnd.randint(1, 100) for _ in range(2000)]
    closed, most = [], 0
    for k, n in enumerate(sizes):
        before = [(space, number) for space, number, _ in p.rest()]
        p.add((k, 0, 0, n, b""))
        gone = {n for n, _ in p.closed}
        for number in gone & {x for _, x in before}:  # full now, or the fullest of all
            space = next(s for s, x in before if x == number)
            assert space == n or space == min(s for s, _ in before)
        closed += p.done()
        most = max(most, p.open)
        assert p.open == len(p.rest()) and p.free == sum(1 << s for s in {s for s, *_ in p.rest()})
    held = [x for _, own in closed + [(n, own) for _, n, own in p.rest()] for x in own]
    assert most == 7 and sorted(x[0] for x in held) == list(range(2000))
    assert all(sum(x[3] for x in own) <= 100 for _, own in closed)


def test_packer_takes_the_best_fit():
    p = packing.Packer(10, 4)
    for n in (7, 5, 6):
        p.add((n, 0, 0, n, b""))
    p.add((3, 0, 0, 3, b""))
    assert [[x[0] for x in own] for _, own in p.done()] == [[7, 3]]
    p.add((4, 0, 0, 4, b""))
    assert [[x[0] for x in own] for _, own in p.done()] == [[6, 4]]


def test_pieces_have_the_ids_of_the_library():
    texts = [r["text"] for r in brute.rows("/root/testdata/sf0.01", "documents")] + [t for _, t in documents()]
    texts += ["", "a  b   c \n d\x1ce\x85f", "x\ny z\n\nq", "<|endoftext|> in text", "don't.\nHe's it's. (a). b!? c\t\nd e\n\tf g.\n.h 3.14, 5.",
              " lead", "trail ", "a\xa0b .", "日本。 語! ²; x½. y", "\n", " ", "a. .\nb ..\n", "'s. 're, we'll; 5's. a'.", "​. x́. ý,"]
    with open(TOKENIZER, encoding="utf-8") as f:
        own = piecewise.PieceEncoder(f.read())
    texts = [t or "" for t in texts]
    for again in range(2):
        assert own.encode(texts) == own.library(texts)
        own.strings.old, own.strings.young = own.strings.young, {}


# ---- phrases

def plain_phrases(docs, min_count, longest=5):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(brute.AZ)):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for n in range(1, longest + 1):
                for i in range(len(ws) - n + 1):
                    counts[lang, tuple(ws[i:i + n])] += 1
    return total, {k: c for k, c in counts.items() if c >= min_count}


def plain_collocations(docs, min_count, top=2000, longest=5):
    total, f = plain_phrases(docs, min_count, longest)
    longer = defaultdict(int)
    for (lang, ws), a in f.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                longer[lang, ws[i:i + m]] = max(longer[lang, ws[i:i + m]], a)
    out = defaultdict(list)
    for (lang, ws), a in f.items():
        if len(ws) > 1 and longer[lang, ws] < a:
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]])
                                 for k in range(1, len(ws)))
            out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return Counter((lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
                   for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def test_op13_matches_plain_counts(spark):
    rows = [(r["lang"], r["text"]) for r in brute.rows("/root/testdata/sf0.01", "documents")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for minimum in (100, 12):
        got = Counter(tuple(r) for r in collocations.collocations(df, min_count=minimum).collect())
        want = plain_collocations(rows, minimum)
        assert got == want and len(want) > 20


def test_op13_on_odd_rows(spark, odd):
    rnd = random.Random(4)
    words = ["new", "york", "city", "Ünï", "a", "İ", "ΣΑΣ", "x\x00y", "of", "w" * 70_000]
    say = lambda n: "".join(rnd.choice(words[:9]) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \t "]) for _ in range(n))
    rows = [(rnd.choice(["en", None, "und", ""]), say(rnd.randint(0, 40))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, " .,\n"), ("fr", words[9] + " x"), ("en", " ".join(["of the"] * 5000)), ("en", "of the end of the")]
    rows += [("en", "New York City")] * 200
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    df = df.withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("part", F.lit(2)).withColumn("words", F.lit(3))
    got = Counter(tuple(r) for r in collocations.collocations(df, min_count=20, top=30).collect())
    assert got == plain_collocations(rows, 20, 30)
    assert Q.QUERIES["op13_collocations"](spark, odd).count() > 0


@pytest.mark.parametrize("stretch", [50, 999])
def test_op13_does_not_depend_on_stretches(spark, monkeypatch, stretch):
    """Long texts with few marks are cut between words; phrases over a cut count once."""
    rnd = random.Random(stretch)
    text = " ".join(rnd.choice(["a", "bb", "ccc", "dd.", "e", "f\t"]) for _ in range(3000))
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    batches = [pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": [text, text[:500]]})]
    total, f = plain_phrases([("en", text), ("de", text[:500])], 1)
    got = Counter()
    everything = [collocations.Bitmap(1, 3, np.full(1, 255, np.uint8))] * 5
    for s in collocations.stretches(batches):
        for n, at, _ in s.grams(everything, 5):
            for i in at.tolist():
                got[s.langs[s.text[i]], tuple(s.phrase(i, n).split(" "))] += 1
    assert got == f


def test_misra_gries_loses_no_frequent_key():
    rnd = np.random.default_rng(2)
    threshold = 50
    keys = np.concatenate([rnd.integers(0, 20_000, 60_000), np.repeat(np.arange(100), 60)]).astype(np.uint32)
    rnd.shuffle(keys)
    own = collocations.Summary(len(keys) // threshold + 1)
    for part in np.array_split(keys, 40):
        k, c = np.unique(part, return_counts=True)
        own.add(k, c)
        own.merge()
        assert len(own.keys) <= own.capacity
    assert own.taken < threshold
    k, c = np.unique(keys, return_counts=True)
    assert set(k[c >= threshold].tolist()) <= set(own.survivors(threshold).tolist())
    assert len(own.survivors(threshold)) < len(k) / 4


def test_op13_second_pass_is_exact_when_all_hashes_meet(spark, monkeypatch):
    """Eight bits for all phrases: every lookup is a collision, the counts stay right."""
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rows = [(r["lang"], r["text"]) for r in brute.rows(SF, "documents")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    with Scratch(spark) as scratch:
        got = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in
               collocations.frequent_phrases(df, scratch, 20).filter("words > 0").collect()}
    assert got == plain_phrases(rows, 20)[1]
