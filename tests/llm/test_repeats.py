"""Repeated queries and benchmark items are looked up once: no block grows with the repeats."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import decontaminate, topk


def test_equal_queries_fill_no_block(spark, monkeypatch):
    sizes = []
    real = topk._block_top

    def seen(table, rows, k, largest):
        sizes.append(len(rows))
        return real(table, rows, k, largest)
    monkeypatch.setattr(topk, "_block_top", seen)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 16)
    rnd = random.Random(1)
    rows = [(50 * i, [rnd.random(), rnd.random()]) for i in range(40)] + [(50, [0.5, 0.25])] * 3000 + [(1, [1.0, 1.0]), (2, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.pmod(F.col("id"), F.lit(50)) == 0, k=2).groupBy("query_id", "rank").count().collect()
    assert max(sizes) <= 16 and sum(sizes) == 41
    n = Counter({(r["query_id"], r["rank"]): r["count"] for r in got})
    assert n[50, 1] == 3001 and n[50, 2] == 3001 and n[100, 1] == 1


def test_equal_items_fill_no_block(spark, monkeypatch):
    sizes = []
    real = decontaminate._pass

    def seen(docs, index, *rest):
        sizes.append(sum(len(hashes) for _, hashes, _, _ in index.by_length.values()))  # two windows an item
        return real(docs, index, *rest)
    monkeypatch.setattr(decontaminate, "_pass", seen)
    monkeypatch.setattr(decontaminate, "BLOCK_SEGMENTS", 8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[i * 13:i * 13 + 14])) for i in range(12)] + [(3, " ".join(words[39:53]))] * 2000
    docs = spark.createDataFrame([(1, " ".join(words[39:60])), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], sorted(r["hit_items"])) for r in decontaminate.scan(docs, bench).collect()}
    assert got[2] == (2, []) and "3" in got[1][1] and sum(sizes) == 24 and max(sizes) <= 16


def test_toxicity_takes_columns_named_like_its_own(spark):
    from quarry.llm import toxicity
    rnd = random.Random(4)
    say = lambda *more: " ".join(rnd.choices(["the", "of", "and", "tree", "house", "river"], k=20) + list(more))
    rows = [(i, say("vilething") if i % 3 == 0 else say()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, label int")
    plain = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    odd = docs.withColumns({c: F.lit("x") for c in ("y", "__id", "label", "term", "toxic", "score", "n_matches")})
    assert {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, labels).collect()} == plain
    assert min(plain[i] for i in range(0, 300, 3)) > max(plain[i] for i in range(300) if i % 3)
