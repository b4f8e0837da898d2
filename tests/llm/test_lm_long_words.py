"""Scores of words of any length: proportional to their bytes, and the mixture in plain arithmetic."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import lm_score

from .test_edges import documents


def test_random_words_score_in_proportion_to_their_length(spark):
    rnd = random.Random(5)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    sizes = [200, 400, 4000, 40_000]
    rows = [(d, word(n)) for d, n in zip(held, sizes)]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(documents()) if t and len(t) < 5000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in lm_score.score_documents(df).filter(lm_score.F.col("doc_id").isin(held)).collect()}
    rates = [got[d]["score"] / n for d, n in zip(held, sizes)]
    assert all(got[d]["held_out"] for d in held) and got[held[3]]["score"] < 50 * got[held[0]]["score"]
    assert max(rates) - min(rates) < 0.1 * abs(rates[-1])
    assert all(abs(got[d]["bits_per_byte"] - -rates[k] / math.log10(2)) < 0.5 for k, d in enumerate(held))


def test_chunk_scores_mix_as_plain_probabilities():
    rnd = np.random.default_rng(3)
    cost = rnd.uniform(1, 40, 6)
    counts = {0: 5, 2: 1, 5: 9}
    numbers = np.array([0, 1, 2, 2, 3, 4, 5, 0])
    lengths = np.array([3, 5])
    right = pa.table({"piece": pa.array([0] * 3), "i": pa.array(list(counts)), "c": pa.array(list(counts.values()))})
    packed = lm_score.pack(numbers)
    row = pa.RecordBatch.from_pydict({
        "ids": [[1, 2]], "roles": [[0, 1]], "n_bytes": [[10, 20]], "lengths": [lengths.tolist()], "numbers": [packed],
        "cost": [cost[numbers].astype("<f8").tobytes()]})
    got = lm_score._chunk_scores(row, right, 100, 6).to_pylist()
    for k, (lo, hi) in enumerate([(0, 3), (3, 8)]):
        for s, share in enumerate(lm_score.SHARES):
            want = sum(math.log10((1 - share) * 2 ** -cost[w] + share * counts.get(w, 0) / 100) for w in numbers[lo:hi])
            assert abs(got[k]["scores"][s] - want) < 1e-9
