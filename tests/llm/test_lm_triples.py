"""Triples (word before, script mark, word) are counted once for the whole table; steps are shared by common beginnings."""

import random
import zlib
from collections import Counter

import numpy as np

from quarry.llm import lm_score
from quarry.llm.common import Scratch


def test_triples_are_added_up_over_chunks_and_the_last_predictor_sends_no_counts(spark):
    rnd = random.Random(7)
    words = ["the", "cat", "café", "naïve", "a", "sat", "Я", "on", "the\x00x", "мат"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 30)))) for k in range(120)]
    want = {1: Counter(), 2: Counter()}
    for k, text in rows:
        crc = zlib.crc32(str(k).encode())
        role = 0 if crc % 7 == 2 else 2 if crc // 7 % lm_score.MIX_SHARE == 0 else 1
        before, mark = b"", 0
        for w in [*text.encode().split(), b""]:
            if role:
                want[role][before, mark, w.lower()] += 1
            before, mark = w.lower(), lm_score.script_mark(w.lower()) or mark
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with Scratch(spark) as scratch:
        chunks = scratch.stash(lm_score.chunks(table, 2, 7))
        parts = scratch.stash(lm_score.triples(chunks, 4))
        batch = parts.toArrow().combine_chunks().to_batches()[0]
        got, tables = {1: Counter(), 2: Counter()}, []
        for row in range(batch.num_rows):
            own, before, mark, word, first, others = lm_score._part(batch, row)
            tables += [(own[b], int(m), own[w]) for b, m, w in zip(before, mark, word)]
            for role, n in ((1, first), (2, others)):
                got[role].update({t: int(c) for t, c in zip(tables[-len(word):], n) if c})
        model = lm_score.fit(chunks, None, parts)
    assert len(tables) == len(set(tables)) and got == want
    assert len(model.bits) == lm_score.N - 1


def test_steps_are_the_distinct_beginnings_after_a_word_before():
    rnd = np.random.default_rng(4)
    words = sorted(bytes(rnd.choice([97, 98, 99], rnd.integers(0, 7)).astype(np.uint8)) for _ in range(300))
    before = np.repeat(np.arange(3, dtype=np.uint64), 100)
    words = [w for k in range(3) for w in sorted(words[k::3])]
    own = lm_score.Spelling(words, np.zeros(300, np.int64), before, np.full((300, 3), 300))
    begins = [(int(b), (w + b" ")[:j + 1]) for b, w in zip(before, words) for j in range(len(w) + 1)]
    step_of = dict(zip(begins, own.step.tolist()))
    assert [step_of[b] for b in begins] == own.step.tolist() and len(set(own.step.tolist())) == len(set(begins)) == len(own.data)
    assert all(own.data[s] == b[1][-1] and own.place[s] == len(b[1]) - 1 for b, s in step_of.items())
