"""What op6 holds: no part has all followers of a frequent word, and tables are mapped piece by piece."""

import random
import zlib
from collections import Counter

import numpy as np

from quarry.llm import lm_score
from quarry.llm.common import Scratch


def _rows(n):
    rnd = random.Random(3)
    return [(k, " ".join(f"the {''.join(rnd.choice('abcdef') for _ in range(rnd.randrange(1, 8)))}" for _ in range(40))) for k in range(n)]


def test_followers_of_a_frequent_word_are_dealt_to_several_parts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "OFTEN", 400)
    rows, want = _rows(120), Counter()
    for k, text in rows:
        crc = zlib.crc32(str(k).encode())
        role = 0 if crc % 7 == 2 else 2 if crc // 7 % lm_score.MIX_SHARE == 0 else 1
        ws = text.encode().split()
        for b, w in zip([b"", *ws], [*ws, b""]):
            if b == b"the" and role:
                want[w[:lm_score.HEAD], role] += 1
    with Scratch(spark) as scratch:
        chunks = scratch.stash(lm_score.chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 2, 7))
        dealt = lm_score.layout(lm_score.word_counts(chunks), 2)
        parts = scratch.stash(lm_score.triples(chunks, dealt))
        found = lm_score.heads(parts, dealt)
        batch = parts.toArrow().combine_chunks().to_batches()[0]
        sizes, seen = {}, []
        for row in range(batch.num_rows):
            words, before, mark, word, first, others = lm_score._part(batch, row)
            sizes[batch["part"][row].as_py()] = len(word)
            seen += [(words[b], int(m), words[w]) for b, m, w in zip(before, mark, word)]
    lo, n = dealt.split[b"the"]
    own = [sizes.get(p, 0) for p in range(lo, lo + n)]
    assert n > 4 and len(seen) == len(set(seen)) and sum(own) == sum(b == b"the" for b, _, _ in seen) and max(own) < 0.5 * sum(own)
    begins, first, others = lm_score._head(found, lo, dealt, b"the")
    assert begins == sorted(begins)
    got = {(b, role): int(c) for role, cs in ((1, first), (2, others)) for b, c in zip(begins, cs) if c}
    assert got == dict(want)


def test_scores_with_a_dealt_out_word_and_tables_in_pieces_are_as_without(spark, monkeypatch):
    docs = spark.createDataFrame(_rows(150), "doc_id long, text string").repartition(2)
    score = lambda: {r["doc_id"]: (r["score"], r["base_score"]) for r in lm_score.score_documents(docs).collect()}
    whole = score()
    monkeypatch.setattr(lm_score, "PIECE_BITS", 9)
    assert score() == whole
    monkeypatch.setattr(lm_score, "OFTEN", 400)
    dealt = score()
    # the last predictor's counts are hashed by part, and each part learns weights of its own: no more may differ
    assert all(dealt[k][1] == whole[k][1] and abs(dealt[k][0] / whole[k][0] - 1) < 0.05 for k in whole)


def test_counts_of_a_part_and_the_heads_are_those_of_all_followers():
    rnd = random.Random(8)
    every = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 6))).encode() for _ in range(200)})
    times = np.array([rnd.randrange(1, 9) for _ in every])
    model = lm_score.BitModel(lm_score.ByteCode(np.ones(256, np.int64)), [])
    run = lambda ws: [(slice(0, len(ws)), ws, np.zeros(len(ws), np.int64), np.full(len(ws), 5, np.uint64), np.full((len(ws), 3), 97))]
    head = Counter()
    for w, n in zip(every, times):
        head[w[:lm_score.HEAD]] += int(n)
    begins = sorted(head)
    mine = [k for k, w in enumerate(every) if zlib.crc32(w[:lm_score.HEAD]) % 3 == 0]
    kept = [every[k] for k in mine]
    last, _ = model.counted(run(kept), times[mine], (begins, np.array([head[b] for b in begins])))
    own = lm_score.Spelling(*run(every)[0][1:])
    often, wanted, slots = own.often(times), Counter(), len(last) // 2
    part = lm_score.Spelling(*run(kept)[0][1:])
    needed = set(part.contexts[-1].tolist()) | set(own.contexts[-1][own.place < lm_score.HEAD].tolist())
    for _, _, which, _, bit, wide in model.blocks(own):
        for s, b, w in zip(which, bit, wide):
            if int(own.contexts[-1][s]) in needed:
                wanted[2 * (int(w) & (slots - 1)) + int(b)] += int(often[s])
    assert {k: int(n) for k, n in enumerate(last) if n} == dict(wanted)
