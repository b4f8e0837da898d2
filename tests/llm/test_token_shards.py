"""Token files: pairs are found without counting all of them, encoded pieces are shared by many texts."""

from collections import Counter

import numpy as np
import pytest

from quarry.llm import token_files


def plain_pairs(key: np.ndarray, take: int) -> list[tuple[int, int]]:
    """The most frequent keys that occur twice at least, and how often; ties to the smaller."""
    n = Counter(key[key != token_files._NO_PAIR].tolist())
    held = sorted((-c, k) for k, c in n.items() if c >= token_files.MIN_COUNT)[:take]
    return sorted((k, -c) for c, k in held)


@pytest.mark.parametrize("guess", [0, 3, 10, 10**6])
@pytest.mark.parametrize("kinds", [1, 7, 300, 1 << 20])
def test_the_most_frequent_pairs(guess, kinds):
    draw = np.random.default_rng(kinds)
    for size in (0, 1, 2, 500, 20_000):
        key = (draw.zipf(1.2, size) % kinds).astype(np.uint32) * np.uint32(4093)
        key[::9] = token_files._NO_PAIR
        for take in (1, 5, 1024):
            pair, least = token_files._frequent(key, take, guess)
            want = plain_pairs(key, take)
            assert pair.tolist() == [k for k, _ in want]
            assert all(c >= least for _, c in want)


def test_matches_of_pairs_whose_hashes_meet():
    """More pairs than a hash keeps apart at the first try are all found, where they are and nowhere else."""
    draw = np.random.default_rng(3)
    pair = np.unique(draw.integers(0, 1 << 32, token_files.PAIRS).astype(np.uint32))
    key = np.concatenate([draw.choice(pair, 5000), draw.integers(0, 1 << 32, 50_000).astype(np.uint32)])
    draw.shuffle(key)
    at, no = token_files._matches(key, pair)
    assert at.tolist() == np.flatnonzero(np.isin(key, pair)).tolist()
    assert (pair[no] == key[at]).all()


def test_texts_are_gathered_into_few_calls_of_the_encoder(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "TEXT", 40)
    texts = ["a" * 15, None, "b" * 30, "c" * 100, "", "d"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": pa.array([t], pa.string())}) for k, t in enumerate(texts)]
    got = list(token_files._stretches(iter(batches)))
    assert [d for ids, _ in got for d in ids] == list(range(6))
    assert [t for _, own in got for t in own] == [t or "" for t in texts]
    assert [len(ids) for ids, _ in got] == [3, 1, 2]
