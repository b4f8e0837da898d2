"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

import pyarrow.parquet as pq
import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(sf: str, table: str) -> list[dict]:
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


def decontaminate(docs, bench, n=13):
    windows = {}
    for r in bench:
        words = WORD.findall((r["text"] or "").translate(AZ))
        for i in range(max(1, len(words) - n + 1) if words else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add("" if r["item_id"] is None else str(r["item_id"]))
    lengths = {len(w) for w in windows}
    out = {}
    for r in docs:
        words = WORD.findall((r["text"] or "").translate(AZ))
        hit, items = [False] * len(words), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if found := windows.get(tuple(words[i:i + m])):
                    items |= found
                    hit[i:i + m] = [True] * m
        k = sum(hit)
        out[r["doc_id"]] = (len(words), k, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                            k > 0 and 20 * k >= len(words))
    return out


def simhash(text, shingle=3):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(AZ))
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius=3):
    """fps: [(doc_id, fp)] -> {doc_id: smallest id reachable}."""
    ids, root = [d for d, _ in fps], {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}
