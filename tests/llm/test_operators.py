"""Each operator against a plain version on the smallest tables."""

import pytest

from quarry.llm import queries as Q

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return brute.rows(SF, "documents")


def test_op4_matches_brute_force(spark, docs):
    want = brute.decontaminate(docs, brute.rows(SF, "benchmark"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
           for r in Q.QUERIES["op4_decontaminate"](spark, SF).collect()}
    assert got == want
    assert any(x[4] for x in want.values())


def test_op5_matches_brute_force(spark, docs):
    fps = sorted((r["doc_id"], brute.simhash(r["text"])) for r in docs)
    want = brute.groups(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in Q.QUERIES["op5_simhash_near_dedup"](spark, SF).collect()}
    assert got == {d: (f"{fp:016x}", want[d]) for d, fp in fps}
    assert len(set(want.values())) < len(want)
