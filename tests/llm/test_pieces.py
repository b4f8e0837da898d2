"""The piece encoder: strings behind line breaks are shared, and its tables may turn at any time."""

import random

import pytest

from quarry.llm import piecewise
from quarry.llm.queries import tokenizer_path


@pytest.fixture
def own():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return piecewise.PieceEncoder(f.read())


class Counted:
    """A tokenizer that keeps the texts it was given."""

    def __init__(self, inner):
        self.inner, self.given = inner, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_words_at_line_breaks_are_encoded_once(own):
    own.encode(["x one two\none, two; one\ntwo one;"])
    own.tokenizer = Counted(own.tokenizer)
    text = "x two\none; two, one\ntwo; one\none, two"
    got = own.encode([text])
    assert own.tokenizer.given == ["x"]  # a text's first piece alone
    assert got == own.library([text])


def test_odd_pieces_have_the_ids_of_the_library(own, monkeypatch):
    draw = random.Random(7)
    parts = ["a", "don't", "é", "日本。", "x½", "5", ".", ",;", "!?", "\n", "\n\n", "\t", "\xa0", "　", "\x85", "\r\n", " ", " ", " ",
             "  ", "'s", "_", "&", "Ġ", "​", "z.\nb", "q\n.", "\n, w"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(4000)]
    for kept in (piecewise.KEPT, 50, 0):  # tables that never turn, often and always
        monkeypatch.setattr(piecewise, "KEPT", kept)
        for k in range(0, len(texts), 500):
            assert own.encode(texts[k:k + 500]) == own.library(texts[k:k + 500])
    assert own.encode([]) == [] and own.encode([""]) == [b""]


def test_without_ids_of_space_and_line_break_strings_go_alone(own):
    own.starts = own.line = None
    texts = ["a b, c\nd e.\nf", "g\n h", ""]
    assert own.encode(texts) == own.library(texts)
