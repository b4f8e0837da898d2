"""Words of UTF-8 text as bytes (small helpers used inside Python workers)."""

from __future__ import annotations

from collections.abc import Iterator

# Word bytes of the decontamination contract are 0-9, A-Z (lower-cased), a-z and
# every byte from 0x80 up; all others separate words.
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(
    b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Texts are handled in pieces of about this many bytes, so a text of any length needs little memory.
PIECE = 1 << 22


def folded(text: bytes) -> bytes:
    """Same length as ``text``: lower-cased word bytes, and a space for every other byte."""
    return text.translate(_TABLE)


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Cut at spaces into pieces of about ``size`` bytes; no word is cut."""
    at = 0
    while len(data) - at > size:
        cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def alnum_words(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    for piece in pieces(folded(text)):
        yield piece.split()


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (``bytes`` methods touch ASCII only)."""
    return text.lower().split()
