"""Token ids of many texts by the tokenizers library, each distinct piece of text encoded once.

The byte-level pattern never joins what stands before a lone space with what follows it, so the ids of a
text are those of its pieces, one after the other.  A trailing run of ``. , ; : ! ?`` behind an ASCII letter or
digit, and a lone line break between visible characters, part a piece once more.  Arrow parts and numbers the
pieces.  A worker remembers the strings it has met; only new ones go to the library, many to a text.

Texts in which a space meets other white space, or that hold special tokens, are encoded whole.
"""

from __future__ import annotations

import os
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries of the younger of the memory's two tables; a full one becomes the older one.
KEPT = 500_000
#: Strings in one text, and texts in one call of the library.
JOINED = 32
CALL = 1_000
# White space as the tokenizer's pattern sees it, without the space itself.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
# Marks that the pattern always parts from the letter or digit before them.
MARKS = ".,;:!?"
#: A space beside other white space; visible characters behind a space or none; lines of them.
_SPACED = f" [ {_SPACES}]|[{_SPACES}] "
_VISIBLE = f"^ ?[^ {_SPACES}]+$"
_LINES = f"^[^ {_SPACES}]+(\n[^ {_SPACES}]+)+$"
# Fixed value: the character that stands for a space in byte-level vocabularies.
SPACE = "Ġ"
_STRING = pa.large_string()


class Table:
    """Strings and their ids."""

    def __init__(self):
        self.strings = pa.array([], _STRING)
        self.ids, self.lengths = np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.strings)

    def places(self, keys: pa.LargeStringArray) -> np.ndarray:
        """The place of each key, -1 where it isn't held."""
        if not len(self):
            return np.full(len(keys), -1)
        return pc.index_in(keys, self.strings).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, strings: pa.LargeStringArray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.strings = pa.concat_arrays([self.strings, strings])
        self.ids = np.concatenate([self.ids, ids]) if len(self.ids) else ids
        self.lengths = np.concatenate([self.lengths, lengths])


class Memory:
    """Strings and their ids in two tables, so that what is met again and again stays.

    A string that follows a space is held without it; one that doesn't has a space put before it, for none
    holds a space."""

    def __init__(self):
        self.young, self.old = Table(), Table()

    def turn(self) -> Table:
        """The younger table; a full one becomes the older one before."""
        if not len(self.young):
            self.young = Table()
        if len(self.young) > KEPT:
            self.old, self.young = self.young, Table()
        return self.young


class PieceEncoder:
    """One tokenizer with a bounded memory of the strings that pieces are made of."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.strings = Memory()
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None  # the id of a line break
        self.lines = np.arange(self.size) == self.line
        # ids that begin with a space, where the vocabulary writes it as byte-level ones do
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens
        self.starts = np.zeros(self.size, bool) if space == [SPACE] else None
        if self.starts is not None:
            self.starts[[i for name, i in self.tokenizer.get_vocab().items() if name[0] == SPACE]] = True

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        out: list[bytes] = []
        for k in range(0, len(texts), CALL):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k:k + CALL], add_special_tokens=False)]
            ends = [0, *accumulate(self.kind.itemsize * len(x) for x in ids)]
            flat = np.fromiter(chain.from_iterable(ids), self.kind, ends[-1] // self.kind.itemsize).tobytes()
            out += [flat[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def _new(self, keys: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray, np.ndarray]:
        """(the keys anew ordered, their ids, how many each has, the order); see ``Memory``."""
        visible = pc.match_substring_regex(keys, _VISIBLE).to_numpy(zero_copy_only=False)
        close = pc.starts_with(keys, " ").to_numpy(zero_copy_only=False)  # no space before them in the text
        behind = visible & ~close if self.starts is not None else np.zeros(len(keys), bool)
        alone = visible & close if self.line is not None else np.zeros(len(keys), bool)
        order = [np.flatnonzero(x) for x in (behind, alone, ~behind & ~alone)]
        own = [keys.take(pa.array(x)) for x in order]
        coded = [self._joined(_strings_of(own[0]), " ", self.starts),
                 self._joined([k[1:] for k in own[1].to_pylist()], "\n", self.lines),
                 self._flat(self.library([k[1:] if k[:1] == " " else " " + k for k in own[2].to_pylist()]))]
        return (pa.concat_arrays(own), *(np.concatenate(x) for x in zip(*coded)), np.concatenate(order))

    def _joined(self, strings: list[str], gap: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of strings of visible characters, how many each has), many to a text; ``gap`` stands before each.

        Of each string's ids only the first, or the gap's own, is one of ``starts``."""
        ids = []
        for lo in range(0, len(strings), JOINED * CALL):
            part = strings[lo:lo + JOINED * CALL]
            texts = [gap + gap.join(part[k:k + JOINED]) for k in range(0, len(part), JOINED)]
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), self.kind, sum(map(len, ids)))
        first = np.flatnonzero(starts[flat]) if len(flat) else np.zeros(0, np.int64)
        if len(first) != len(strings):
            raise ValueError("the tokenizer joins words")
        lengths = np.diff(np.append(first, len(flat)))
        if gap != " ":
            return flat[~starts[flat]], lengths - 1
        return flat, lengths

    def _places(self, keys: pa.LargeStringArray) -> np.ndarray:
        """The place of each key in the younger table, in which all of them are afterwards; keys are distinct."""
        young, old = self.strings.young, self.strings.old
        at = young.places(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing) and len(old):
            there = old.places(keys.take(pa.array(missing)))
            met = missing[there >= 0]
            there = there[there >= 0]
            at[met] = len(young) + np.arange(len(met))
            young.add(keys.take(pa.array(met)), _gathered(old.ids, old.lengths, there)[0], old.lengths[there])
            missing = np.flatnonzero(at < 0)
        if len(missing):
            strings, ids, lengths, order = self._new(keys.take(pa.array(missing)))
            at[missing[order]] = len(young) + np.arange(len(missing))
            young.add(strings, ids, lengths)
        return at

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the pieces, each with a space before it, in another order; how many each has; each piece's place)."""
        young = self.strings.turn()
        broken = pc.match_substring_regex(pieces, _LINES).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(~broken), np.flatnonzero(broken)])
        single = pieces.filter(pa.array(~broken))
        split = pc.split_pattern(pieces.filter(pa.array(broken)), "\n")
        lines = pa.concat_arrays([single, split.flatten()])
        upto = np.concatenate([np.arange(1, len(single) + 1), len(single) + split.offsets.to_numpy()[1:]])  # a piece's lines
        first = np.zeros(len(lines), bool)
        first[np.concatenate([[0], upto[:-1]])] = True
        core = pc.utf8_rtrim(lines, MARKS)
        marked = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(lines)),
                         pc.match_substring_regex(core, "[0-9A-Za-z]$"))
        marked = pc.and_not(marked, pc.match_substring(lines, "\n"))
        core = pc.if_else(marked, core, lines)
        core = pc.if_else(pa.array(first), core, _close(core))
        marks = _close(pc.replace_substring_regex(lines.filter(marked), f"(?s)^.*[^{MARKS}]", ""))
        parts = pa.concat_arrays([core, marks, pa.array([" \n"], _STRING)]).dictionary_encode()
        code = self._places(parts.dictionary)[parts.indices.to_numpy()]
        # a line's parts: the break before it, itself, its marks
        marked = marked.to_numpy(zero_copy_only=False)
        end = np.cumsum(1 + marked + ~first)
        which = np.empty(end[-1], np.int64)
        which[end[marked] - 1] = code[len(core):-1]
        which[end - 1 - marked] = code[:len(core)]
        which[(end - 2 - marked)[~first]] = code[-1]
        ids, ends = _gathered(young.ids, young.lengths, which)
        place = np.empty(len(pieces), np.int64)
        place[order] = np.arange(len(pieces))
        return ids, np.diff(ends[end[upto - 1] - 1], prepend=0), place

    def _flat(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each has)."""
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // self.kind.itemsize
        return np.frombuffer(b"".join(coded), self.kind), lengths

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as ``kind``.

        Arrow numbers the distinct pieces; the ids of all texts are gathered by these numbers."""
        values = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(values, _SPACED)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(values, x))
        whole = odd.to_pylist()
        split = pc.split_pattern(pc.if_else(odd, "", values), " ")
        starts = split.offsets.to_numpy()
        flat = split.values.dictionary_encode()
        # a text's first piece has no space before it; a whole text is that one piece
        firsts = self._flat(self.library([t if w or (e := t.find(" ")) < 0 else t[:e] for t, w in zip(texts, whole)]))
        coded = firsts
        if len(flat.dictionary):
            held, lengths, place = self._pieces(flat.dictionary)
            coded = np.concatenate([held, firsts[0]]), np.concatenate([lengths, firsts[1]])
            which = place[flat.indices.to_numpy()]
        else:
            which = np.zeros(0, np.int64)
        which[starts[:-1]] = len(flat.dictionary) + np.arange(len(texts))
        ids, ends = _gathered(*coded, which)
        raw = ids.tobytes()
        edges = (np.concatenate([[0], ends])[starts] * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:])]


def _strings_of(values: pa.LargeStringArray) -> list[str]:
    """The values, of which none holds a space; they come over as one string."""
    if not len(values):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


def _close(values: pa.LargeStringArray) -> pa.LargeStringArray:
    """The values as keys of strings that no space stands before."""
    return pc.binary_join_element_wise(pa.scalar("", _STRING), values, pa.scalar(" ", _STRING))


def _gathered(held: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the entries ``which`` one after the other, where each of them ends); an entry has ``lengths`` ids."""
    begins = np.cumsum(lengths) - lengths
    size = lengths[which]
    ends = np.cumsum(size)
    at = np.repeat((begins[which] - (ends - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return held[at], ends


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(spec: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file, built once."""
    if spec not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec] = PieceEncoder(spec)
    return _ENCODERS[spec]
