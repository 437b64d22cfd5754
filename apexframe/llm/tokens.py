"""Token ids of whole text columns by public tokenizers, as Arrow tasks use them.

A tokenizer is slow and words repeat, so a column is cut into units (about a word each) at places where no token of any of
the tokenizers used here can reach across; each distinct unit of a batch is encoded once and remembered by the worker.
Units are cut before

* a single space between two solid characters (letters, digits, marks: no white space of any kind),
* a full stop or comma between an ASCII letter and a space or line break,
* a single line break between a solid character and an ASCII letter.

Byte-level and word BPE split their input there by pattern. A sentence-piece vocabulary is checked when it is loaded: it
may hold no piece that has a space, stop, comma or line break after another character.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import utf8_buffers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units that a worker remembers for a tokenizer (for each, where two are used together), and the longest of them in bytes:
#: about 100 MB.
MEMO_UNITS, PAIRED_UNITS, MEMO_BYTES = 500_000, 200_000, 48

#: Bits of a byte: plain solid ASCII; lead of a character of two, three, four bytes that is no white space (0xC2 and 0xE1 to
#: 0xE3 have some); later byte of a character; ASCII letter.
_PLAIN, _LEAD2, _LEAD3, _LEAD4, _LATER, _ALPHA = 1, 2, 4, 8, 16, 32
_BITS = np.zeros(256, np.uint8)
for _first, _past, _bit in ((0x21, 0x7F, _PLAIN), (0xC3, 0xE0, _LEAD2), (0xE4, 0xF0, _LEAD3), (0xF0, 0xF5, _LEAD4), (0x80, 0xC0, _LATER), (65, 91, _ALPHA), (97, 123, _ALPHA)):
    _BITS[_first:_past] |= _bit


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending byte positions where a unit begins, every non-empty text's first byte among them."""
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        bits = _BITS[data]
        solid = bits & _PLAIN  # the last byte of a solid character
        for k, lead in ((1, 1), (2, 2), (3, 3)):
            solid[k:] |= (bits[k:] >> 4) & (bits[:-k] >> lead) & 1
        here, after, solid, next_bits = data[1:-1], data[2:], solid[:-2].view(bool), bits[2:]
        inner = cut[1:-1]
        inner |= (here == 0x20) & solid & ((next_bits & 15) > 0)
        inner |= (here == 0x0A) & solid & (next_bits > 31)
        inner |= ((here == 0x2E) | (here == 0x2C)) & (bits[:-2] > 31) & ((after == 0x20) | (after == 0x0A))
    full = np.diff(offsets) > 0
    cut[offsets[1:][full] - 1] = False  # what follows a text's last byte is another text
    cut[offsets[:-1][full]] = True
    return np.flatnonzero(cut)


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every stretch, one stretch after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


class Memo:
    """Encodes columns of texts. encode: distinct units (bytes) to their ids, all below 65,536."""

    def __init__(self, encode: Callable[[list[bytes]], list[Sequence[int]]], limit: int = MEMO_UNITS):
        self.encode, self.limit, self.known = encode, limit, {}

    def ids_of_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, number of ids of each)."""
        known = self.known
        fresh = [u for u in units if u not in known]
        more = {}
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            more.update((u, np.asarray(x, np.uint16).tobytes()) for u, x in zip(part, self.encode(part), strict=True))
        found = [known[u] if u in known else more[u] for u in units]
        if len(known) < self.limit:
            known.update((u, x) for u, x in more.items() if len(u) <= MEMO_BYTES)
        return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, len(found)) // 2


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct units, the index of each unit's distinct one, and of every text the index of its first unit."""
    starts = unit_starts(data, offsets)
    bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))])
    coded = units.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64), np.searchsorted(starts, offsets)


def spread(codes: np.ndarray, first_unit: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id's index of every text and of the end) from those of distinct units."""
    lengths = counts[codes]
    out = ids[ragged(lengths, (np.cumsum(counts) - counts)[codes])]
    return out, np.concatenate(([0], np.cumsum(lengths)))[first_unit]


#: A unit that is one word of unaccented or Latin-1 letters, with the space or line break before it.
_WORD = re.compile(rb"[ \n]?((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)")


def _byte_alphabet() -> str:
    """Byte-level vocabularies write a printable byte as its own character, others as characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


def _encoder(tokenizer, folds: bool) -> Callable[[list[bytes]], list[Sequence[int]]]:
    """Encodes units; those that are one word go straight to the merges, as the tokenizer's patterns would leave them whole."""
    letters = dict(enumerate(_byte_alphabet()))

    def encode(units: list[bytes]) -> list[Sequence[int]]:
        out: list[Sequence[int]] = [()] * len(units)
        rest = []
        for i, u in enumerate(units):
            word = _WORD.fullmatch(u)
            if word and folds:
                word = word[1].decode().lower().encode()
            elif word:
                word = None if u[0] == 0x0A else u
            if word:
                out[i] = [t.id for t in tokenizer.model.tokenize(word.decode("latin-1").translate(letters))]
            else:
                rest.append(i)
        for i, x in zip(rest, tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    return encode


@lru_cache(maxsize=4)
def word_memo(path: str) -> Memo:
    """A lower-casing word BPE that drops white space and knows its special tokens by their strings."""
    from tokenizers import Tokenizer

    return Memo(_encoder(Tokenizer.from_file(path), folds=True))


def encode_column(column: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id's index of every text and of the end); null counts as empty."""
    data, offsets = utf8_buffers(column)
    units, codes, first = units_of(data, offsets)
    return spread(codes, first, *memo.ids_of_units(units))


# --- two tokenizers whose tokens stand for bytes ---------------------------------------------------------------------


@lru_cache(maxsize=4)
def byte_level(path: str) -> tuple[Memo, list[bytes]]:
    """A byte-level BPE that takes special tokens' strings as text, and the bytes of every id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    value = {c: b for b, c in enumerate(_byte_alphabet())}
    decoded = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))]
    return Memo(_encoder(tokenizer, folds=False), PAIRED_UNITS), decoded


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> tuple[Memo, list[bytes]]:
    """A sentence-piece BPE for units of a text that has a space before it, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    decoded = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    if any(re.search(r"[^▁]▁|[A-Za-z][.,]|.\n|\n.", p, re.DOTALL) for p in pieces):
        raise ValueError(f"{path}: pieces reach across the cuts of units")
    lead = model.encode("\n")  # the space that the model adds, and the line break

    def encode(units: list[bytes]) -> list[list[int]]:
        # the model adds the space of a unit that begins with one; others stand after a line break that is taken off again
        found = model.encode([u[1:].decode() if u[:1] == b" " else "\n" + u.decode() for u in units], num_threads=1)
        return [x if u[:1] == b" " else x[len(lead) :] for u, x in zip(units, found, strict=True)]

    return Memo(encode, PAIRED_UNITS), decoded
