"""Words of whole Arrow text columns, found and hashed with array operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U64 = np.uint64
# Odd multipliers: between steps of a hash, and two within ``mix``.
_BASE = _U64(0x9E3779B97F4A7C15)
_MIX_A = _U64(0xBF58476D1CE4E5B9)
_MIX_B = _U64(0x94D049BB133111EB)
# Bytes of text handled at once, and words hashed at once. Texts longer than a piece make
# a piece of their own.
PIECE_BYTES = 1 << 20
HASH_WORDS = 1 << 14
# The first 0 to 8 of eight bytes read as one little-endian number.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Separators of the two kinds of words: blanks only, or all ASCII but letters and digits.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, *range(9, 14)]] = True
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


@dataclass
class Piece:
    """Neighbouring texts of a column: ``bytes`` in lower case, and where words lie.

    ``first`` is the row number of the first text, ``offsets`` bound the texts in
    ``bytes``, ``starts`` and ``ends`` bound the words, ``text`` is the text each is in.
    """

    first: int
    bytes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.bytes, self.starts, self.ends)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null reads as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), offsets
    return np.frombuffer(data, dtype=np.uint8), offsets


def ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def pieces(column: pa.Array, separators: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    data, offsets = text_buffers(column)
    for row, end in ranges(offsets, limit):
        own = offsets[row : end + 1] - offsets[row]
        text = LOWER[data[offsets[row] : offsets[end]]]
        inside = ~separators[text]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[own[:-1][own[:-1] < len(text)]] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[own[1:][own[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        of = np.repeat(np.arange(end - row), np.diff(np.searchsorted(starts, own)))
        yield Piece(row, text, own, starts, ends, of)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result; one to one."""
    values = (values ^ (values >> _U64(30))) * _MIX_A
    values = (values ^ (values >> _U64(27))) * _MIX_B
    return values ^ (values >> _U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, taking in eight bytes at a time and then the length."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.empty(len(starts), dtype=_U64)
    for at in range(0, len(starts), HASH_WORDS):
        place, left = starts[at : at + HASH_WORDS], ends[at : at + HASH_WORDS]
        left = left - place
        value = mix(eights[place] & _MASKS[np.minimum(left, 8)])
        length, rest = left.astype(_U64), np.flatnonzero(left > 8)
        while len(rest):
            place, left = place + 8, left - 8
            taken = eights[place[rest]] & _MASKS[np.minimum(left[rest], 8)]
            value[rest] = mix(value[rest] * _BASE + taken)
            rest = rest[left[rest] > 8]
        out[at : at + HASH_WORDS] = mix(value + length * _BASE)
    return out


class Lookup:
    """Row numbers of 64-bit keys in a fixed set; -1 for keys that are not in it."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(16, int(len(keys)).bit_length() + 4)
        self.shift = _U64(64 - bits)
        self.present = np.zeros(1 << bits, dtype=bool)
        self.present[(mix(self.keys) >> self.shift).astype(np.int64)] = True

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.present[(mix(wanted) >> self.shift).astype(np.int64)])
        sought = wanted[maybe]
        at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        found = self.keys[at] == sought
        out[maybe[found]] = self.order[at[found]]
        return out
