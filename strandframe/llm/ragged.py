"""Texts as one byte array with offsets; words, hashes and n-grams by numpy, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a piece of its own.
PIECE = 1 << 19
_RANDOM = np.random.default_rng(20240501)
#: A random 64-bit value for each byte; BASE and WORD_BASE are odd, so they have inverses modulo 2**64.
BYTE_VALUE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[tuple[int, bool], np.ndarray] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, or those of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = np.full(max(n, PIECE + 1), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        step[0] = 1
        have = _powers[base, inverse] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each span, equal for equal content anywhere."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(base, len(values) + 1, True)[starts])


@dataclass
class Texts:
    """Some rows of a batch: data holds the texts one after the other, offsets their bounds, first the number of the first row."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray

    def bounds(self, n: int) -> np.ndarray:
        """Numbers of each row's first word, and the end."""
        return np.searchsorted(self.row, np.arange(n + 1))


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[Texts]:
    """The rows of a string column, null as empty, in pieces of about ``most`` bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def split_words(texts: Texts, is_word: np.ndarray, shown: np.ndarray | None = None) -> Words:
    """Runs of bytes for which is_word (a table of 256) holds; hashed as ``shown`` shows them."""
    inside = is_word[texts.data]
    first = np.zeros(len(inside) + 1, bool)
    first[texts.offsets] = True  # a text's first byte starts a word even after another text's last
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    values = BYTE_VALUE if shown is None else BYTE_VALUE[shown]
    row = np.searchsorted(texts.offsets, starts, "right") - 1
    return Words(starts, ends, row, span_hashes(values[texts.data], starts, ends, BASE))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words within a text."""
    if len(words.row) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.row[: len(words.row) - n + 1] == words.row[n - 1 :])
    return at, span_hashes(words.hashes, at, at + n, WORD_BASE)


#: For bytes.translate(): every space byte as a blank (bytes.split() alone knows the same six).
SPACES_BYTES = bytes(32 if IS_SPACE[b] else b for b in range(256))
