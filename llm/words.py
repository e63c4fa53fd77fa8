"""Vectorised splitting and hashing of words in Arrow string columns.

Every operator that looks at words uses this module inside ``mapInArrow`` tasks.  A column is
cut into pieces of a megabyte (a single longer text is one piece), each piece is handled
by a handful of numpy passes, and no Python loop runs per word.  Arrays with a value for each byte hold one byte each, the
others have a value for each word or each of a bounded number of bytes, so a long text takes a small multiple of its size.

Null texts and empty texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 1 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_LONGEST = 64  # words with more bytes are hashed by xxhash, one by one
_STEP = 1 << 17  # words or runs handled at once
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.full(_LONGEST, 0x9E3779B97F4A7C15, np.uint64)
_POWER[0] = 1
_POWER = np.cumprod(_POWER, dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII other than digits and letters separates; every byte of a non-ASCII character is part of a word
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False
#: as above, and digits separate, too
NOT_LETTER = NOT_ALNUM.copy()
NOT_LETTER[48:58] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Piece:
    """Consecutive texts of one column: ``first`` is the row of the first of them, ``bounds``
    has the byte offsets of the texts in ``raw``, ``word_bounds`` those of their words in
    ``starts`` and ``ends`` (byte offsets)."""

    first: int
    raw: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, A-Z lower-cased."""
        return hash_spans(_LOWER[self.raw], self.starts, self.ends)

    def part(self, a: int, b: int) -> Piece:
        """The texts from ``a`` to before ``b``."""
        begin, end = self.bounds[a], self.bounds[b]
        words = slice(self.word_bounds[a], self.word_bounds[b])
        return Piece(self.first + a, self.raw[begin:end], self.bounds[a : b + 1] - begin, self.starts[words] - begin, self.ends[words] - begin, self.word_bounds[a : b + 1] - self.word_bounds[a])

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Each word, A-Z lower-cased, as a place in the array of the distinct ones.  Told apart by their bytes."""
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        data = _LOWER[self.raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]]
        at = np.concatenate(([0], np.cumsum(self.ends - self.starts, dtype=np.int64)))
        found = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(at), pa.py_buffer(data)).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary

    def text(self, i: int) -> bytes:
        return self.raw[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def owner(self) -> np.ndarray:
        """The text (0..n-1) that each word is in."""
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty byte spans; what is held besides them is bounded."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _STEP):
        out[i : i + _STEP] = _hash_some(raw, starts[i : i + _STEP], ends[i : i + _STEP])
    for i in np.flatnonzero(ends - starts > _LONGEST):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def _hash_some(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = np.minimum(ends - starts, _LONGEST)
    before = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(starts - before, size)
    value = _BYTE[raw[at]] * _POWER[at - np.repeat(starts, size)]
    return mix(np.add.reduceat(value, before) + size.astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the int64 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage, and what they keep adds up."""
    if _TRIM is not None:
        _TRIM(0)


def piece_end(at: np.ndarray, row: int, size: int) -> int:
    """Where the piece that begins with ``row`` ends: as many rows as fit ``size`` bytes, but one at least."""
    return max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)


def pieces(column: pa.Array, separators: np.ndarray = SPACE, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut the column into pieces of about ``size`` bytes and find the words in each."""
    data, at = column_bytes(column)
    row = 0
    while row < len(column):
        end = piece_end(at, row, size)
        raw, bounds = data[at[row] : at[end]], at[row : end + 1] - at[row]
        apart = separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True  # a new text ends the word before it
        begins = ~apart
        begins[1:] &= apart[:-1] | edge[1 : len(raw)]
        ends = ~apart
        if len(raw):
            ends[:-1] &= apart[1:] | edge[1 : len(raw)]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Piece(row, raw, bounds, starts, stops, np.searchsorted(starts, bounds))
        row = end
    give_back()


def shingles(hashes: np.ndarray, word_bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text and the text of each run, in text order.
    A text of fewer words, but not none, has one run: the whole."""
    counts = np.diff(word_bounds)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(counts)), runs)
    shift = word_bounds[:-1] - (np.cumsum(runs) - runs)
    out = np.empty(len(owner), np.uint64)
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    for a in range(0, len(owner), _STEP):
        mine = owner[a : a + _STEP]
        first, last = np.arange(a, a + len(mine)) + shift[mine], word_bounds[1:][mine]
        key = np.zeros(len(mine), np.uint64)
        for i in range(width):
            key = key * np.uint64(0xD6E8FEB86659FD93) + np.where(first + i < last, padded[first + i], np.uint64(0x51ED270B))
        out[a : a + _STEP] = mix(key)
    return out, owner
