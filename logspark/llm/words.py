"""Word boundaries and 64-bit word hashes of whole Arrow string columns, without a Python loop per word.

A column is one run of UTF-8 bytes plus offsets.  Boundaries are byte masks; a
hash is the sum of (value of the byte) x (power of its place in the word), then
mixed.  Bytes are hashed in slices of about ``SLICE`` bytes, so the memory used
beyond the column itself is a few words per word of text, however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
GROUP = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_ASCII_SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_powers = np.ones(1, np.uint64)


class Words(NamedTuple):
    """Words of a group of texts: ``first[i]:first[i+1]`` are the words of text i."""

    hash: np.ndarray
    first: np.ndarray


def table(separators: list[int], fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte values for hashing (0 for separators) and the mask of separators."""
    mask = np.zeros(256, bool)
    mask[separators] = True
    values = _BYTES.copy()
    if fold_case:
        values[65:91] = values[97:123]
    values[mask] = 0
    return values, mask


SPACED = table(_ASCII_SPACE, fold_case=True)
ALNUM = table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], fold_case=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 4096)
        steps = np.full(size, _MULTIPLIER, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def segment_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each segment ``starts[i]`` to the next start; bytes with value 0 count for nothing."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE)))
        stop = starts[b] if b < len(starts) else len(data)
        relative = starts[a:b] - starts[a]
        length = stop - starts[a]
        sizes = np.diff(relative, append=length)
        place = np.arange(length) - np.repeat(relative, sizes)
        weighed = values[data[starts[a] : stop]] * _power(int(sizes.max()))[place]
        out[a:b] = np.add.reduceat(weighed, relative)
        a = b
    return mix(out)


def text_groups(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about ``GROUP`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_starts(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Byte positions at which a word begins; a text boundary also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64)
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = inside[inner]
    return np.flatnonzero(begins)


def words_of(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    starts = word_starts(data, offsets, kind[1])
    return Words(segment_hashes(data, starts, kind[0]), np.searchsorted(starts, offsets))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; the caller removes runs that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = total * _MULTIPLIER + hashes[i : len(hashes) - n + 1 + i]
    return mix(total)
