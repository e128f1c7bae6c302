"""Token ids of whole Arrow string columns with a public tokenizer file, word by word.

Both byte-level and word-level BPE cut a text at white space and between letters
and marks before they merge, so the ids of a text are the ids of its units in
order.  Units are found on bytes, each distinct unit of a batch is encoded once by
the tokenizers library, and a bounded cache keeps units for the next batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from logspark.llm import words

CACHE_UNITS = 1 << 20
_UNIT_VALUES = words.table([], fold_case=False)[0]
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?*$%&#|"]] = True


def _latin_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is an ASCII or a two-byte Latin letter."""
    last, lead = data[at], data[np.maximum(at - 1, 0)]
    return _ASCII_LETTER[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))


def _solid(data: np.ndarray, at: np.ndarray, before: bool) -> np.ndarray:
    """Whether the character that ends (``before``) or begins at ``at`` surely is no white space."""
    here = data[at]
    if before:
        plain = (here < 0x80) & ~_SPACE[here]
        return plain | _latin_letter(data, at)
    return ((here < 0x80) & ~_SPACE[here]) | ((here >= 0xC3) & (here < 0xE0)) | (here >= 0xF0)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where a unit begins: a text, a lone space or line end, what follows that end, a mark after a letter.

    Where neighbours might be further white space nothing is cut, so a unit may
    hold several words; its ids are right all the same.
    """
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    if n > 2:
        inner = np.arange(1, n - 1)
        gaps = inner[(data[1:-1] == 0x20) | (data[1:-1] == 0x0A)]
        gaps = gaps[~begins[gaps] & ~begins[gaps + 1]]
        gaps = gaps[_solid(data, gaps - 1, True) & _solid(data, gaps + 1, False)]
        marks = inner[_MARK[data[1:-1]]]
        marks = marks[~begins[marks]]
        marks = marks[_latin_letter(data, marks - 1)]
        begins[gaps] = True
        begins[gaps[data[gaps] == 0x0A] + 1] = True
        begins[marks] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """Encodes columns with one tokenizer file; ids are kept as 16-bit numbers where the vocabulary allows."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.marked = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.plain.get_added_tokens_decoder().items() if t.special]
        self.stop = special[-1] if special else None
        self.dtype = np.dtype("<u2") if self.plain.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has."""
        if self.stop is None or any("<|" in u for u in units):
            lists = [e.ids for e in self.plain.encode_batch_fast(units, add_special_tokens=False)]
            return np.array([i for x in lists for i in x], self.dtype), np.array([len(x) for x in lists], np.int64)
        mark_id, mark = self.stop
        ids = np.array(self.marked.encode(mark.join(units) + mark, add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(ids == mark_id)
        return ids[ids != mark_id].astype(self.dtype), np.diff(ends, prepend=-1) - 1

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE_UNITS:
            self._forget()
        raw = data.tobytes()
        units = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        parts, sizes = [], []
        for i in range(0, len(units), 4096):
            ids, size = self._encode_units(units[i : i + 4096])
            parts.append(ids)
            sizes.append(size)
        size = np.concatenate(sizes)
        at = np.cumsum(size) - size + len(self.ids)
        order = np.argsort(merged := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = merged[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one more entry than texts)."""
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        starts = unit_starts(data, offsets)
        hashes = words.segment_hashes(data, starts, _UNIT_VALUES)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            if len(self.keys) + (~known).sum() > CACHE_UNITS:
                known[:] = False
            new = example[~known]
            ends = np.append(starts, len(data))[1:]
            self._learn(data, distinct[~known], starts[new], ends[new])
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][which], self.size[place][which]
        ends = np.cumsum(size)
        index = np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))
        bounds = np.append(0, ends)[np.searchsorted(starts, offsets)]
        return self.ids[index], bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; its cache serves all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(path: str, column: pa.Array):
    """Yield (first row, ids, bounds) for runs of texts of a column."""
    coder = encoder(path)
    for row, data, offsets in words.text_groups(column):
        ids, bounds = coder.encode(data, offsets)
        yield row, ids, bounds
