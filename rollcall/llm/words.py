"""Vectorised word and window hashes over Arrow string columns.

Words are maximal runs of bytes outside a separator set.  Every separator is
an ASCII byte, so runs of bytes and runs of code points agree in UTF-8.  All
work is done on numpy arrays of one slice of a batch (a few megabytes of
text), never per word in Python; a text longer than a slice is one slice and
is hashed in pieces that end at a separator.

Hashes are 64-bit polynomials with random odd bases, finished by an
avalanche step.  Equal hash means equal word sequence up to a chance of
2**-64 for each pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The separators of the word pattern [^\x20\x09-\x0D]+
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SLICE_BYTES = 1_000_000
PIECE_BYTES = 1 << 19

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of consecutive rows: byte spans, hashes, and each row's first word."""

    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray  # uint64
    first: np.ndarray  # row r holds words first[r]..first[r + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the byte offset of each row; null is empty."""
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` text bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class WordHasher:
    """Splits and hashes the words of a column; made once for each task."""

    def __init__(self, fold_ascii: bool = False, separators: tuple[int, ...] = SPACES):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        if fold_ascii:
            self.fold[0x41:0x5B] += 0x20
        self._powers: dict[int, np.ndarray] = {}

    def powers(self, base: int, n: int) -> np.ndarray:
        have = self._powers.get(base)
        if have is None or len(have) < n:
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            have = self._powers[base] = np.multiply.accumulate(steps)
        return have[:n]

    def span_hash(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        """Hash of values[start:end] for each span, independent of where it lies."""
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(base, len(values)), out=total[1:])
        inverse = pow(base, -1, 1 << 64)
        spans = (total[end] - total[start]) * self.powers(inverse, len(values) + 1)[start]
        return mix64(spans)

    def words(self, column: pa.Array) -> Words:
        return self._split(column, ())[0]

    def words_and_heads(self, column: pa.Array, heads: tuple[int, ...]) -> tuple[Words, list[np.ndarray]]:
        """The words, and for each of ``heads`` a hash of that many first bytes of each."""
        return self._split(column, heads)

    def _split(self, column: pa.Array, sizes: tuple[int, ...]) -> tuple[Words, list[np.ndarray]]:
        data, offsets = text_bytes(column)
        starts, ends, hashes, heads = [], [], [], [[] for _ in sizes]
        at = 0
        while at < len(data):
            to = self._piece_end(data, offsets, at)
            part = data[at:to]
            word = self.is_word[part]
            cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
            before = np.concatenate(([False], word[:-1]))
            before[cut] = False
            after = np.concatenate((word[1:], [False]))
            after[cut[cut > 0] - 1] = False
            start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
            # byte 0 counts as 1, or a trailing zero byte would not change the hash
            values = self.fold[part].astype(np.uint64) + np.uint64(1)
            hashes.append(self.span_hash(values, start, end, _BYTE_BASE))
            for size, found in zip(sizes, heads):
                found.append(self.span_hash(values, start, np.minimum(end, start + size), _BYTE_BASE))
            starts.append(start + at)
            ends.append(end + at)
            at = to
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        end = np.concatenate(ends) if ends else np.empty(0, np.int64)
        value = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        tops = [np.concatenate(found) if found else np.empty(0, np.uint64) for found in heads]
        return Words(start, end, value, np.searchsorted(start, offsets)), tops

    def _piece_end(self, data: np.ndarray, offsets: np.ndarray, at: int) -> int:
        """Where the piece that begins at ``at`` ends: at a row's end or behind a separator."""
        to = at + PIECE_BYTES
        if to >= len(data):
            return len(data)
        row_end = int(offsets[np.searchsorted(offsets, to)])
        while to < row_end:
            gap = np.flatnonzero(~self.is_word[data[to : min(to + 65536, row_end)]])
            if len(gap):
                return to + int(gap[0]) + 1
            to += 65536
        return row_end

    def windows(self, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of ``size`` words within a row."""
        index = np.arange(len(words.hash))
        start = index[index + size <= np.repeat(words.first[1:], words.counts)]
        return start, self.span_hash(words.hash, start, start + size, _WORD_BASE)

    def sequences(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """Hash of all words of each given row."""
        return self.span_hash(words.hash, words.first[rows], words.first[rows + 1], _WORD_BASE)


def signed(x: np.ndarray) -> pa.Array:
    """uint64 hashes as the bigint values Spark stores."""
    return pa.array(x.view(np.int64))
