"""Words, lines and windows of Arrow text columns as numpy arrays.

A batch is cut into slices of a few hundred kilobytes (one document at least), so memory follows the longest
document, not the batch. A stretch of words or bytes is hashed as the sum of a random number for each value at its place,
so no regular pattern of values can cancel; hashes are the same in every process.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64
BLOCK = 1 << 15
_FIRST, _SECOND = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_VALUE, _PLACE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: The contract's word separators: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * _FIRST
    x = (x ^ (x >> U(27))) * _SECOND
    return x ^ (x >> U(31))


def placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for each value at its place."""
    x = values.astype(U)
    x += U(1)
    x *= _VALUE
    x += place.astype(U) * _PLACE
    for shift, times in ((30, _FIRST), (27, _SECOND)):
        x ^= x >> U(shift)
        x *= times
    x ^= x >> U(31)
    return x


def hashes_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end] (ascending and apart), worked in blocks."""
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + BLOCK, "right")) - 1)
        # More than one round only where a single stretch is longer than a block.
        for low in range(int(total[i]), int(total[j]), BLOCK):
            high = min(low + BLOCK, int(total[j]))
            n = np.minimum(total[i + 1 : j + 1], high) - np.maximum(total[i:j], low)
            place = np.arange(low, high) - np.repeat(total[i:j], n)
            numbers = placed(values[place + np.repeat(starts[i:j], n)], place)
            has = np.flatnonzero(n)
            out[i + has] += np.add.reduceat(numbers, (np.cumsum(n) - n)[has])
        i = j
    return mix(out ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Text:
    """Some rows of a text column. row_at: where each row's bytes begin, and the end."""

    data: np.ndarray
    row_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  # of each word
    word_at: np.ndarray  # first word of each row, and the end

    @functools.cached_property
    def words(self) -> np.ndarray:
        return hashes_of(self.data, self.starts, self.ends)

    @functools.cached_property
    def folded(self) -> np.ndarray:
        """Word hashes with A-Z lower-cased."""
        return hashes_of(FOLD[self.data], self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r"""(row, number in the row, first byte, end byte) of every \n-split line."""
        breaks = np.flatnonzero(self.data == 10)
        row_of_break = np.searchsorted(self.row_at, breaks, "right") - 1
        begin = np.concatenate([self.row_at[:-1], breaks + 1])
        end = np.concatenate([breaks, self.row_at[1:]])
        row = np.concatenate([np.arange(len(self.row_at) - 1), row_of_break])
        order = np.lexsort((begin, row))
        row, begin = row[order], begin[order]
        end_row = np.concatenate([row_of_break, np.arange(len(self.row_at) - 1)])
        end = end[np.lexsort((end, end_row))]
        first = np.searchsorted(row, np.arange(len(self.row_at) - 1))
        return row, np.arange(len(row)) - first[row], begin, end

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte over each row."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.row_at[1:]] - sums[self.row_at[:-1]]


def windows(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every ``size`` consecutive words of one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    out = words[:n].copy()
    for i in range(1, size):
        out = out * U(0xD1342543DE82EF95) + words[i : i + n]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, mix(out[at])


def text_of(column: pa.Array) -> Text:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    row_at = offsets - offsets[0]
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[row_at] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    word_at = np.searchsorted(starts, row_at)
    row = np.repeat(np.arange(len(column)), np.diff(word_at))
    return Text(data, row_at, starts, ends, row, word_at)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about ``limit`` bytes of text each, and their text without nulls."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at), pc.fill_null(text.slice(at, to - at), "")
            at = to


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur twice or more."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row: ``counts`` values each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
