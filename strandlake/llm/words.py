"""Whole-batch word handling: byte ranges, 64-bit word hashes and window hashes.

A word is a maximal run of bytes other than space and U+0009..U+000D, which is the
same cut on the UTF-8 bytes as on the code points.  Everything here works on the
Arrow buffers of a string column, a few numpy passes for a batch, never a row at a
time.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; bounds the working memory, not the work.
SLICE_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _byte_table(lower: bool) -> np.ndarray:
    table = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
    if lower:
        table[65:91] = table[97:123]
    return table


_TABLES = {flag: _byte_table(flag) for flag in (False, True)}
#: Bytes between words: white space, or all that is neither a letter, a digit nor beyond ASCII.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of words that are hashed at once, and so the length of the power tables that a worker keeps.
HASH_BYTES = 1 << 18
_powers: list[np.ndarray] = []


def _accumulated(n: int) -> list[np.ndarray]:
    out = []
    for step in (_STEP, pow(_STEP, -1, 1 << 64)):
        table = np.full(n, step, dtype=np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse; those of a word longer than HASH_BYTES aren't kept."""
    if not _powers:
        _powers.extend(_accumulated(HASH_BYTES))
    return _powers if n <= HASH_BYTES else _accumulated(n)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column, null rows being empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw


@dataclass
class Words:
    """Words of a batch: byte ranges in ``data``; words of row i are first[i]:first[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    space: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; with lower, A-Z count as a-z."""
        out = np.zeros(len(self.starts), np.uint64)
        table = np.where(self.space, np.uint64(0), _TABLES[lower])
        at = 0
        while at < len(out):  # powers count from the first word of each stretch
            begin = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, begin + HASH_BYTES, "right")))
            value = table[self.data[begin : int(self.ends[to - 1])]]
            up, down = _power_tables(len(value))
            value *= up[: len(value)]
            place = self.starts[at:to] - begin
            out[at:to] = np.add.reduceat(value, place) * down[place]
            at = to
        return mix64(out + (self.ends - self.starts).astype(np.uint64) * _MULT)

    def narrowed(self, rows: np.ndarray) -> "Words":
        """The words of some rows, in ascending order, with only these rows' bytes."""
        size = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(size)])
        counts = self.counts()[rows]
        first = np.concatenate([[0], np.cumsum(counts)])
        parts = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows.tolist()]
        kept = np.repeat(self.first[:-1][rows] - first[:-1], counts) + np.arange(int(first[-1]))
        moved = np.repeat(offsets[:-1] - self.offsets[:-1][rows], counts)
        data = np.concatenate(parts) if parts else self.data[:0]
        return Words(data, offsets, self.starts[kept] + moved, self.ends[kept] + moved, first, self.space)


def split_words(col: pa.Array, space: np.ndarray = SPACE) -> Words:
    offsets, data = string_buffers(col)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), np.int64), space)
    gap = space[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]  # where a row begins, a word may too
    begin = ~gap
    begin[1:] &= gap[:-1]
    begin[edge] = ~gap[edge]
    close = ~gap
    close[:-1] &= gap[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    close[last] = ~gap[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), space)


def window_hashes(word: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each word on, one for each word with k-1 after it."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xA24BAED4963EE407 + 2 * seed) & (2**64 - 1))
    out = word[:n].copy()
    for j in range(1, k):
        out *= base
        out += word[j : j + n]
    return mix64(out ^ np.uint64(seed))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words with which a window of k words of one row begins."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + ahead


def slices(table: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator:
    """Consecutive row slices of a batch with about ``most`` bytes of text each (a row at least)."""
    n = table.num_rows
    if not n:
        return
    col = table.column(column)
    if isinstance(col, pa.ChunkedArray):
        table = table.combine_chunks()
        col = table.column(column)
    offsets, _ = string_buffers(col)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(to, at + 1))
        yield table.slice(at, to - at)
        at = to


def byte_letters() -> dict[str, int]:
    """How a byte-level vocabulary writes each byte: printable ones as themselves, the others from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
