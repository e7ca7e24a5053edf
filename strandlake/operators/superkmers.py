"""Exact k-mer counts by super-k-mers dealt by minimiser, on two-bit packed keys.

The minimiser of a k-mer is the first of its m-mers, both strands alike, in an order that
is mixed but for runs of one base and the like: these stand in every third k-mer of some
inputs, and are chosen only where there is nothing else.  Neighbouring k-mers of a read mostly share theirs, and such a stretch of up
to ``MOST`` k-mers, a super-k-mer, is one row of a packed first k-mer and the few bases
after it: about two bytes a k-mer instead of the k-mer's own length.  Tasks add up the
super-k-mers they repeat before anything is sent, so a k-mer that fills a third of the
input is a few rows a task.  Rows are dealt and sorted by minimiser; all occurrences of a
k-mer meet there, and a task counts the k-mers of one stretch of minimisers after another.

With k - m + 1 = MOST at most, a minimiser has no more than 2 * 9 * 4**8 distinct k-mers,
so the k-mers that a task holds at once are bounded however frequent the minimiser is.  For
k up to 15 the minimiser is the k-mer itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import nucleotide as nt

#: k-mers in a super-k-mer at most.
MOST = 9
#: Shortest minimiser, where k is as long: enough of them for any number of partitions.
LEAST_M = 15
#: Bases that are packed at once; bounds a task's memory, not a read's length.
STRETCH = 1 << 18
#: Super-k-mers that a task adds up before it sends them, and twice the k-mers that it counts at once.
HELD = 1 << 21
#: Rows in a batch that a task sends.
SENT = 1 << 16

ROWS = "bin long, head long, tail int, cnt long"

# The two-bit codes of the bases.  Every other byte reads as A.
CODES = np.zeros(256, np.uint8)
CODES[list(b"CcGgTt")] = [1, 1, 2, 2, 3, 3]
LETTERS = np.frombuffer(b"ACGT", np.uint8)


def minimiser_length(k: int) -> int:
    return min(nt.check_k(k), max(LEAST_M, k - MOST + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, by multiplications and shifts."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranked(x: np.ndarray, m: int) -> np.ndarray:
    """A number for each packed m-mer by which minimisers are chosen: those that change their base less than three times come last."""
    differs = x ^ (x >> np.uint64(2))
    changes = np.minimum(np.bitwise_count((differs | (differs >> np.uint64(1))) & np.uint64(0x5555555555555555 & nt.mask(m) >> 2)).astype(np.uint64), 3)
    return ((np.uint64(32) - changes) << np.uint64(58)) | (mixed(x) >> np.uint64(6))


def windows(codes: np.ndarray, k: int, backwards: bool = False) -> np.ndarray:
    """The k codes from each place on as one number, first code highest (or lowest), by doubling the width."""
    out, width = None, 0
    part, size = codes.astype(np.uint64), 1
    while True:
        if k & size:
            if out is None:
                out, width = part, size
            else:
                n = len(codes) - width - size + 1
                first, second, shift = out[: max(n, 0)], part[width : width + max(n, 0)], width if backwards else size
                out = (second << np.uint64(2 * shift)) | first if backwards else (first << np.uint64(2 * shift)) | second
                width += size
        if 2 * size > k:
            return out
        n = max(len(codes) - 2 * size + 1, 0)
        a, b = part[:n], part[size : size + n]
        part = (b << np.uint64(2 * size)) | a if backwards else (a << np.uint64(2 * size)) | b
        size *= 2


def reversed_complement(packed: np.ndarray, k: int) -> np.ndarray:
    """Packed reverse complements of packed k-mers."""
    x = ~packed
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        low = np.uint64(mask)
        x = ((x & low) << np.uint64(bits)) | ((x >> np.uint64(bits)) & low)
    return x.byteswap() >> np.uint64(64 - 2 * k)


def least_in(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w numbers from each place on."""
    width, out = 1, x
    while width < w:
        step = min(width, w - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def _within(starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the first n windows of k codes lie in one read: those over the end of a read are none."""
    within, edge = np.ones(n, bool), starts[1:]
    if len(edge):
        over = np.zeros(n + 1, np.int64)
        np.add.at(over, np.clip(edge - k + 1, 0, n), 1)
        np.add.at(over, np.clip(edge, 0, n), -1)
        within = np.cumsum(over[:-1]) == 0
    return within


def super_kmers(codes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, head, tail) for reads that lie one after the other in ``codes`` and begin at ``starts``.

    The head is the packed first k-mer; the tail holds how many more k-mers there are and, above, the bases they add.
    """
    none = np.zeros(0, np.uint64)
    if len(codes) < k:
        return none, none, none.astype(np.int32)
    m = minimiser_length(k)
    forward, back = windows(codes, m), windows(3 - codes, m, backwards=True)
    least = least_in(ranked(np.minimum(forward, back), m), k - m + 1)
    n = len(least)
    within = _within(starts, n, k)
    begin = np.empty(n, bool)
    begin[0] = True
    begin[1:] = (least[1:] != least[:-1]) | (within[1:] != within[:-1])
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, n))
    at, size = at[within[at]], size[within[at]]
    parts = -(-size // MOST)  # a run that goes on is cut
    inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    place = np.repeat(at, parts) + MOST * inner
    more = np.minimum(np.repeat(size, parts) - MOST * inner, MOST) - 1
    head = forward[place] if m == k else windows(codes, k)[place]
    tail = np.zeros(len(place), np.int32)
    for j in range(MOST - 1):
        has = more > j
        tail[has] |= codes[place[has] + k + j].astype(np.int32) << (4 + 2 * j)
    return least[place], head, tail | more.astype(np.int32)


def added(minimiser: np.ndarray, head: np.ndarray, tail: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal super-k-mers added up; two that meet the same mixed number are kept apart, never joined."""
    order = np.argsort(mixed(head ^ mixed(tail.astype(np.uint64))), kind="stable")
    head, tail = head[order], tail[order]
    first = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))) if len(head) else np.zeros(0, np.int64)
    total = np.add.reduceat(cnt[order], first) if len(head) else cnt
    return minimiser[order][first], head[first], tail[first], total


def expanded(head: np.ndarray, tail: np.ndarray, cnt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed k-mers of super-k-mers, each with its super-k-mer's count."""
    mask = np.uint64(nt.mask(k))
    keys, counts, now, bases, more = [head], [cnt], head, tail >> 4, tail & 15
    for _ in range(MOST - 1):
        has = more > 0
        if not has.any():
            break
        now, bases, more, cnt = now[has], bases[has], more[has] - 1, cnt[has]
        now = ((now << np.uint64(2)) | (bases & 3).astype(np.uint64)) & mask
        bases = bases >> 2
        keys.append(now)
        counts.append(cnt)
    return np.concatenate(keys), np.concatenate(counts)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def letters(packed: np.ndarray, k: int) -> pa.Array:
    """Packed k-mers as strings."""
    out = np.empty((len(packed), k), np.uint8)
    for j in range(k):
        out[:, j] = LETTERS[((packed >> np.uint64(2 * (k - 1 - j))) & np.uint64(3)).astype(np.uint8)]
    offsets = np.arange(len(packed) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(packed), pa.py_buffer(offsets), pa.py_buffer(out.reshape(-1)))


def _stretches(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and read starts of a column of reads, about STRETCH bases at a time; a longer read goes on k - 1 bases back."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
        low, high = int(offsets[at]), int(offsets[to])
        if high - low <= STRETCH:
            yield CODES[data[low:high]], offsets[at:to] - low
        else:
            for begin in range(low, high - k + 1, STRETCH):
                yield CODES[data[begin : min(high, begin + STRETCH + k - 1)]], np.zeros(1, np.int64)
        at = to


def _rows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(minimiser, head, tail, count) as batches of ROWS."""
    for at in range(0, len(columns[0]), SENT):
        bins, head, tail, cnt = (x[at : at + SENT] for x in columns)
        yield pa.RecordBatch.from_pydict({"bin": bins.view(np.int64), "head": head.view(np.int64), "tail": tail, "cnt": cnt})


def _cut(k: int):
    def cut(batches):
        held, n = [], 0
        for batch in batches:
            for codes, starts in _stretches(batch.column(0), k):
                found = super_kmers(codes, starts, k)
                held.append(added(*found, np.ones(len(found[0]), np.int64)))
                n += len(held[-1][0])
                if n > HELD:
                    held = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    n = len(held[0][0])
                    if n > HELD // 2:  # few repeats: send what there is
                        yield from _rows(*held[0])
                        held, n = [], 0
        if n:
            yield from _rows(*added(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def cut_whole(batches):
        """Where the minimiser is the k-mer itself, a super-k-mer is one k-mer."""
        for keys, counts in _task_counts(batches, k, canonical=False):
            for keys, counts in _pieces(keys, counts):
                bins = ranked(np.minimum(keys, reversed_complement(keys, k)), k)
                yield from _rows(bins, keys, np.zeros(len(keys), np.int32), counts)

    return cut_whole if minimiser_length(k) == k else cut


def _count(k: int, canonical: bool):
    """Counts the k-mers of rows in the order of their minimisers, as many minimisers at once as fit."""

    def count(batches):
        held, n = [], 0

        def tell(parts):
            keys, counts = expanded(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
            if canonical:
                keys = np.minimum(keys, reversed_complement(keys, k))
            keys, counts = counted(keys, counts)
            for keys, counts in _pieces(keys, counts):
                yield pa.RecordBatch.from_pydict({"kmer": letters(keys, k), "cnt": counts})

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bin").to_numpy()
            head, tail, cnt = batch.column("head").to_numpy().view(np.uint64), batch.column("tail").to_numpy(), batch.column("cnt").to_numpy()
            if n > HELD // 2:  # the rows of the minimiser that the last batch ended in still belong to what is held
                first = int(np.argmax(bins != last)) if (bins != last).any() else len(bins)
                held.append((head[:first], tail[:first], cnt[:first]))
                if first < len(bins):
                    yield from tell(held)
                    held, n = [(head[first:], tail[first:], cnt[first:])], int((1 + (tail[first:] & 15)).sum())
                elif n > 2 * HELD:  # one minimiser: its super-k-mers repeat from task to task
                    held = [_repeats(held)]
                    n = int((1 + (held[0][1] & 15)).sum())
            else:
                held.append((head, tail, cnt))
                n += int((1 + (tail & 15)).sum())
            last = bins[-1]
        if held:
            yield from tell(held)

    return count


def _repeats(parts):
    head, tail, cnt = (np.concatenate(x) for x in zip(*parts, strict=True))
    return added(head, head, tail, cnt)[1:]


def stretch_counts(batches, k: int, canonical: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct packed k-mers of reads in order, with their counts, a stretch of reads at a time."""
    for batch in batches:
        for codes, starts in _stretches(batch.column(0), k):
            if len(codes) < k:
                continue
            keys = windows(codes, k)
            if canonical:
                keys = np.minimum(keys, windows(3 - codes, k, backwards=True))
            keys = np.sort(keys[_within(starts, len(keys), k)])
            if len(keys):
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                yield keys[first], np.diff(np.append(first, len(keys)))


def _task_counts(batches, k: int, canonical: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same over all that a task reads, as many distinct ones at once as fit."""
    held, n = [], 0
    for found in stretch_counts(batches, k, canonical):
        held.append(found)
        n += len(found[0])
        if n > HELD // 2:
            held = [counted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            n = len(held[0][0])
            if n > HELD // 4:  # few repeats: give what there is
                yield held[0]
                held, n = [], 0
    if held:
        yield counted(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _pieces(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(keys), SENT):
        yield keys[at : at + SENT], counts[at : at + SENT]


def _count_within(k: int, canonical: bool):
    def count(batches):
        for found in _task_counts(batches, k, canonical):
            for keys, counts in _pieces(*found):
                yield pa.RecordBatch.from_pydict({"kmer": letters(keys, k), "cnt": counts})

    return count


def count_within(reads: DataFrame, k: int, seq: str = "seq", canonical: bool = True) -> DataFrame:
    """(kmer, cnt) as in ``count``, but of each task's own reads, HELD k-mers at once: a k-mer has rows in many tasks, whose sum is its count."""
    nt.check_k(k)
    return reads.select(F.col(seq).cast("string").alias("seq")).mapInArrow(_count_within(k, canonical), "kmer string, cnt long")


def count(reads: DataFrame, k: int, seq: str = "seq", canonical: bool = True) -> DataFrame:
    """(kmer, cnt) for each k-mer of the reads, both strands under the lesser one if canonical.

    Reads may be any text: case is ignored and a byte that isn't a base counts as A.  Null reads have no k-mers.
    """
    nt.check_k(k)
    rows = reads.select(F.col(seq).cast("string").alias("seq")).mapInArrow(_cut(k), ROWS)
    return rows.repartition("bin").sortWithinPartitions("bin").mapInArrow(_count(k, canonical), "kmer string, cnt long")
