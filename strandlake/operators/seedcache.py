"""Frequent k-mers from a table of decaying counters, of a size that is a parameter.

A cell of the table holds one k-mer and its count.  The k-mer's own occurrences raise the
count; each occurrence of another k-mer of the cell lowers it by one with probability
``DECAY ** count``, and at zero the strongest newcomer takes the cell.  So rare k-mers wear
each other out and frequent ones stay.  A count is never above the exact one.

Draws are a pure function of the seed, the cell, its k-mer and how much the table has seen:
a task that runs again leaves the same table.  Each task fills a table from its own part of the
reads, in the order in which it reads them; tables are merged by adding up the counts of equal
k-mers, which needs neither all k-mers in one place nor the tasks in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import nucleotide as nt
from strandlake.operators import superkmers as sk

# Fixed value: what a count is worth more in keeping its cell.
DECAY = 0.9
#: Cells of a task's table, 16 bytes each.
CELLS = 1 << 16
#: k-mers that are counted again exactly, for each one asked for.
TRACKED = 50

PACKED = "packed long, cnt long"


class SeedCache:
    def __init__(self, cells: int = CELLS, seed: int = 0):
        if cells < 1:
            raise ValueError("a table has at least one cell")
        self.keys, self.counts = np.zeros(cells, np.uint64), np.zeros(cells, np.int64)
        self.salt = sk.mixed(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64))
        self.seen = 0

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return (sk.mixed(keys ^ self.salt) % np.uint64(len(self.keys))).astype(np.int64)

    def _draws(self, cell: np.ndarray, step: int) -> np.ndarray:
        """Numbers over 0 and at most 1, one for each cell."""
        at = sk.mixed(self.salt + np.uint64(self.seen)) + np.uint64(step)
        bits = sk.mixed(sk.mixed(self.keys[cell] ^ at) + cell.astype(np.uint64))
        return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct packed k-mers with how often each occurs next."""
        if not len(keys):
            return
        cell = self.cells(keys)
        own = (self.counts[cell] > 0) & (self.keys[cell] == keys)
        self.counts[cell[own]] += counts[own]
        cell, keys, counts = cell[~own], keys[~own], counts[~own]
        order = np.lexsort((keys, -counts, cell))
        cell, keys, counts = cell[order], keys[order], counts[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        if len(first):
            self._contest(cell[first], keys[first], counts[first], np.add.reduceat(counts, first))
        self.seen += 1

    def _contest(self, cell: np.ndarray, keys: np.ndarray, counts: np.ndarray, left: np.ndarray) -> None:
        """Newcomers, of each cell the strongest, against what the cells hold; left: occurrences that wear a cell out."""
        now, step = self.counts[cell], 0
        at = np.flatnonzero(now > 0)
        while len(at):  # how many occurrences pass before the next one that counts is drawn at once
            p = np.maximum(DECAY ** now[at].astype(np.float64), 1e-15)
            wait = 1 + np.floor(np.log(self._draws(cell[at], step)) / np.log1p(-p))
            hit = wait <= left[at]
            at, wait = at[hit], wait[hit].astype(np.int64)
            now[at] -= 1
            left[at] -= wait
            at, step = at[now[at] > 0], step + 1
        self.counts[cell] = now
        taken = now == 0
        self.keys[cell[taken]] = keys[taken]
        self.counts[cell[taken]] = np.maximum(np.minimum(counts[taken], left[taken]), 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        held = self.counts > 0
        return self.keys[held], self.counts[held]


def _batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"packed": keys.view(np.int64), "cnt": counts})


def _reads(reads: DataFrame, k: int, seq: str) -> DataFrame:
    nt.check_k(k)
    return reads.select(F.col(seq).cast("string").alias("seq"))


def _most(rows: DataFrame, n: int) -> DataFrame:
    """The n highest totals, equal ones by k-mer: packed numbers without their sign."""
    return rows.groupBy("packed").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), F.col("packed").bitwiseXOR(F.lit(-(1 << 63)))).limit(n)


def _candidates(reads: DataFrame, k: int, n: int, cells: int, seed: int, seq: str) -> DataFrame:
    def fill(batches):
        cache = SeedCache(cells, seed)
        for found in sk.stretch_counts(batches, k):
            cache.add(*found)
        yield _batch(*cache.rows())

    return _most(_reads(reads, k, seq).mapInArrow(fill, PACKED), n)


def _spelt(rows: DataFrame, k: int) -> DataFrame:
    return rows.select(nt.unpack(F.col("packed"), k).alias("kmer"), "cnt")


def seeds_decaying(reads: DataFrame, k: int, n: int, cells: int = CELLS, seed: int = 0, seq: str = "seq") -> DataFrame:
    """(kmer, cnt): about the n most frequent canonical k-mers of reads or any text, in one pass; counts are at most the exact ones.

    A task sends at most ``cells`` rows.  Null reads, and those shorter than k, have no k-mers.
    """
    return _spelt(_candidates(reads, k, n, cells, seed, seq), k)


def seeds_recounted(reads: DataFrame, k: int, n: int, cells: int = CELLS, seed: int = 0, seq: str = "seq") -> DataFrame:
    """(kmer, cnt): the n most frequent with exact counts, ties by k-mer: a second pass counts TRACKED candidates for each.

    No k-mer outside the candidates is exchanged.  The n * TRACKED candidates are the only rows that pass the driver.
    """
    found = _candidates(reads, k, n * TRACKED, cells, seed, seq).toArrow().column("packed").to_numpy()
    wanted = np.sort(found.astype(np.int64)).view(np.uint64)

    def recount(batches):
        total = np.zeros(len(wanted), np.int64)
        for keys, counts in sk.stretch_counts(batches, k):
            at = np.minimum(np.searchsorted(wanted, keys), max(len(wanted) - 1, 0))
            same = wanted[at] == keys if len(wanted) else np.zeros(len(keys), bool)
            total[at[same]] += counts[same]
        yield _batch(wanted[total > 0], total[total > 0])

    return _spelt(_most(_reads(reads, k, seq).mapInArrow(recount, PACKED), n), k)
