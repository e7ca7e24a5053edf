"""Benchmark decontamination by greedy string tiling.

Benchmark items are a stated query set: they are read in blocks of bounded size, and
each block meets all documents.  Tokens are runs of letters and digits, ASCII letters
lower-cased, so punctuation and symbols don't hide a copy.  A document that shares a
seed of ``min_tile`` tokens with an item is tiled against it: the longest common
stretch of unmarked tokens is found with Karp-Rabin window hashes, marked in both, and
the search goes on until none of ``min_tile`` tokens is left.  Tiles may lie in any
order, so reordered passages count.  The pair is contaminated when the tiles cover
``min_coverage`` of the item's tokens.

Defined results: null and empty texts match nothing; items of under ``min_tile``
tokens can't be told from chance and match nothing; repeated rows of documents give
their pairs once each; columns beyond doc_id/text and item_id/text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import PUNCTUATION, slices, split_words, window_hashes, window_starts

MIN_TILE = 4
MIN_COVERAGE = 0.5
#: Bytes of benchmark text that one pass over the documents carries to every executor.
BLOCK_BYTES = 8 << 20


def _longest(a: np.ndarray, free_a: np.ndarray, b: np.ndarray, free_b: np.ndarray, low: int, high: int):
    """Length and places of the longest common stretch of free tokens, between low and high; length 0 if none.

    If a stretch of s tokens is shared, so is one of s - 1: the length is found by halving.
    """

    def shared(s: int):
        if s > len(a) or s > len(b):
            return None
        whole_a = np.convolve(free_a, np.ones(s, np.int64), "valid") == s
        whole_b = np.convolve(free_b, np.ones(s, np.int64), "valid") == s
        at_a, at_b = np.flatnonzero(whole_a), np.flatnonzero(whole_b)
        if not len(at_a) or not len(at_b):
            return None
        _, i, j = np.intersect1d(window_hashes(a, s)[at_a], window_hashes(b, s)[at_b], return_indices=True)
        if not len(i):
            return None
        first = np.lexsort((at_b[j], at_a[i]))[0]
        return s, int(at_a[i[first]]), int(at_b[j[first]])

    best = shared(low)
    if best is None:
        return 0, 0, 0
    low += 1
    while low <= high:
        mid = (low + high) // 2
        found = shared(mid)
        if found is None:
            high = mid - 1
        else:
            best, low = found, mid + 1
    return best


def tile(a: np.ndarray, b: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two hashed token sequences: (place in a, place in b, length), longest first."""
    free_a, free_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    tiles, most = [], min(len(a), len(b))
    while most >= min_tile:
        most, i, j = _longest(a, free_a, b, free_b, min_tile, most)
        if not most:
            break
        tiles.append((i, j, most))
        free_a[i : i + most] = 0
        free_b[j : j + most] = 0
    return tiles


class Block:
    """A block of items: their token hashes, and their seeds sorted by hash."""

    def __init__(self, ids: list[int], texts: pa.Array, min_tile: int):
        w = split_words(texts, PUNCTUATION)
        h = w.hashes(lower=True)
        self.ids, self.min_tile = ids, min_tile
        self.tokens = [h[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
        at = window_starts(w.first, min_tile)
        seeds = window_hashes(h, min_tile)[at] if len(at) else np.zeros(0, np.uint64)
        owner = np.searchsorted(w.first, at, "right") - 1
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]

    def pairs(self, col: pa.Array, min_coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, item's tokens, tokens covered, tiles) for each contaminated pair."""
        w = split_words(col, PUNCTUATION)
        at = window_starts(w.first, self.min_tile)
        if not len(at) or not len(self.seeds):
            return
        h = w.hashes(lower=True)
        keys = window_hashes(h, self.min_tile)[at]
        lo = np.searchsorted(self.seeds, keys, "left")
        hit = self.seeds[np.minimum(lo, len(self.seeds) - 1)] == keys
        at, keys, lo = at[hit], keys[hit], lo[hit]
        hi = np.searchsorted(self.seeds, keys, "right")
        rows = np.searchsorted(w.first, at, "right") - 1
        for row in np.unique(rows):
            mine = rows == row
            items = np.concatenate([self.owner[x:y] for x, y in zip(lo[mine], hi[mine], strict=True)])
            near = np.zeros(w.first[row + 1] - w.first[row] + 2, bool)
            for j in range(self.min_tile):
                near[at[mine] - w.first[row] + j] = True
            near = near[:-2]
            apart = np.append(near[1:], False) & ~near  # a token that is like no other stays between stretches
            text = np.where(near, h[w.first[row] : w.first[row + 1]], np.uint64(0))[near | apart]
            for item in np.unique(items):
                tokens = self.tokens[item]
                tiles = tile(tokens, text, self.min_tile)
                covered = sum(t[2] for t in tiles)
                if covered >= min_coverage * len(tokens):
                    yield int(row), self.ids[item], len(tokens), covered, len(tiles)


def blocks(benchmark: DataFrame, min_tile: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of about ``block_bytes`` of text, read one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = int(size // block_bytes) + 1
    for k in range(n):
        table = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct().orderBy("item_id", "text").toArrow()
        if table.num_rows:
            yield Block(table.column("item_id").to_pylist(), table.column("text").combine_chunks(), min_tile)


PAIRS = "doc_id long, item_id long, n_tokens int, n_covered int, n_tiles int, coverage double"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item whose tiles cover enough of the item."""
    spark = docs.sparkSession
    picked = docs.select("doc_id", "text")
    out = None
    for block in blocks(benchmark, min_tile, block_bytes):
        shared = spark.sparkContext.broadcast(block)  # at most a block, whatever the benchmark's size

        def search(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id")
                    found = list(shared.value.pairs(part.column("text"), min_coverage))
                    if found:
                        rows, items, total, covered, tiles = (list(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": ids.take(pa.array(rows)).cast(pa.int64()),
                                "item_id": pa.array(items, pa.int64()),
                                "n_tokens": pa.array(total, pa.int32()),
                                "n_covered": pa.array(covered, pa.int32()),
                                "n_tiles": pa.array(tiles, pa.int32()),
                                "coverage": pa.array([c / t for c, t in zip(covered, total, strict=True)], pa.float64()),
                            }
                        )

        pairs = picked.mapInArrow(search, PAIRS)
        out = pairs if out is None else out.unionAll(pairs)
    return spark.createDataFrame([], PAIRS) if out is None else out


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
