"""k-mer tables: extraction, exact counts, spectrum, seeds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import nucleotide as nt
from strandlake.operators import superkmers
from strandlake.operators.components import settle
from strandlake.operators.sampling import digest_number

#: Where a fixed-width counter of ten bits stops.
SATURATED = 1023
#: Windows that are cut from a read at a time: a chromosome is many rows, not one array.
STRETCH = 1 << 16
#: Cells in each way of a count sketch, and its ways (at most four).
SKETCH_WIDTH = 1 << 16
SKETCH_DEPTH = 4
#: Cells of a way that are sent to every task.
SMALL_SKETCH = 1 << 18


def kmers(reads: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = (), stretch: int = STRETCH) -> DataFrame:
    """One row per window of k bases: (kept columns, kmer).  Reads shorter than k give none.

    Reads are first cut into stretches that overlap by k - 1 bases, so no array holds more
    than ``stretch`` windows; counts of whole tables go by super-k-mers instead.  Windows are cut from the bytes: cutting a string by
    characters walks it from its start each time.
    """
    nt.check_k(k)
    raw, piece = F.col(seq).cast("binary"), F.col("kmer")
    starts = F.sequence(F.lit(1), F.octet_length(raw) - k + 1, F.lit(stretch))
    stretches = F.transform(starts, lambda i: F.substring(raw, i, F.lit(stretch + k - 1)))
    places = F.sequence(F.lit(1), F.octet_length(piece) - k + 1)
    windows = F.transform(places, lambda i: F.substring(piece, i, F.lit(k)))
    long = reads.filter(F.octet_length(F.col(seq)) >= k)
    cut = long.select(*keep, F.explode(stretches).alias("kmer"))
    return cut.select(*keep, F.explode(windows).alias("kmer")).withColumn("kmer", F.col("kmer").cast("string"))


def count(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, cnt) for k-mers as read; seq may be any text, whose other bytes count as A."""
    return superkmers.count(reads, k, seq, canonical=False)


def count_canonical(reads: DataFrame, k: int, seq: str = "seq", saturate: int | None = None) -> DataFrame:
    """(kmer, cnt) with both strands under the lesser k-mer; seq may be any text, whose other bytes count as A."""
    both = superkmers.count(reads, k, seq)
    return saturated(both, saturate) if saturate is not None else both


def saturated(counts: DataFrame, most: int = SATURATED) -> DataFrame:
    return counts.withColumn("cnt", F.least("cnt", F.lit(most).cast("bigint")))


def spectrum(counts: DataFrame) -> DataFrame:
    """(cnt, n_kmers): how many k-mers have each count."""
    return counts.groupBy("cnt").agg(F.count("*").alias("n_kmers"))


def windows_per_read(length: Column, k: int) -> Column:
    return F.greatest(length - nt.check_k(k) + 1, F.lit(0)).cast("bigint")


def seeds(counts: DataFrame, n: int) -> DataFrame:
    """The n k-mers with the highest counts, ties by k-mer: exact, as bounded heaps in each task."""
    return counts.orderBy(F.desc("cnt"), "kmer").limit(n)


def _frequent(k: int, tracked: int):
    """A task's summary of frequent k-mers: where more than ``tracked`` are held, all lose the count of the first beyond; those held at the end get it back."""

    def run(batches):
        keys, counts, lost = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for found, n in superkmers.stretch_counts(batches, k):
            keys, counts = superkmers.counted(np.concatenate([keys, found]), np.concatenate([counts, n]))
            if len(keys) > tracked:
                at = len(keys) - tracked - 1
                least = int(np.partition(counts, at)[at])
                keys, counts, lost = keys[counts > least], counts[counts > least] - least, lost + least
        yield pa.RecordBatch.from_pydict({"kmer": superkmers.letters(keys, k), "cnt": counts + lost})

    return run


def seeds_approximate(reads: DataFrame, k: int, n: int, tracked: int = 10_000, seq: str = "seq") -> DataFrame:
    """(kmer, cnt): about the n most frequent canonical k-mers of reads or any text, from a bounded summary a task in one pass.

    Summaries are added up.  A count is off by at most the number of all k-mers over ``tracked``,
    and exact for a k-mer that every task held whenever it dropped others.
    """
    nt.check_k(k)
    rows = reads.select(F.col(seq).cast("string").alias("seq")).mapInArrow(_frequent(k, max(int(tracked), int(n), 1)), "kmer string, cnt long")
    return seeds(rows.groupBy("kmer").agg(F.sum("cnt").alias("cnt")), n)


def _cells(width: int, depth: int) -> list[Column]:
    """The cell of a k-mer in each way."""
    if not 1 <= depth <= 4 or width < 1:
        raise ValueError("a sketch has one to four ways of at least one cell")
    return [digest_number(F.col("kmer"), i) % width for i in range(depth)]


def sketch(reads: DataFrame, k: int, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH, seq: str = "seq") -> DataFrame:
    """(way, cell, cnt): a count-min sketch of the canonical k-mers of reads or any text, summed in each task before the shuffle.

    It has at most ``width * depth`` rows whatever the reads; exact counts have one for each distinct k-mer.
    A k-mer that a task repeats is placed once, with its count there.
    """
    cells = [F.struct(F.lit(i).alias("way"), cell.alias("cell")) for i, cell in enumerate(_cells(width, depth))]
    found = superkmers.count_within(reads, k, seq).select("cnt", F.inline(F.array(*cells)))
    return found.groupBy("way", "cell").agg(F.sum("cnt").alias("cnt"))


def sketch_lookup(keys: DataFrame, cells: DataFrame, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH) -> DataFrame:
    """(kmer, cnt) of distinct keys by a sketch of this width and depth: never below the exact count.

    Cells of a sketch of up to SMALL_SKETCH go to the keys; keys go to those of larger ones.
    """
    ways = _cells(width, depth)
    cells = settle(cells)  # read once a way
    found = keys.select("kmer", *[cell.alias(f"cell_{i}") for i, cell in enumerate(ways)])
    for i in range(depth):
        own = cells.filter(F.col("way") == i).select(F.col("cell").alias(f"cell_{i}"), F.col("cnt").alias(f"cnt_{i}"))
        found = found.join(F.broadcast(own) if width <= SMALL_SKETCH else own, f"cell_{i}", "left")
    least = [F.coalesce(f"cnt_{i}", F.lit(0).cast("bigint")) for i in range(depth)]
    return found.select("kmer", (F.least(*least) if depth > 1 else least[0]).alias("cnt"))


def lookup(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of given k-mers, 0 for those not there."""
    return keys.join(counts, "kmer", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("bigint"))


def remove(counts: DataFrame, keys: DataFrame) -> DataFrame:
    return counts.join(keys.select("kmer"), "kmer", "left_anti")


def base_composition(reads: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """How often each base stands in each read."""
    return reads.select(key, *[(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(b), F.lit("")))).cast("bigint").alias(f"n_{b.lower()}") for b in "ACGT"])
