import random
from collections import Counter

import numpy as np
import pytest

from strandlake.operators import seedcache
from strandlake.operators.seedcache import SeedCache

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def brute(reads, k):
    out = Counter()
    for read in reads:
        read = "".join(c if c in "ACGT" else "A" for c in (read or "").upper())
        for i in range(len(read) - k + 1):
            w = read[i : i + k]
            out[min(w, w[::-1].translate(COMPLEMENT))] += 1
    return out


def top(counts, n):
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.fixture(scope="module")
def texts():
    """Reads with a few passages that recur among many that don't, nulls and short ones."""
    rng = random.Random(2)
    often = ["".join(rng.choices("ACGT", k=60)) for _ in range(4)]
    out = [None, "", "acg", "ACGTNNNNNACGT"]
    for i in range(600):
        read = "".join(rng.choices("ACGT", k=rng.randint(30, 400)))
        out.append(read + often[i % 4] + read[:9] if i % (2 + i % 4) == 0 else read)
    return out


def test_a_table_is_bounded_never_above_exact_and_the_same_again():
    rng = np.random.default_rng(1)
    weights = 1 / np.arange(1, 20_001) ** 1.1
    draws = rng.choice(20_000, 400_000, p=weights / weights.sum()).astype(np.uint64) * np.uint64(7919)
    exact = Counter(draws.tolist())
    tables = []
    for _ in "12":
        cache = SeedCache(2000, seed=5)
        for part in np.array_split(draws, 40):
            cache.add(*(x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint64, np.int64), strict=True)))
        tables.append(cache.rows())
    keys, counts = tables[0]
    assert all((a == b).all() for a, b in zip(*tables, strict=True)) and len(keys) <= 2000
    assert all(0 < c <= exact[x] for x, c in zip(keys.tolist(), counts.tolist(), strict=True))
    held = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert sum(x in held for x, _ in exact.most_common(50)) >= 48
    other = SeedCache(2000, seed=6)
    other.add(*(x.astype(t) for x, t in zip(np.unique(draws, return_counts=True), (np.uint64, np.int64), strict=True)))
    assert len(other.rows()[0]) <= 2000 and set(other.rows()[0].tolist()) != set(keys.tolist())


def test_a_resident_wears_out_with_the_chance_stated():
    """One cell: a resident of count 10 against n others is left as draws one by one leave it, on average."""
    rng, n, runs = random.Random(3), 6, 4000
    slow = 0
    for _ in range(runs):
        count = 10
        for _ in range(n):
            count -= rng.random() < seedcache.DECAY**count
        slow += count
    got = 0
    for seed in range(runs):
        cache = SeedCache(1, seed)
        cache.add(np.array([1], np.uint64), np.array([10]))
        cache.add(np.array([2], np.uint64), np.array([n]))
        got += int(cache.counts[0])
    assert abs(slow - got) / runs < 0.1


@pytest.mark.parametrize("k", [11, 25, 32])
def test_recounted_seeds_equal_exact_ones(spark, texts, k):
    frame = spark.createDataFrame([(t, 1) for t in texts], "seq string, packed int").repartition(5)
    exact = brute(texts, k)
    got = [tuple(r) for r in seedcache.seeds_recounted(frame, k, 20, cells=4096).collect()]
    assert got == top(exact, 20)
    some = seedcache.seeds_decaying(frame, k, 20, cells=4096).collect()
    least = top(exact, 20)[-1][1]
    assert all(r.cnt <= exact[r.kmer] for r in some) and sum(exact[r.kmer] >= least for r in some) >= 18


def test_empty_tables(spark):
    none = spark.createDataFrame([(None,), ("ACG",)], "seq string")
    assert seedcache.seeds_recounted(none, 25, 20).count() == 0 and seedcache.seeds_decaying(none.limit(0), 25, 20).count() == 0
    with pytest.raises(ValueError):
        SeedCache(0)
