import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmers
from strandlake.operators import superkmers as sk

TURNED = str.maketrans("ACGT", "TGCA")


def brute(reads, k, canonical=True):
    out = Counter()
    for read in reads:
        read = "".join(c if c in "ACGT" else "A" for c in (read or "").upper().encode().decode("latin-1"))
        for i in range(len(read) - k + 1):
            w = read[i : i + k]
            out[min(w, w[::-1].translate(TURNED)) if canonical else w] += 1
    return out


@pytest.fixture(scope="module")
def reads():
    rng = random.Random(4)
    out = ["".join(rng.choice("ACGT" if rng.random() < 0.6 else "A") for _ in range(rng.randint(0, 120))) for _ in range(80)]
    return [*out, "A" * 150, "ACGT" * 30, "", None, "acgtnNé中 tta\nggc" * 3, out[0], out[1][::-1].translate(TURNED)]


@pytest.mark.parametrize("k", [1, 2, 5, 11, 15, 16, 17, 24, 25, 31, 32])
@pytest.mark.parametrize("sizes", [(40, 10), (200, 300), (1 << 20, 1 << 21)])
def test_counts_at_every_size_of_stretches_and_held_rows(reads, k, sizes, monkeypatch):
    monkeypatch.setattr(sk, "STRETCH", sizes[0])
    monkeypatch.setattr(sk, "HELD", sizes[1])
    batch = pa.RecordBatch.from_pydict({"seq": pa.array(reads)})
    rows = pa.Table.from_batches(list(sk._cut(k)([batch, batch.slice(3, 0), batch.slice(5)]))).sort_by("bin")
    for canonical in (True, False):
        got = [(a, n) for x in sk._count(k, canonical)(rows.to_batches(max_chunksize=7)) for a, n in zip(x["kmer"].to_pylist(), x["cnt"].to_pylist(), strict=True)]
        assert len(got) == len(dict(got))
        assert dict(got) == brute(reads + reads[5:], k, canonical)


def test_a_row_holds_most_k_mers_where_neighbours_share_their_minimiser():
    codes = np.random.default_rng(1).integers(0, 4, 100_000).astype(np.uint8)
    minimiser, _, tail = sk.super_kmers(codes, np.zeros(1, np.int64), 25)
    held = 1 + (tail & 15)
    assert held.sum() == 100_000 - 24 and held.max() <= sk.MOST and held.mean() > 4
    assert len(minimiser) == len(tail)


def test_packed_reverse_complements():
    rng = random.Random(2)
    for k in (1, 7, 16, 31, 32):
        words = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(50)]
        codes = sk.CODES[np.frombuffer("".join(words).encode(), np.uint8)]
        packed = sk.windows(codes, k)[::k]
        assert sk.letters(packed, k).to_pylist() == words
        assert sk.letters(sk.reversed_complement(packed, k), k).to_pylist() == [w[::-1].translate(TURNED) for w in words]


def test_counting_frames(spark, reads):
    frame = spark.createDataFrame([(r, 1) for r in reads], "seq string, bin int").repartition(3)
    for k in (11, 25):
        assert {r.kmer: r.cnt for r in kmers.count_canonical(frame, k).collect()} == brute(reads, k)
        assert {r.kmer: r.cnt for r in kmers.count(frame, k).collect()} == brute(reads, k, False)
    assert {r.kmer: r.cnt for r in kmers.count_canonical(frame, 11, saturate=3).collect()} == {w: min(n, 3) for w, n in brute(reads, 11).items()}
    assert kmers.count_canonical(frame.limit(0), 11).collect() == []
    with pytest.raises(ValueError, match="from 1 to 32"):
        kmers.count_canonical(frame, 33)


def test_one_exchange_and_no_other_sort(spark, reads):
    frame = spark.createDataFrame([(r,) for r in reads], "seq string")
    plan = kmers.count_canonical(frame, 25)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1 and plan.count("MapInArrow") == 2


def test_a_hot_k_mer_is_a_row_a_task(spark):
    frame = spark.range(0, 400, 1, 8).select(F.lit("A" * 5000).alias("seq"))
    sent = frame.mapInArrow(sk._cut(25), sk.ROWS)
    assert sent.count() <= 8 * sk.MOST
    assert [tuple(r) for r in kmers.count_canonical(frame, 25).collect()] == [("A" * 25, 400 * 4976)]


def test_a_read_of_a_hundred_million_bases(spark):
    rng = random.Random(6)
    unit = "".join(rng.choice("ACGT") for _ in range(10_000))
    frame = spark.range(1).select(F.expr(f"repeat('{unit}', 10000)").alias("seq"))
    found = kmers.count_canonical(frame, 25).agg(F.count("*"), F.sum("cnt"), F.max("cnt")).first()
    assert tuple(found) == (10_000, 100_000_000 - 24, 10_000)


def test_a_task_sends_whole_kmers_once_and_in_small_batches(reads, monkeypatch):
    monkeypatch.setattr(sk, "SENT", 50)
    batch = pa.RecordBatch.from_pydict({"seq": pa.array(reads)})
    for k in (11, 15):
        sent = list(sk._cut(k)([batch, batch]))
        rows = pa.Table.from_batches(sent)
        assert max(x.num_rows for x in sent) <= 50 < rows.num_rows
        assert set(rows["tail"].to_pylist()) == {0} and len(set(rows["head"].to_pylist())) == rows.num_rows == len(brute(reads, k, False))
    assert max(x.num_rows for x in sk._cut(25)([batch, batch])) <= 50
