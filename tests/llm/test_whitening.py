import math
from fractions import Fraction

import numpy as np
import pytest

from strandlake.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def spread(rng, n, d):
    return (rng.standard_normal((n, d)) * (0.05 + rng.random(d)) + rng.standard_normal(d)).astype(np.float32)


def brute(vectors, k=wh.COMPONENTS):
    x = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    away = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return away, c @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize(("n", "d"), [(400, 16), (60, 5), (300, 64)])
def test_equals_a_dense_decomposition(spark, n, d):
    vectors = spread(np.random.default_rng(n), n, d)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    rows = wh.whitened(frame).collect()
    away, w, explained = brute(vectors)
    m = min(8, d)
    assert len(rows) == n * m
    got = np.zeros((n, m))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == away[r.vec_id] and abs(r.explained - explained[r.component - 1]) < 1e-9
        assert r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * w).sum(axis=0)) - w).max() < 1e-7


def test_defined_results(spark, none):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, [0.5, -2.0])]
    bad = [(5, None), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, []), (10, [1.0, 2.0, 3.0]), (11, [1e30, 0.0])]
    frame = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "1 as component", "'x' as w", "2 as i", "3 as v")
    rows = wh.whitened(frame).collect()
    assert sorted(((r.vec_id is None, r.vec_id), r.component) for r in rows if r.vec_id is not None) == [((False, 1), 1)] * 2 + [((False, 1), 2)] * 2 + [((False, 4), 1), ((False, 4), 2)]
    assert sum(r.vec_id is None for r in rows) == 2 and {r.n for r in rows} == {4}
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(3, None)]):
        empty = wh.whitened(spark.createDataFrame(data, SCHEMA))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_flat_dimension_is_no_component(spark):
    frame = spark.createDataFrame([(i, [float(i), 7.0, float(i % 3)]) for i in range(20)], SCHEMA)
    assert {r.component for r in wh.whitened(frame).collect()} == {1, 2}


@pytest.mark.parametrize("largest", [10, 1 << 20, 1 << 25, 1 << 29, 1 << 40])
def test_products_are_exact(largest):
    x = np.random.default_rng(2).integers(-largest, largest, (70, 4))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(4)] for i in range(4)]
    assert wh._gram(x).tolist() == want


@pytest.mark.parametrize("values", [[5, 5, 5, *[4] * 10, 1, *[0] * 16], [1] * 30, [1e6, *[1] * 29], [3, 2, *[0] * 28], [1 + 1e-12 * i for i in range(30)], [2.0**-i for i in range(30)]])
def test_eigenpairs_of_close_and_equal_values(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((30, 30)))
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, x = wh.components(v, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > 0]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-10, atol=1e-15 * 30 * want[0])  # v itself is rounded that much
    assert np.abs(v @ x - x * e).max() < 1e-11 * np.abs(v).max() and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.standard_normal((12, 12))
        v = a + a.T
        e = np.linalg.eigvalsh(v)
        shift = float(rng.uniform(e[0] - 1, e[-1] + 1))
        assert wh.below(v, shift) == (e < shift).sum()
    assert wh.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_intervals_hold_the_largest_and_part_at_gaps():
    rng = np.random.default_rng(6)
    values = np.sort(rng.random(40))[::-1]
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    v = (q * values) @ q.T
    found = wh.intervals((v + v.T) / 2, 20)
    assert sum(n for *_, n in found) == 20 and [n for *_, n in found] == [8, 8, 4]
    for low, high, n in found:
        assert ((values > low) & (values < high)).sum() == n


def test_query_gives_longs(spark, tmp_path):
    vectors = spread(np.random.default_rng(9), 50, 6)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = wh.op13_embedding_whitening(spark, str(tmp_path))
    assert dict(found.dtypes)["deviation"] == "bigint"
    away, _, _ = brute(vectors)
    x = [[math.floor(Fraction(1024) * Fraction(float(c))) + 100_000 for c in v] for v in vectors]
    s = [sum(col) for col in zip(*x, strict=True)]
    assert away[0] == sum((50 * a - b) ** 2 for a, b in zip(x[0], s, strict=True))
    assert {(r.vec_id, r.deviation) for r in found.collect()} == set(enumerate(away))
