"""Whitening of embeddings on their first principal components, found by contour integration.

Entries become whole numbers, so counts, sums and the covariance are exact: rows are
centred on the rounded mean, products of centred rows are summed as whole numbers, and what
the rounding left is taken off exactly before the one rounding to doubles.  Tasks send a
row for each pair of dimensions, whatever their rows; the matrix, of the dimension's
square, is all that reaches the driver.

There the eigenvalues are taken in intervals.  The numbers of negative pivots of two
shifted matrices (their inertia) tell how many eigenvalues lie between the shifts.  A
quadrature over a circle around an interval, each of its points a solve with the covariance
shifted by a complex number, projects a block of vectors onto the interval's eigenvectors;
Rayleigh-Ritz on the block gives the pairs; this is repeated until residuals are at
rounding level.  The pairs found in an interval must be as many as its inertia says, else
the block grows, so none is missed.

Defined results: rows whose vector is null or holds a null or non-finite entry are
dropped, as are those of another dimension than most have (of equally many, the larger);
so are rows with entries of 2**45 or more.  Repeated rows and null ids are rows
as they come.  Only components of positive variance exist: a table of one vector, or of
equal ones, gives no rows, nor does an empty one.  ``deviation`` is a decimal, null beyond 38 digits;
the query's long is null where it doesn't fit one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import cut

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Points of the quadrature on the upper half of a circle.
POINTS = 8
#: Eigenvalues that one circle takes in at most, where they can be told apart.
PER_CIRCLE = 8
#: Entries from here on are taken for broken: sums of their products would outgrow 38 digits.
LARGEST = 1 << 45
#: Largest whole number whose like doubles add exactly.
EXACT = 1 << 53


# ---- whole numbers


def _numbers(vectors: pa.Array, d: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * flat).astype(np.int64) + OFFSET


def _whole(values) -> pa.Array:
    return pa.array([str(int(v)) for v in values])


def _sums(d: int):
    """Sums of each dimension (i, "sum"), and the number of rows at i = -1."""

    def add(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = _numbers(batch.column("embedding"), d)
            n += len(x)
            if len(x):
                small = int(np.abs(x).max()) < (1 << 62) // len(x)
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, d), pa.int32()), "v": _whole([n, *total])})

    return add


def _gram(x: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, exact: in doubles where each sum fits, else in Python's numbers."""
    largest = int(np.abs(x).max()) if x.size else 0
    rows = EXACT // max(1, largest * largest)
    if not rows:
        x = x.astype(object)
        return x.T @ x
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _products(d: int, pivot: np.ndarray):
    """Sums over rows of products of dimensions i <= j, centred on the rounded mean."""
    upper = np.triu_indices(d)

    def add(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            total += _gram(_numbers(batch.column("embedding"), d) - pivot)
        yield pa.RecordBatch.from_pydict({"i": pa.array(upper[0] * d + upper[1], pa.int32()), "v": _whole(total[upper])})

    return add


def _summed(frame: DataFrame) -> dict[int, int]:
    """One whole number for each i: as many as there are dimensions, or pairs of them."""
    total = frame.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return {r["i"]: int(r["v"]) for r in total.collect()}


# ---- eigenpairs


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v lie below a shift: the negative pivots of v minus the shift."""
    size = max(float(np.abs(v).max()), abs(shift), np.finfo(float).tiny)
    while True:
        a, count, ok = v - shift * np.eye(len(v)), 0, True
        for k in range(len(a)):
            p = a[k, k]
            if abs(p) <= 1e-14 * size:  # an eigenvalue of a leading part: count at a shift beside it
                ok = False
                break
            count += p < 0
            row = a[k, k + 1 :].copy()
            a[k + 1 :, k + 1 :] -= np.outer(row, row / p)
        if ok:
            return int(count)
        shift += 1e-13 * size


def circle(v: np.ndarray, low: float, high: float, y: np.ndarray, points: int = POINTS) -> np.ndarray:
    """The block y projected towards the eigenvectors between low and high."""
    nodes, weights = np.polynomial.legendre.leggauss(points)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for node, weight in zip(nodes, weights, strict=True):
        turn = np.exp(1j * np.pi / 2 * (1 - node))  # over the upper half; the lower one is its mirror
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, y)
        out += weight / 2 * np.real(radius * turn * solved)
    return out


def ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate eigenvalues, falling, and unit vectors within the block's span."""
    q, _ = np.linalg.qr(block)
    e, s = np.linalg.eigh(q.T @ v @ q)
    return e[::-1], (q @ s)[:, ::-1]


def between(v: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator, most_rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between low and high, by falling eigenvalue."""
    d, size = len(v), max(float(np.abs(v).max()), np.finfo(float).tiny)
    width = min(d, count + count // 2 + 2)
    while True:
        block, last = rng.standard_normal((d, width)), np.inf
        for _ in range(most_rounds):
            e, x = ritz(v, circle(v, low, high, block))
            inside = (e > low) & (e < high)
            rest = float(np.abs(v @ x[:, inside] - x[:, inside] * e[inside]).max(initial=0)) / size
            if inside.sum() == count and rest < 1e-13 * d and rest >= last / 4:
                return e[inside], x[:, inside]
            last, block = rest, x
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high}, {int(inside.sum())} found")
        width = min(d, 2 * width)


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count) from the top down that hold the k largest eigenvalues; those too close to part stay together."""
    d = len(v)
    top = float(np.abs(v).sum(axis=1).max())
    high, out, held = top * (1 + 1e-9) + np.finfo(float).tiny, [], 0
    above = d  # eigenvalues below high
    while held < k and above:
        want = min(PER_CIRCLE, k - held)
        low, to, best = -1e-9 * top, high, None
        while True:  # the highest shift with ``want`` or more above it, or one with just as many
            mid = (low + to) / 2
            if not low < mid < to or to - low < 1e-13 * top:
                break
            n = above - below(v, mid)
            if n == want:
                best = mid
                break
            low, to = (mid, to) if n > want else (low, mid)
        at = low if best is None else _gap(v, best, want, above, low, to)
        n = above - below(v, at)
        out.append((at, high, n))
        held, above, high = held + n, above - n, at
    return out


def _gap(v: np.ndarray, at: float, want: int, above: int, low: float, to: float) -> float:
    """The middle of the gap around a shift with ``want`` eigenvalues between it and the interval's top."""
    a, b = low, at
    for _ in range(20):  # the gap's lower end
        mid = (a + b) / 2
        a, b = (a, mid) if above - below(v, mid) == want else (mid, b)
    bottom = b
    a, b = at, to
    for _ in range(20):  # and its upper
        mid = (a + b) / 2
        a, b = (mid, b) if above - below(v, mid) == want else (a, mid)
    return (bottom + a) / 2


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above rounding level, falling, and their unit vectors as columns."""
    size = float(np.abs(v).max()) if v.size else 0.0
    if not size:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled, rng = v / size, np.random.default_rng(1)
    parts = [between(scaled, low, high, n, rng) for low, high, n in intervals(scaled, min(k, len(v))) if n]
    e, x = ritz(scaled, np.concatenate([p[1] for p in parts], axis=1))
    e, x = e[:k], x[:, :k]
    real = e > len(v) * np.finfo(float).eps * e[0]
    return e[real] * size, x[:, real]


# ---- the operator


def _rows(n: int, total: list[int], pivot: np.ndarray, vectors: np.ndarray, values: np.ndarray, d: int):
    """Each row's deviation and its whitened coordinates."""
    rest = [t - n * int(p) for t, p in zip(total, pivot, strict=True)]  # sums of what is centred on the rounded mean
    shift = np.array([r / n for r in rest])
    onto = vectors / np.sqrt(values)
    bound = max(map(abs, rest), default=0)

    def each(batches):
        for batch in batches:
            c = _numbers(batch.column("embedding"), d) - pivot
            most = n * (int(np.abs(c).max()) if c.size else 0) + bound
            if most < 1 << 31 and most * most * d < 1 << 63:
                away = n * c - np.array(rest, np.int64)
            else:
                away = n * c.astype(object) - np.array(rest, object)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column("vec_id"), "deviation": _whole((away * away).sum(axis=1)), "w": pa.array(list((c - shift) @ onto), pa.list_(pa.float64()))}
            )

    return each


def _usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows whose entries are all finite numbers that whole numbers can hold."""
    picked = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fits = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(LARGEST)), F.lit(False)))
    return picked.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fits)


def whitened(embeddings: DataFrame, *, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    spark = embeddings.sparkSession
    none = spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    usable = _usable(embeddings)
    most = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return none
    d = most["d"]
    fit = usable.filter(F.size("embedding") == d)
    sums = _summed(fit.mapInArrow(_sums(d), "i int, v string"))
    n, total = sums[-1], [sums[i] for i in range(d)]
    pivot = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
    products = _summed(fit.mapInArrow(_products(d, pivot), "i int, v string"))
    rest = [t - n * int(p) for t, p in zip(total, pivot, strict=True)]
    v = np.zeros((d, d))
    for at, sum_ in products.items():
        i, j = divmod(at, d)
        v[i, j] = v[j, i] = (n * sum_ - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    values, vectors = components(v, k)
    if not len(values):
        return none
    m = len(values)
    rows = cut(fit.mapInArrow(_rows(n, total, pivot, vectors, values, d), "vec_id long, deviation string, w array<double>"))
    w = [F.col("w")[i] for i in range(m)]
    means = rows.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(w)]).first()
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    found = rows.agg(*[F.avg((w[i] - means[i]) * (w[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = reduce(max, (abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs), 0.0)
    trace = float(np.trace(v))
    spread = F.array(*[F.struct(F.lit(i + 1).alias("component"), w[i].alias("whitened"), F.lit(float(values[i]) / trace).alias("explained")) for i in range(m)])
    return rows.select("vec_id", "deviation", F.inline(spread)).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), "whitened", "explained", F.lit(float(error)).alias("identity_error")
    )


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
