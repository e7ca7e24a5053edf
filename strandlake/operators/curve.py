"""The component-expansion curve: how many components are left as the heaviest edges go.

Edges stand in order of falling weight.  Scanned from the last back, those that join two
components form a spanning forest, and after removing the first i edges there are
n minus the forest edges from i on.  An edge that isn't in the forest of some of the edges
isn't in that of all: so ranges of positions are cut down to their forests, some of which
are joined and cut down again, up a tree.  A task holds the forests of ``FAN`` ranges at
most, each smaller than the number of vertices; where there are more vertices than
a task should hold, rounds that contract every vertex into a neighbour come before.  The
counts are running sums over positions, so nothing is recomputed for each prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators import prefix
from strandlake.operators.components import connected_components, settle
from strandlake.operators.graph import dense_ids
from strandlake.operators.sampling import draw

#: Edges of the ranges that are cut down first.
RANGE = 1 << 20
#: Forests that one task joins.
FAN = 8
#: Vertices whose forests a task may hold; more are contracted first.
TASK_VERTICES = 1 << 20


def ordered(edge_frame: DataFrame, u: str = "u", v: str = "v", w: str = "w", seed: int | None = None) -> DataFrame:
    """(u, v, pos): positions from 0 by falling weight; ties by ends, or shuffled by a seeded draw."""
    picked = edge_frame.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).cast("bigint").alias("w"))
    tie: Column = F.lit(0).cast("bigint") if seed is None else draw(seed, "u", "v")
    copy = F.row_number().over(Window.partitionBy("u", "v", "w").orderBy("w"))  # edges may stand more than once
    keyed = picked.withColumn("copy", copy).withColumn("key", F.struct((-F.col("w")).alias("w"), tie.alias("tie"), "u", "v", "copy"))
    return dense_ids(keyed, "key", first=0).select("u", "v", F.col("id").alias("pos"))


def last_forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which edges, by index, a scan from the last back would join components with.

    Each component takes its last edge that leads out, all at once, and is joined with the one there; until no edge leads out.
    """
    n = int(max(u.max(), v.max())) + 1 if len(u) else 0
    at, taken = np.arange(len(u)), np.zeros(len(u), bool)
    while True:
        out = u != v
        u, v, at = u[out], v[out], at[out]
        if not len(u):
            return np.flatnonzero(taken)
        best = np.full(n, -1)
        order = np.arange(len(u))
        np.maximum.at(best, u, order)
        np.maximum.at(best, v, order)
        own = np.flatnonzero(best >= 0)
        taken[at[best[own]]] = True
        to = np.arange(n)
        to[own] = u[best[own]] + v[best[own]] - own  # the edge's other end
        mutual = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[mutual] = np.flatnonzero(mutual)  # two that chose one edge: the lesser stays
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        u, v = to[u], to[v]


def _cut_down(table: pa.Table) -> pa.Table:
    """The forest of a table of edges (u, v, pos, part)."""
    table = table.sort_by("pos")
    ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks], table.schema.field("u").type).combine_chunks().dictionary_encode()
    number = ends.indices.to_numpy().astype(np.int64)
    kept = last_forest(number[: table.num_rows], number[table.num_rows :])
    return table.take(pa.array(kept))


def _contracted(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges between what joining each vertex with its last edge's other end leaves, and the positions of those edges."""
    # parallel edges: only the last can be in the forest
    now = settle(now.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("pos").alias("pos")))
    ends = now.select(F.explode(F.array("u", "v")).alias("x"), "pos")
    best = settle(ends.groupBy("x").agg(F.max("pos").alias("pos")).select("pos").distinct())
    joined = settle(connected_components(now.join(best, "pos", "left_semi"), "u", "v"))
    a = joined.select(F.col("vertex").alias("u"), F.col("component").alias("cu"))
    b = joined.select(F.col("vertex").alias("v"), F.col("component").alias("cv"))
    left = now.join(a, "u").join(b, "v").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"), "pos")
    return settle(left), best


def forest(placed: DataFrame, places: int | None = None, *, task_vertices: int = TASK_VERTICES, range_edges: int = RANGE, fan: int = FAN) -> DataFrame:
    """(pos) of the edges (u, v, pos) that a scan from the highest position back would join components with.  ``places``: the positions lie below."""
    if places is None:
        places = (placed.agg(F.max("pos")).first()[0] or 0) + 1
    now, found = placed.select("u", "v", F.col("pos").cast("bigint").alias("pos")).filter("u <> v"), None
    while now.select(F.explode(F.array("u", "v")).alias("x")).distinct().count() > task_vertices:
        now, best = _contracted(now)
        found = best if found is None else found.unionAll(best)
    now = now.withColumn("part", F.floor(F.col("pos") / range_edges))
    parts = -(-places // range_edges)
    while True:
        now = now.groupBy("part").applyInArrow(_cut_down, now.schema)
        if parts <= 1:
            break
        parts = -(-parts // fan)
        now = now.withColumn("part", F.floor(F.col("part") / fan))
    last = now.select("pos")
    return last if found is None else found.unionAll(last)


def expansion_curve(edge_frame: DataFrame, step: int = 1, n_vertices: int | None = None, **columns) -> DataFrame:
    """(pos, components) for pos = 0, step, 2*step, ...: components once the pos heaviest edges are gone.

    ``n_vertices`` counts vertices on no edge too; without it there are those on edges.
    """
    if step < 1:
        raise ValueError("step must be 1 or more")
    placed = settle(ordered(edge_frame, **columns))
    places = placed.count()
    n = n_vertices if n_vertices is not None else placed.select(F.explode(F.array("u", "v")).alias("x")).distinct().count()
    kept = forest(placed, places).select("pos", F.lit(1).alias("f"))
    marks = placed.select("pos").join(kept, "pos", "left").select("pos", F.coalesce("f", F.lit(0)).alias("f"))
    summed = prefix.running(marks, "pos", "f", places, backwards=True)
    return summed.select("pos", (F.lit(n) - F.col("running")).cast("bigint").alias("components")).filter(F.col("pos") % step == 0)
