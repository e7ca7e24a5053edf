import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import curve, prefix


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize(("blocks", "fan"), [(1, 4), (4, 4), (5, 4), (70, 4), (70, 4096)])
def test_totals_ahead_in_levels(spark, blocks, fan, backwards):
    rng = random.Random(blocks)
    totals = {b: rng.randint(0, 9) for b in range(blocks) if rng.random() < 0.8 or b == blocks - 1}
    frame = spark.createDataFrame(list(totals.items()), "block long, total long")
    want = {b: sum(n for c, n in totals.items() if (c > b if backwards else c < b)) for b in totals}
    assert {r.block: r.ahead for r in prefix.ahead(frame, blocks, fan, backwards).collect()} == want


@pytest.mark.parametrize("backwards", [False, True])
def test_running_sums_over_blocks_of_four(spark, backwards):
    rng = random.Random(9)
    values = [rng.randint(-5, 9) for _ in range(333)]
    frame = spark.createDataFrame(list(enumerate(values)), "at long, x long").filter("at <> 100").repartition(5)
    got = {r.at: r.s for r in prefix.running(frame, "at", "x", 333, "s", size=4, fan=4, backwards=backwards).collect()}
    values[100] = 0
    assert got == {i: sum(values[i:] if backwards else values[: i + 1]) for i in range(333) if i != 100}


def test_nothing_is_collected(spark):
    frame = spark.range(1000).select(F.col("id").alias("at"), F.lit(1).alias("x"))
    plan = prefix.running(frame, "at", "x", 1000, size=4, fan=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    kept = set()
    for u, v, pos in sorted(edges, key=lambda e: -e[2]):
        if find(u) != find(v):
            root[find(u)] = find(v)
            kept.add(pos)
    return kept


@pytest.mark.parametrize("how", [{}, {"range_edges": 7, "fan": 2}, {"range_edges": 50, "fan": 3, "task_vertices": 30}, {"range_edges": 1000, "task_vertices": 1}])
@pytest.mark.parametrize("words", [False, True])
def test_forest_equals_a_scan_from_the_last_edge_back(spark, how, words):
    rng = random.Random(str(how))
    name = (lambda x: f"v{x}") if words else (lambda x: x)
    edges = [(name(rng.randrange(90)), name(rng.randrange(90)), p) for p in rng.sample(range(400), 300)]
    frame = spark.createDataFrame(edges, f"u {'string' if words else 'long'}, v {'string' if words else 'long'}, pos long").repartition(4)
    got = [r.pos for r in curve.forest(frame, **how).collect()]
    assert len(got) == len(set(got))
    assert set(got) == kruskal(edges)


def test_forest_of_no_edges(spark):
    frame = spark.createDataFrame([(1, 1, 0)], "u long, v long, pos long")
    assert curve.forest(frame).collect() == [] and curve.forest(frame.limit(0)).collect() == []


@pytest.mark.parametrize("step", [1, 7])
def test_curve_equals_a_recount_for_each_prefix(spark, step):
    rng = random.Random(step)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randint(1, 6)) for _ in range(120)]
    edges += edges[:5]
    order = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    ends = {x for e in edges for x in e[:2]}

    def recount(i):
        return len(ends) - len(kruskal([(u, v, p) for p, (u, v, _) in enumerate(order) if p >= i]))

    frame = spark.createDataFrame(edges, "u long, v long, w long")
    got = {r.pos: r.components for r in curve.expansion_curve(frame, step).collect()}
    assert got == {i: recount(i) for i in range(0, len(edges), step)}
