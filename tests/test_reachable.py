import random

import pytest

from strandlake.operators import graph, kmers
from strandlake.operators.components import settle


def spread(edges, seeds):
    turned = str.maketrans("ACGT", "TGCA")
    canon = lambda x: min(x, x[::-1].translate(turned))
    near = {}
    for u, v, _ in edges:
        near.setdefault(canon(u), set()).add(canon(v))
        near.setdefault(canon(v), set()).add(canon(u))
    seen, stack = set(), [s for s in seeds if s in near]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += near[x]
    return seen, sorted(e for e in edges if canon(e[0]) in seen)


@pytest.fixture(scope="module")
def parts(spark):
    """Several separate stretches, one of them long, as counted k-mers and edges."""
    rng = random.Random(2)
    reads = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (40, 24, 60, 12, 30)]
    counts = settle(kmers.count_canonical(spark.createDataFrame([(r,) for r in reads], "seq string"), 9))
    edges = settle(graph.edges(counts, 9))
    return counts, edges, [tuple(r) for r in edges.collect()]


@pytest.mark.parametrize(("how", "start"), [({}, 0), ({"share": 1.0, "rounds": 100}, 5), ({"rounds": 3, "share": 1.0}, -1)])
def test_equals_a_walk_from_the_seeds(spark, parts, how, start):
    counts, edges, all_edges = parts
    seeds = [sorted(r.kmer for r in counts.collect())[start], "AAAAAAAAA"]
    want, inside = spread(all_edges, seeds)
    frame = spark.createDataFrame([(s,) for s in seeds], "kmer string")
    got = [r.kmer for r in graph.reached(edges, frame, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(tuple(r) for r in graph.reachable(edges, frame, **how).collect()) == inside


def test_no_seed_on_an_edge(spark, parts):
    frame = spark.createDataFrame([("AAAAAAAAA",)], "kmer string")
    assert graph.reached(parts[1], frame).collect() == [] and graph.reachable(parts[1], frame.limit(0)).collect() == []
