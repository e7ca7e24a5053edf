import random
from collections import Counter

import pytest

from strandlake.operators import curve, graph, kmers, superkmers
from strandlake.operators.components import connected_components
from strandlake.plans.assembly import assemble
from strandlake.sources import matrices

GOLDEN = ["ACGTTGCA", "TTGCAAC", "AAAAA"]
CELLS = """1 1 3   1 1 3   1 2 2   2 3 2   3 5 2   3 5 2   4 1 3   4 2 2   5 7 2
6 4 3   7 9 3   7 10 3  8 6 4   8 6 4   9 8 4   10 9 3  10 10 3 10 10 3""".split()
CELLS = sorted(tuple(map(int, CELLS[i : i + 3])) for i in range(0, len(CELLS), 3))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(s):
    return min(s, rc(s))


def reads_of(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def counts_of(seqs, k):
    return Counter(canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1))


def traversed(seqs, k):
    """The edges as a walk that deletes each k-mer once visited would list them."""
    left, out = dict(counts_of(seqs, k)), []
    stack = []
    for seed in sorted(left):
        stack.append(seed)
        while stack:
            x = stack.pop()
            if x not in left:
                continue
            for u in (x, rc(x)):
                for b in "ACGT":
                    v = u[1:] + b
                    if canon(v) in left:
                        out.append((u, v, left[canon(v)]))
                        stack.append(canon(v))
            for v in (x, rc(x)):
                for b in "ACGT":
                    u = b + v[:-1]
                    if canon(u) in left:
                        out.append((u, v, left[x]))
                        stack.append(canon(u))
            del left[x]
    return out


def test_golden_counts(spark):
    got = {r.kmer: r.cnt for r in kmers.count_canonical(reads_of(spark, GOLDEN), 3).collect()}
    assert got == {"AAA": 3, "AAC": 2, "ACG": 2, "CAA": 3, "GCA": 4}


def test_golden_matrix_and_pointers(spark):
    found = assemble(reads_of(spark, GOLDEN), 3, multigraph=True)
    assert [r.kmer for r in found.ids.orderBy("id").collect()] == "AAA AAC ACG CAA CGT GCA GTT TGC TTG TTT".split()
    assert sorted(map(tuple, found.matrix.collect())) == CELLS
    got = [r.ptr for r in matrices.column_pointers(found.matrix, 10).orderBy("col").collect()]
    assert got == [1, 4, 6, 7, 8, 10, 12, 13, 14, 16, 19]
    assert [tuple(r) for r in graph.component_sizes(found.edges).collect()] == [(0, 10)]
    got = [r.components for r in curve.expansion_curve(found.matrix, u="row", v="col", w="val").orderBy("pos").collect()]
    assert got == [1, 1, 1, 2, 2, 2, 2, 3, 3, 4, 5, 5, 5, 6, 7, 7, 8, 9]


@pytest.mark.parametrize("k", [3, 4, 5])
def test_edges_are_those_of_a_traversal(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(1, 20))) for _ in range(12)]
    counts = kmers.count_canonical(reads_of(spark, seqs), k)
    want = traversed(seqs, k)
    assert {tuple(r) for r in graph.edges(counts, k).collect()} == set(want)
    if k % 2:
        assert Counter(tuple(r) for r in graph.edges(counts, k, multigraph=True).collect()) == Counter(want)
    assert graph.unmirrored(graph.edges(counts, k)).count() == 0


def test_multigraph_needs_odd_k(spark):
    with pytest.raises(ValueError):
        graph.edges(kmers.count_canonical(reads_of(spark, GOLDEN), 4), 4, multigraph=True)


def test_counts_add_up_and_short_reads_have_none(spark):
    reads = reads_of(spark, [*GOLDEN, "AC", ""])
    assert kmers.kmers(reads, 3).count() == 6 + 5 + 3
    assert kmers.count_canonical(reads_of(spark, ["AC"]), 3).count() == 0
    top = kmers.count_canonical(reads_of(spark, ["A" * 2000]), 3, saturate=1023).first()
    assert (top.kmer, top.cnt) == ("AAA", 1023)


def test_seeds_lookup_remove_spectrum(spark):
    counts = kmers.count_canonical(reads_of(spark, GOLDEN), 3)
    assert [r.kmer for r in kmers.seeds(counts, 2).collect()] == ["GCA", "AAA"]
    keys = spark.createDataFrame([("AAA",), ("CCC",)], ["kmer"])
    assert {tuple(r) for r in kmers.lookup(keys, counts).collect()} == {("AAA", 3), ("CCC", 0)}
    assert kmers.remove(counts, keys).count() == 4
    assert {tuple(r) for r in kmers.spectrum(counts).collect()} == {(2, 2), (3, 2), (4, 1)}


def test_reachable_keeps_whole_components(spark):
    seqs = ["AAACCCAAACC", "GAGTCTGAGTC"]
    counts = kmers.count_canonical(reads_of(spark, seqs), 7)
    edges = graph.edges(counts, 7)
    seed = spark.createDataFrame([(canon("AAACCCA"),)], ["kmer"])
    got = {tuple(r) for r in graph.reachable(edges, seed).collect()}
    own = {tuple(r) for r in graph.edges(kmers.count_canonical(reads_of(spark, seqs[:1]), 7), 7).collect()}
    assert got == own != {tuple(r) for r in edges.collect()}


def test_isolated_and_degrees(spark):
    counts = kmers.count_canonical(reads_of(spark, ["ACCTG", "AAAAAA"]), 5)
    edges = graph.edges(counts, 5)
    assert [r.kmer for r in graph.isolated(counts, edges).collect()] == [canon("ACCTG")]
    got = {r.kmer: (r.in_degree, r.out_degree, r.in_weight, r.out_weight) for r in graph.degrees(edges).collect()}
    assert got == {"AAAAA": (1, 1, 2, 2), "TTTTT": (1, 1, 2, 2)}


def brute_components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loops", "empty"])
def test_components(spark, kind):
    rng = random.Random(5)
    pairs = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "chain": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 40)], "loops": [(1, 1), (2, 3), (3, 3), (2, 3)], "empty": [],
    }[kind]
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {r.vertex: r.component for r in connected_components(frame).collect()} == brute_components(pairs)


@pytest.mark.parametrize("seed", [0, 1])
def test_curve_against_recounting(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12), rng.randrange(5)) for _ in range(25)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint, w bigint")
    order = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    vertices = {x for e in edges for x in e[:2]}
    want = {i: len({*brute_components([e[:2] for e in order[i:]] + [(x, x) for x in vertices]).values()}) for i in range(0, 25, 3)}
    assert {r.pos: r.components for r in curve.expansion_curve(frame, 3).collect()} == want
    with pytest.raises(ValueError):
        curve.expansion_curve(frame, 0)


@pytest.mark.parametrize("stretch", [1, 2, 7])
def test_windows_of_cut_reads(spark, stretch):
    seqs = ["ACGTTGCAACGTAC", "ACG", "AC", "TTTTT", "ACGTTGC"]
    got = sorted(r.kmer for r in kmers.kmers(reads_of(spark, seqs), 3, stretch=stretch).collect())
    assert got == sorted(s[i : i + 3] for s in seqs for i in range(len(s) - 2))


def test_sketch_is_never_below_and_exact_where_cells_are_many(spark):
    reads = reads_of(spark, GOLDEN * 3)
    exact = {r.kmer: r.cnt for r in kmers.count_canonical(reads, 3).collect()}
    keys = spark.createDataFrame([(x,) for x in [*exact, "GGG"]], "kmer string")
    for width, depth in ((1 << 16, 4), (2, 3), (1, 1)):
        cells = kmers.sketch(reads, 3, width, depth)
        assert cells.count() <= width * depth
        got = {r.kmer: r.cnt for r in kmers.sketch_lookup(keys, cells, width, depth).collect()}
        assert len(got) == len(exact) + 1 and all(got[x] >= n for x, n in exact.items())
        if width > 2:
            assert got == exact | {"GGG": 0}
    with pytest.raises(ValueError):
        kmers.sketch(reads, 3, 10, 5)


def test_component_count_with_vertices_on_no_edge(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 8)], "u bigint, v bigint")
    assert graph.component_count(edges).first().components == 3
    assert graph.component_count(edges, spark.createDataFrame([(10,)], "n bigint")).first().components == 3 + 10 - 6
    assert graph.component_count(edges.limit(0), spark.createDataFrame([(4,)], "n bigint")).first().components == 4


def test_sketches_and_approximate_seeds_take_any_text_and_place_a_tasks_kmer_once(spark):
    texts = ["acgttgcaN acg", "ACGTTGCA", None, "", "AC"] + ["ttttt acgtacgt"] * 40
    raw = spark.createDataFrame([(x,) for x in texts], "seq string").coalesce(1)
    exact = {r.kmer: r.cnt for r in kmers.count_canonical(raw, 3).collect()}
    assert {r.kmer: r.cnt for r in superkmers.count_within(raw, 3).collect()} == exact and superkmers.count_within(raw, 3).count() == len(exact)
    got = kmers.sketch_lookup(kmers.count_canonical(raw, 3), kmers.sketch(raw, 3))
    assert {r.kmer: r.cnt for r in got.collect()} == exact
    top = kmers.seeds_approximate(raw, 3, 5).collect()
    assert [(r.kmer, r.cnt) for r in top] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:5]
    total, few = sum(exact.values()), 6
    short = {r.kmer: r.cnt for r in kmers.seeds_approximate(raw, 3, few, tracked=few).collect()}
    assert all(abs(exact[x] - n) <= total // few for x, n in short.items())
