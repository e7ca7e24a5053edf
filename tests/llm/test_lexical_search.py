import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, "The of AND, the world!"), (2, "time-two may"), (3, "zebra"), (4, None), (5, " ,.; "), (6, "é word É"), (1, "The of AND, the world!"), (7, "three take used right went come"), (None, "the")]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    cut = [(i, terms(t)) for i, t in docs]
    cut = [(i, t) for i, t in cut if t]
    n_docs, n_terms = len(cut), sum(len(t) for _, t in cut)
    df = Counter(w for _, t in cut for w in set(t))
    out = []
    for item, text in {x for x in items if x[0] is not None}:
        found = []
        for i, t in cut:
            tf, m = Counter(t), 100 - 25 + (25 * len(t) * n_docs) // n_terms
            score = 0
            for w in terms(text):
                if tf[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **how):
    frame = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ls.ranked(docs, frame, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"segment_postings": 40, "k": 3}, {"block_bytes": 20, "k": 200}])
def test_equals_scoring_every_document(spark, docs, rows, how):
    assert ranked(spark, docs.repartition(3), ITEMS, **how) == brute([r[:2] for r in rows], ITEMS, how.get("k", ls.TOP))


def test_sql_gives_the_same(rows):
    con = duckdb.connect()
    items = [x for x in dict.fromkeys(ITEMS) if x[0] is not None]
    for name, key, data in (("documents", "doc_id", [r[:2] for r in rows]), ("benchmark", "item_id", items)):
        con.register(name, pa.table({key: [r[0] for r in data], "text": pa.array([r[1] for r in data], pa.string())}))
    assert sorted(con.sql(ls.OP11_SQL).fetchall(), key=str) == brute([r[:2] for r in rows], items, ls.TOP)


def test_ties_go_by_id_and_repeated_rows_count(spark):
    docs = [(9, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (7, "a b"), (8, "c d"), (10, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for k in (2, 4, 9):
        assert ranked(spark, frame, [(1, "A")], k=k) == brute(docs, [(1, "A")], k)


def test_odd_tables(spark, odd, none):
    assert ranked(spark, none, ITEMS) == []
    assert ranked(spark, odd, []) == []
    got = ranked(spark, odd, [(5, "a e")])
    assert [(r[2], r[1]) for r in sorted(got, key=lambda r: r[1])] == [(1, 1), (1, 2), (None, 3)]


def test_search_stops_before_the_lists_end():
    """A rare term in few documents lifts the k-th score over all that the common term can give."""
    rng = np.random.default_rng(5)
    n = np.full(20_000, 50)
    row = np.repeat(np.arange(20_000), 2)
    term = np.tile([0, 1], 20_000)
    times = rng.integers(1, 4, 40_000)
    rare = rng.choice(20_000, 30, replace=False)
    order = np.lexsort((np.r_[term, np.full(30, 2)], np.r_[row, rare]))
    row, term, times = np.r_[row, rare][order], np.r_[term, np.full(30, 2)][order], np.r_[times, np.full(30, 3)][order]
    segment = ls.Segment(n, row, term, times, np.array([10, 12, 6000]), 20_000, 1_000_000)
    docs, scores = segment.best(np.array([0, 2]), np.array([1, 1]), 20, 0)
    assert len(docs) < 1000 and set(rare) <= set(docs)
    assert not segment.seen.any() and not segment.met.any() and not segment.times.any()
    assert len(segment.best(np.array([0, 2]), np.array([1, 1]), 20, int(scores.max()) + 1)[0]) < 1000
