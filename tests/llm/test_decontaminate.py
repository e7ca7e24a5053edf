import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import decontaminate as dc

from .conftest import prose


def slow_tiles(a, b, least):
    """Greedy tiling by trying every pair of places."""
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        i, j, n = best
        out.append(best)
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


@pytest.mark.parametrize("seed", range(6))
def test_tiling_against_every_pair_of_places(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in "ab")
    got = dc.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    assert got == slow_tiles(a, b, 3)


@pytest.fixture
def items(spark):
    rng = random.Random(77)
    rows = [(i, prose(rng, 30)) for i in range(6)] + [(6, "too short"), (7, None), (None, "x y z a b c")]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string")


def test_planted_passages(spark, items):
    rows, benchmark = items
    rng = random.Random(5)
    words = rows[0][1].split()
    reordered = " ".join(words[20:] + ["and"] + words[:10] + ["or"] + words[10:20])
    texts = {
        1: f"{prose(rng, 50)} {rows[0][1]} {prose(rng, 50)}", 2: f"{prose(rng, 20)} {reordered}", 3: rows[1][1].upper().replace(" ", "*** "),
        4: prose(rng, 3000), 5: " ".join(rows[2][1].split()[:9]), 6: None, 7: "", 8: f"{rows[3][1]} {rows[4][1]}",
    }
    docs = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id bigint, text string, item_id int")
    want = {(1, 0), (2, 0), (3, 1), (8, 3), (8, 4)}
    for block_bytes in (dc.BLOCK_BYTES, 100):  # one block, or many
        got = dc.contaminated_pairs(docs, benchmark, block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.coverage >= 0.5 and r.n_covered <= r.n_tokens for r in got)


def test_candidates_lose_nothing_to_tiling_whole_texts():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") for _ in range(60)) for _ in range(20)]
    block = dc.Block(list(range(5)), pa.array(texts[:5]), 4)
    got = {(r, i): c for r, i, _, c, _ in block.pairs(pa.array(texts), 0.0)}
    for r, text in enumerate(texts):
        for i in range(5):
            slow = sum(t[2] for t in slow_tiles(texts[i].split(), text.split(), 4))
            assert got.get((r, i), 0) == slow


def test_odd_and_empty_tables(odd, none, items):
    assert dc.contaminated_pairs(odd, items[1]).count() == 0
    assert dc.contaminated_pairs(none, items[1]).count() == 0
    assert dc.contaminated_pairs(odd, items[1].limit(0)).count() == 0
