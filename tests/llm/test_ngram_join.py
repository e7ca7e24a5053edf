import random
import re

import pytest

from strandlake.llm import ngram_join as nj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    sets, up = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(frame, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.components(frame, **how).collect()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(docs, rows, k, percent):
    assert found(docs, k=k, percent=percent) == brute([r[:2] for r in rows], k, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_that_hubs_alone_do_not_join(spark, seed):
    """Sets drift step by step, so most links lie between sets that no hub links with."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(80):
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(60)] = f"n{rng.randrange(40)}"
        if i % 20 == 0:
            words = [f"v{seed}{i}{j}" for j in range(60)]
        rows.append((rng.randrange(10**6) * 100 + i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, percent in ((1, 85), (2, 80), (1, 50)):
        assert found(frame, k=k, percent=percent) == brute(rows, k, percent)


def test_odd_and_empty_tables(odd, none):
    got = sorted(nj.components(odd).collect(), key=str)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (2, None)]
    assert nj.components(none).count() == 0


def test_one_id_with_several_texts(spark):
    """What any text of an id links with is in the component of them all, the one without words included."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(13)) for x in "abc")
    near, far = f"{b} more", f"{c} more"
    rows = [(1, a), (1, b), (2, b), (6, near), (9, c), (9, a), (9, None), (12, far), (20, ""), (20, far), (30, "x y z"), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(nj.components(frame).collect(), key=str)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (6, 1), (9, 1), (12, 1), (20, 1), (30, 30), (None, None)}
    assert sorted(r.n_shingles for r in got if r.doc_id == 9) == [0, 10, 10]
