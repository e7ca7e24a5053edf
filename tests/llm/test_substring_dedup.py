import hashlib
import random

import pytest

from strandlake.llm import substring_dedup as sd


def brute(rows, window):
    low, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            low.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [13, 20])
def test_against_brute_force(docs, rows, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.substring_dedup(docs, window=window, digest=True).collect()}
    want = brute([r[:2] for r in rows], window)
    assert got == want and any(r[1] for r in want.values())


def test_every_alignment_of_a_shared_passage_is_found(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(i, " ".join(f"{rng.random()}" for _ in range(i)) + f" {passage} end{i}") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), digest=True).collect()}
    assert got == {i: 13 if i else 0 for i in range(40)}


def test_texts_keep_what_is_left(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, passage, "x"), (2, f"a\n\n b {passage}\n c  d", "y"), (3, None, None)]
    got = {r.doc_id: (r.text, r.chunk) for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, chunk string"), keep=("chunk",)).collect()}
    assert got == {1: (passage, "x"), 2: ("a\n\n b c  d", "y"), 3: (None, None)}


def test_differences_modulo_the_period_are_covered():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    assert sd.ANCHOR + sd.PERIOD - 1 <= sd.WINDOW


def test_odd_and_empty_tables(spark, odd, none):
    long = " ".join("abcdefghijklmnop")
    more = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in sd.substring_dedup(more, digest=True).collect())
    assert got == [("1", 0), ("1", 0), ("2", 16), ("None", 0)]
    assert sd.substring_dedup(odd, keep=("chunk", "bucket", "rest")).count() == 5
    assert sd.substring_dedup(none, digest=True).count() == 0
    with pytest.raises(ValueError):
        sd.substring_dedup(none, window=12)
