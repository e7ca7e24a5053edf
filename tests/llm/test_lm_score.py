import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.llm import attention_lm as lm
from strandlake.llm import lm_score as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def small():
    words = Counter({b"the": 9, b"of": 5, b"then": 3, "é".encode(): 2})
    return lm.choose(lm.vocabulary_path(), words)


def test_units_are_free_of_prefixes_and_lossless(small):
    words = ["the", "then", "of", "zebra", "é", "'s", "don't", "<|endoftext|>", "中", "the,", "x\x1cy", "éa"]
    spelt = [np.frombuffer(x, np.int16).tolist() for x in small.of([w.encode() for w in words])]
    assert len({tuple(s) for s in spelt}) == len(words)
    for a in spelt:
        assert all(0 < u < lm.UNITS for u in a)
        assert not any(a != b and b[: len(a)] == a for b in spelt)
    for w in words:
        assert small.ids(w) == small.tokenizer.encode(w, add_special_tokens=False).ids


def test_windows_score_each_unit_once_with_context():
    seq = np.arange(100, 200)
    starts = np.array([0, 30, 31])
    shown, goal, first = lm.windows(seq, starts)
    assert goal[goal >= 0].tolist() == seq.tolist()
    assert first.sum() == 3
    for s, g, f in zip(shown, goal, first):
        real = np.flatnonzero(g >= 0)
        if not f:
            assert (s[: lm.CONTEXT] != lm.END).all()
        assert all(s[lm.CONTEXT + i] == (lm.END if f and i == 0 else g[i] - 1) for i in real)


def test_gradients_and_probabilities():
    net = lm.Attention(seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    shown, goal, first = lm.windows(rng.integers(1, lm.UNITS, 60), np.array([0, 25]))
    _, d = net.gradients(shown, goal, first)
    for name, grad in d.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = net.p[name][at]
        values = []
        for step in (1e-5, -1e-5):
            net.p[name][at] = old + step
            values.append(net.gradients(shown, goal, first)[0])
        net.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-5 - grad[at]) < 1e-6 + 1e-4 * abs(grad[at]), name
    # the next unit's probabilities sum to one
    one = np.repeat(shown[:1], lm.UNITS, 0)
    goals = np.full((lm.UNITS, lm.SCORED), -1)
    goals[:, 5] = np.arange(lm.UNITS)
    assert abs(np.exp(net.log_probs(one, goals, np.repeat(first[:1], lm.UNITS))).astype(float)[:, 5].sum() - 1) < 1e-3


def test_nothing_after_a_unit_matters():
    net = lm.Attention(seed=1)
    seq = np.random.default_rng(1).integers(1, lm.UNITS, 20)
    other = seq.copy()
    other[12:] = 5
    a, b = (net.log_probs(*lm.windows(s, np.array([0])))[0] for s in (seq, other))
    assert np.allclose(a[:12], b[:12], atol=1e-5) and not np.allclose(a[12:20], b[12:20], atol=1e-5)


def test_base_against_brute_force_and_score_better(docs, rows):
    held = F.col("doc_id") % 5 == 1
    got = {r.doc_id: r for r in ls.score(docs.withColumn("held_out", held), steps=150).collect()}
    words = {r[0]: [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER)), None] for r in rows}
    counts = Counter(w for i, ws in words.items() if i % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values()) - 0.3 * sum(r.n_tokens for r in got.values())


def test_odd_and_empty_tables(odd, none):
    flag = F.lit(False)
    got = ls.score(odd.drop("held").withColumn("held_out", flag), steps=2).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 6, 6, 6] and all(r.train_tokens == 20 for r in got)
    assert ls.score(none.withColumn("held_out", flag), steps=2).count() == 0
    every = ls.score(odd.drop("held").withColumn("held_out", F.lit(True)), steps=2).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in every)


def test_long_texts_teach_units_net_and_mixture(spark):
    cycle = "quokka zebrafish marmalade obsidian".split()
    rows = [(i, " ".join(cycle * 400), False) for i in range(12)] + [(100, " ".join(cycle * 20), True)]
    got = {r.doc_id: r for r in ls.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), steps=150).collect()}
    assert all(len(r[1]) > 8000 for r in rows[:12])
    assert got[100].score > got[100].base_score + 0.2 * got[100].n_tokens


def test_training_grows_with_the_corpus_and_reaches_every_place(spark, monkeypatch):
    monkeypatch.setattr(ls, "FIRST_BYTES", 5000)
    steps = []
    for many in (40, 160):
        text = " ".join(f"w{i}" for i in range(2000))
        w = ls.split_words(pa.array([text] * many))
        row, number, _ = ls._drawn(w, np.arange(many, dtype=np.uint64), ls.TRAIN_SHARE)
        steps.append(len(row))
        assert number.max() > 30
    assert steps[1] > 2 * steps[0]
    text = " ".join("alpha beta gamma delta".split() * 500)
    docs = spark.createDataFrame([(i, text, i == 0) for i in range(60)], "doc_id long, text string, held_out boolean")
    r = ls.score(docs, steps=300).filter("doc_id = 0").first()
    assert math.isfinite(r.score) and r.score > r.base_score
    # a stretch in the middle gives the same windows as the whole text does there
    seq = np.arange(100, 400)
    whole, part = lm.windows(seq, np.array([0])), lm.stretch_windows(seq[:48], seq[48:])
    assert all((a[2:] == b).all() for a, b in zip(whole, part))


def test_every_training_word_teaches_net_or_mixture(spark, monkeypatch):
    monkeypatch.setattr(ls, "FIRST_BYTES", 20_000)
    rows = [(i, " ".join("alpha beta gamma delta".split() * (2000 + i)), i % 10 == 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    fits = {r[0] for r in docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ls.HELD_SHARE)) == 0).select("doc_id").collect()}
    found, went, mixture, on = [], [], ls._mixture, ls._go_on
    monkeypatch.setattr(ls, "_mixture", lambda x: (found.append(int(x.sum())), mixture(x))[1])
    monkeypatch.setattr(ls, "_go_on", lambda seen, units, net: went.append((units, on(seen, units, net))))
    ls.score(docs, steps=20)
    taught = [(i, text.encode().split()) for i, text, held in rows if not held]
    assert found == [sum(len(ws) + 1 for i, ws in taught if i in fits)]
    units, n = went[0]
    sizes = [sum(len(x) // 2 for x in units.of(ws)) + 1 for i, ws in taught if i not in fits]
    assert n == sum(-(-size // lm.SCORED) for size in sizes)


def test_a_pass_holds_every_window(monkeypatch):
    net, seen = lm.Attention(), []
    rows = lm.windows(np.arange(1, 1 + lm.SCORED * 200) % lm.UNITS, np.array([0]))
    gradients = net.gradients
    monkeypatch.setattr(net, "gradients", lambda s, g, f: (seen.extend(g[:, 0].tolist()), gradients(s, g, f))[1])
    net.train(*rows, steps=2, fresh=False)
    assert sorted(seen) == sorted(rows[1][:, 0].tolist())


def test_batches_use_the_same_memory_and_leave_nothing_behind():
    import pickle
    import tracemalloc

    rng = np.random.default_rng(2)
    shown, goal, first = lm.windows(rng.integers(1, lm.UNITS, lm.SCORED * 200), np.array([0, 1000]))
    batch = shown[:128], goal[:128], first[:128]
    net, fresh = lm.Attention(), lm.Attention()
    net.gradients(shown, goal, first)  # a larger batch before
    net.gradients(shown[:3], goal[:3], first[:3])  # and a smaller one
    tracemalloc.start()
    value, d = net.gradients(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20
    other, want = fresh.gradients(*batch)
    assert value == other and all((d[k] == want[k]).all() for k in want)
    assert len(pickle.dumps(net)) == len(pickle.dumps(lm.Attention()))


def test_very_large_outputs_have_finite_gradients():
    net = lm.Attention()
    net.p["class"] *= 500
    net.p["unit"] *= 500
    shown, goal, first = lm.windows(np.random.default_rng(4).integers(1, lm.UNITS, 500), np.array([0]))
    value, d = net.gradients(shown, goal, first)
    assert np.isfinite(value) and all(np.isfinite(x).all() for x in d.values())
