import random

import pytest

from strandlake.llm import toxicity as tx

from .conftest import VOCAB, prose

BAD = ["idiot", "moron", "trash", "stupid"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = prose(rng, rng.randint(20, 80)).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((" ".join(words), int(i % 4 == 0)))
    return tx.fit(rows, (300, 100))


@pytest.mark.parametrize("word", BAD)
def test_disguises_are_restored(model, word):
    leet = word.translate(str.maketrans("aeiost", "431057"))
    for form in (word, word.upper(), leet, ".".join(word), "-".join(word), word[0] + word[1] * 4 + word[2:], f"{word}!!!", f'"{word}",'):
        assert tx.restore(form, model.chars) == word, form
        assert model.score(f"the of {form} and to") >= 0.5, form
    assert model.score(f"the of {' '.join(word)} and to") >= 0.5


def test_clean_words_stay(model):
    for word in VOCAB:
        assert tx.restore(word, model.chars) == word
    rng = random.Random(11)
    assert all(model.score(prose(rng, 300)) < 0.5 for _ in range(30))
    for clean in ("12:30 on 2024-05-06", "mail a@b.com", "price 300$ | 20%", "é ü ß", "a b c d"):
        assert model.score(clean) < 0.5, clean


def test_null_empty_and_very_long(model):
    assert model.score(None) == model.score("") == model.score(" \n")
    assert model.score("1" * 50_000 + " x") < 0.5
    assert model.score(prose(random.Random(0), 100_000) + " 1d10t") >= 0.5


def test_tables(spark, docs, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i) for i in range(0, 100)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, toxic int, quality int")
    got = tx.score(docs, tx.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    blank = tx.train(docs, labels.limit(0))
    assert {r.score for r in tx.score(odd, blank, ("doc_id", "chunk")).collect()} == {0.0}
    assert tx.score(none, blank).count() == 0


def test_doubled_letters_signs_alone_and_spaced_runs(model):
    for form in ("iddiot", "sttupid", "you are a m o r o n", "i d i o t m o r o n", "x m o r o n y"):
        assert model.score(f"the of {form} and to") >= 0.5, form
    bad = [("the of ass and to " + prose(random.Random(i), 9), 1) for i in range(60)]
    short = tx.fit(bad + [(prose(random.Random(1000 + i), 14), 0) for i in range(180)], (180, 60))
    for form in ("4$$", "@$$"):
        assert tx.restore(form, short.chars) == "ass" and short.score(f"the of {form} and to") >= 0.5, form
    assert tx.restore("too", model.chars) == "too"


def _readings(token, i):
    """What may stand at a place of a token, written down anew."""
    c, many = token[i], 1
    while i + many < len(token) and token[i + many] == c:
        many += 1
    letters, cost = (c, 0.0) if c.isalpha() else (tx.LOOKALIKES.get(c, ""), tx._COST_LIKE)
    out = []
    for x in letters:
        if many <= 2:
            out.append((x, 1, cost))
        if many == 2:
            out.append((x, 2, cost + tx._COST_PAIR))
        if many > 2:
            out += [(x, many, cost + tx._COST_RUN), (x + x, many, cost + tx._COST_RUN)]
    if not c.isalpha():
        out.append(("", 1, tx._COST_DROP if c in tx.SEPARATORS else tx._COST_LOSE))
    return out


def _exhaustive(token, model):
    """The best value of all readings of a token, and the readings that reach it."""
    best = {}

    def read(i, text, value):
        if i == len(token):
            value += model.log(f"^^{text}"[-2:], "$") + (tx.KNOWN_WORD if text in model.known else 0.0)
            best[text] = max(value, best.get(text, -1e18))
            return
        for emit, length, cost in _readings(token, i):
            now, grown = value - cost, text
            for c in emit:
                now += tx.LETTER + model.log(f"^^{grown}"[-2:], c)
                grown += c
            read(i + length, grown, now)

    read(0, "", 0.0)
    top = max(best.values())
    return top, {t for t, v in best.items() if v > top - 1e-9}


def test_decoding_equals_trying_every_reading(model):
    rng = random.Random(5)
    tokens = ["".join(rng.choices("ad1!0tiioom@$.-5|rn6", k=rng.randint(1, 7))) for _ in range(1500)]
    tokens += ["".join(rng.choices("1!|0", k=7)) for _ in range(200)] + ["m0r0n", "1d10t", "5tup1d", "idd1ot", "ttrash", "111", "a1111", "....", "m000ron", "1111d", "xxxx"]
    for token in tokens:
        assert tx.decode(token, model.chars) in _exhaustive(token, model.chars)[1], token


@pytest.mark.parametrize("token", ["a" + "1" * 1_000_000, "1!|0" * 250_000, "Ab9+/x7Q" * 125_000, "#" * 500_000 + "a" + "#" * 500_000])
def test_a_token_of_a_million_signs(model, token):
    import time
    import tracemalloc

    began = time.process_time()
    tx.restore(token, model.chars)
    assert time.process_time() - began < 90  # a few seconds on an idle machine
    tracemalloc.start()
    tx.restore(token[:200_000], model.chars)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20  # a fifth of the token; memory is linear
    tracemalloc.stop()


def test_models_survive_pickling(model):
    import pickle

    again = pickle.loads(pickle.dumps(model))
    for text in ("the 1d10t and to", "the of and", "m o r o n"):
        assert again.score(text) == model.score(text)


def _best_rows(run, model):
    """The best value of all readings of a run as a row of words, and the rows that reach it."""
    best = {}

    def read(i, words, word, value):
        end = -1e18
        if word:
            known = word in model.known and len(word) >= tx.LEAST_WORD
            end = value + (model.log(f"^^{word}"[-2:], "$") + tx.WORD_LETTER * len(word) - tx.WORD_PRICE if known else -tx.BREAK)
        if i == len(run):
            if word:
                best[(*words, word)] = max(end, best.get((*words, word), -1e18))
            return
        for emit, length, cost in _readings(run, i):
            for done, own, start in [(words, word, value)] + ([((*words, word), "", end)] if word else []):
                now, grown = start - cost, own
                for c in emit:
                    now += tx.LETTER + model.log(f"^^{grown}"[-2:], c)
                    grown += c
                read(i + length, done, grown, now)

    read(0, (), "", 0.0)
    top = max(best.values(), default=0.0)
    return {words for words, v in best.items() if v > top - 1e-9} or {()}


def test_words_of_a_spaced_run_equal_trying_every_row(model):
    rng = random.Random(6)
    runs = ["".join(rng.choices("thecanoidt1!0.", k=rng.randint(1, 6))) for _ in range(600)] + ["thecan", "canthe", "xthex", "...", "tthhe"]
    for run in runs:
        assert tuple(tx.segments(run, model.chars)) in _best_rows(run, model.chars), run


def test_known_words_of_any_length_in_a_spaced_run(model):
    long = "incomprehensibilities"
    words = tx.Counter({**{w: 50 for w in VOCAB}, long: 9, "idiot": 20})
    chars = tx.CharModel(words)
    for run in (f"xq{long}zk", f"which{long}because", f"{long}idiot{long}", "q1d10tz" + long):
        got = tx.spaced(" ".join(run), chars)
        assert long in got and ("idiot" in got) == ("idiot" in run or "1d10t" in run), (run, got)


@pytest.mark.parametrize("signs", ["abcdefghijklmnopqrstuvwxyz", "a1b2$3@!0c"])
def test_long_spaced_runs_take_time_by_their_length(model, signs):
    import time

    rng = random.Random(7)
    began = time.process_time()
    tx.spaced(" ".join(rng.choices(signs, k=200_000)), model.chars)
    assert time.process_time() - began < 60  # 400 KB; some seconds on an idle machine


def test_tokens_left_undecoded_have_no_signal(model):
    """Signals of a token equal those of its reading, decoded without looking first at how it may begin."""
    rng = random.Random(9)
    tokens = ["".join(rng.choices("idotmrnsa1!0|3$5.-DI", k=rng.randint(1, 9))) for _ in range(3000)] + ["iddiot", "!!idiot", "4$$", "Iidiot", "IDIOT", "id", "i"]
    for word in BAD:
        tokens += ["".join(rng.choice((c, c + c, c.upper(), "." + c, c * 4)) for c in word) for _ in range(100)]
    found = 0
    for token in tokens:
        want = tuple(f for f in tx.features(tx.restore(token, model.chars)) if f in model.weights)
        assert model._signals(token) == want, token
        found += bool(want)
    assert found > 200


def test_long_documents_teach(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 3300) + (" moron" if i % 2 else ""), i % 2) for i in range(80)]
    assert all(len(text) > 12_000 for _, text, _ in rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    found = tx.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert found.score("the of m0r0n and to") >= 0.5 > found.score("the of and to")


def test_every_labelled_document_teaches(spark):
    """More documents of each label than were once drawn; each word stands in two of them, so one left out would lose a known word."""
    rng = random.Random(13)
    name = ["".join(rng.choices("bcdfghklmnprstvwz", k=9)) for _ in range(2600)]
    name = [w for w in name if not any(a == b for a, b in zip(w, w[1:]))]
    rows = [(2 * i + j, f"{prose(rng, 9)} {w}{' idiot' if i % 3 == 0 else ''}", int(i % 3 == 0)) for i, w in enumerate(name) for j in (0, 1)]
    assert sum(y for *_, y in rows) > 1000 and len(rows) > 3000
    rows += rows[:50]  # repeated rows count once
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = tx.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert got.chars.known >= set(name)
    kept = sorted(set(rows))
    want = tx.fit([(text, y) for _, text, y in kept], (sum(1 - y for *_, y in kept), sum(y for *_, y in kept)))
    assert got.chars.__getstate__() == want.chars.__getstate__() and got.weights.keys() == want.weights.keys()
    for text in ("the of idiot", "the 1d10t of", "the of and to", None):
        assert abs(got.score(text) - want.score(text)) < 0.02, text


def test_near_copies_share_a_sketch():
    import pyarrow as pa

    rng = random.Random(14)
    texts = [prose(rng, n) for n in (0, 1, 3, 5, 60, 200)]
    found = tx.sketches(pa.array([*texts, *[t.upper() for t in texts], None])).tolist()
    assert found[:6] == found[6:12] and len(set(found)) == 6 and found[12] == found[0]
    words = texts[5].split()
    near = [" ".join([*words[:i], "zebra", *words[i + 1 :]]) for i in range(0, 200, 4)]
    assert sum(x == found[5] for x in tx.sketches(pa.array(near)).tolist()) > 40


def test_words_without_a_signal_are_looked_at_once(model, monkeypatch):
    text, looked, signals = prose(random.Random(8), 500), [], tx.Model._signals
    fresh = tx.Model(model.chars, model.weights, model.bias)
    monkeypatch.setattr(tx.Model, "_signals", lambda self, token: (looked.append(token), signals(self, token))[1])
    scores = {fresh.score(text) for _ in range(3)}
    assert scores == {model.score(text)} and sorted(looked) == sorted(set(text.split()))
    fresh.score("x" * 10_000)
    assert "x" * 10_000 not in fresh.quiet


def test_one_pair_of_letters_is_two_readings(model, monkeypatch):
    rng = random.Random(3)
    words = ["iddiot", "idiott", "iidiot", "sttupid", "ee", "thhe", "éé", "trassh"] + ["".join(rng.choice("abeinost") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    words += [w[:i] + w[i] + w[i:] for w in BAD for i in range(len(w))]
    assert [tx._decoded(w, model.chars) for w in words] == [tx.decode(w, model.chars) for w in words]
    monkeypatch.setattr(tx, "decode", lambda *_: pytest.fail("decoded by the lattice"))
    assert tx.restore("iddiot", model.chars) == "idiot"


def test_calm_beginnings_have_no_signal(model):
    rng = random.Random(5)
    calm = 0
    for _ in range(20_000):
        token = "".join(rng.choice("idotmrsuaéÉIDMSİΣ10.,(") for _ in range(rng.randint(1, 7)))
        if model._calm(token[: tx.PREFIXES[0]]):
            calm += 1
            assert not any(f in model.weights for f in tx.features(tx.restore(token, model.chars))), token
    assert calm > 500


def test_beginnings_that_no_toxic_document_holds_mark_none_of_their_words(model):
    import numpy as np
    import pyarrow as pa

    class Shared:
        value = np.zeros(tx.MARKS, bool)

    for f in {f for w in ("idiotic", "moron") for f in tx.features(w)}:
        Shared.value[tx.zlib.crc32(f.encode()) % tx.MARKS] = True
    lines = ["idiotic\nmoron\nthing", "idiots\nmor", "ido\nmoronic"]
    got: dict[str, int] = {}
    for b in tx._documents_with(Shared)([pa.RecordBatch.from_pydict({"words": lines})]):
        for f, n in zip(*b.to_pydict().values(), strict=True):
            got[f] = got.get(f, 0) + n
    every = [{f for w in x.split("\n") for f in tx.features(w)} for x in lines]
    marked = {f for w in ("idiotic", "moron") for f in tx.features(w)}
    assert got == {f: n for f in marked if (n := sum(f in x for x in every))}
