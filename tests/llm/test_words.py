import random
import re

import pyarrow as pa

from strandlake.llm import words as module
from strandlake.llm.words import PUNCTUATION, slices, split_words, window_hashes, window_starts


def cut(text):
    return [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_words_of_random_texts():
    rng = random.Random(1)
    texts = [None, "", " ", "x"] + ["".join(rng.choice("ab é\n\t\x0b\x1c ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    w = split_words(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        got = [bytes(w.data[a:b]) for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
        assert got == cut(text)


def test_hashes_are_of_the_words_alone():
    texts = pa.array(["one two", "  two\tONE", None, "three"])
    w = split_words(texts)
    h = w.hashes()
    assert h[0] != h[3] and h[1] == h[2] and len({*h.tolist()}) == 4
    low = w.hashes(lower=True)
    assert low[0] == low[3]
    marks = split_words(pa.array(["one, two!", "one two"]), PUNCTUATION).hashes()
    assert marks[:2].tolist() == marks[2:].tolist()


def test_windows_stay_in_their_row():
    w = split_words(pa.array(["a b c", "d", None, "a b c d"]))
    at = window_starts(w.first, 3)
    assert at.tolist() == [0, 4, 5]
    h = window_hashes(w.hashes(), 3)
    assert h[0] == h[4] != h[5]


def test_slices_cover_every_row_once():
    batch = pa.table({"text": ["x" * n for n in (5, 0, 30, 2, 2, 2)], "i": range(6)})
    parts = list(slices(batch, "text", 6))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(6))
    assert len(parts) > 2 and not list(slices(batch.slice(0, 0), "text"))


def test_hashes_dont_depend_on_how_many_bytes_are_hashed_at_once(monkeypatch):
    texts = pa.array([" ".join("ab" * n for n in range(60)), None, "é" * 5000, "a b c", "x" * 40_000 + " y"])
    w = split_words(texts)
    whole = w.hashes()
    monkeypatch.setattr(module, "HASH_BYTES", 64)
    monkeypatch.setattr(module, "_powers", [])
    assert (w.hashes() == whole).all() and len(module._powers[0]) == 64


def test_narrowed_words_are_those_of_the_rows_alone():
    texts = pa.array(["one two", None, "", "three  four five ", "six"])
    rows = module.np.array([1, 3, 4])
    some, alone = split_words(texts).narrowed(rows), split_words(texts.take(pa.array(rows)))
    assert some.hashes().tolist() == alone.hashes().tolist() and some.first.tolist() == alone.first.tolist()
    assert some.starts.tolist() == alone.starts.tolist() and some.data.tolist() == alone.data.tolist()
