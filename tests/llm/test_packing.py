import random
import zlib
from array import array
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from strandlake.llm import packing as pk


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(pk.tokenizer_path())


def test_encoder_equals_the_tokenizer(tokenizer, rows):
    rng = random.Random(3)
    letters = "aB é'́ßİΣ  \t\n9.,中ﬁ\x1cǄ-’s"
    texts = ["<|endoftext|> a<|startoftext|>b", "don't we'll ...'s ΑΣ. é", ""] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    texts += [r[1] for r in rows if r[1]]
    got = pk.Encoder(pk.tokenizer_path()).encode(texts)
    want = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def check(pieces, rows, tokenizer, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for i, text in ((r[0], r[1]) for r in rows):
        ids = array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
        mine = sorted(by_doc[i], key=lambda p: p.piece)
        assert [p.piece for p in mine] == list(range(len(mine)))
        assert sum(p.length for p in mine) == len(ids) and (len(mine) == 1 or len(ids) > length)
        for p in mine:
            assert p.start == p.piece * length and p.length == min(length, len(ids) - p.start)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for placed in by_seq.values():
        at = 0
        for p in sorted(placed, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(by_seq)


@pytest.mark.parametrize(("length", "open_bins"), [(2048, 1024), (256, 4)])
def test_round_trip(docs, rows, tokenizer, length, open_bins):
    pieces = pk.pack(docs.repartition(5), length=length, open_bins=open_bins).collect()
    used = check(pieces, rows, tokenizer, length)
    assert used <= 1.15 * sum(p.length for p in pieces) / length + 2


def slow_best_fit(items, length, most):
    bins, out = [], []  # open bins: [number, free]
    number = 0
    for n in items:
        fit = sorted((b for b in bins if b[1] >= n), key=lambda b: b[1])
        if fit:
            b = [x for x in bins if x[1] == fit[0][1]][-1]
        else:
            if len(bins) >= most:
                bins.remove([x for x in bins if x[1] == min(y[1] for y in bins)][-1])
            b = [number, length]
            number += 1
            bins.append(b)
        out.append((length - b[1], n))
        bins.remove(b)
        b[1] -= n
        if b[1]:
            bins.append(b)
    return out, number


@pytest.mark.parametrize("most", [1, 3, 50])
def test_best_fit_against_a_list_of_bins(most):
    rng = random.Random(most)
    items = [rng.randint(1, 100) for _ in range(500)]
    fit = pk.BestFit(100, most)
    got = [(fit.place(n)[1], n) for n in items]
    want, bins = slow_best_fit(items, 100, most)
    assert got == want and fit.next == bins and fit.count <= most


def test_odd_and_empty_tables(odd, none):
    assert sorted(str(r.doc_id) for r in pk.pack(odd).collect()) == ["1", "1", "2", "None", "None"]
    assert pk.pack(none).count() == 0
