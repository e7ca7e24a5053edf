import hashlib
import random

import pytest
import sentencepiece

from strandlake.llm import piece_codec as pc

PARTS = ["a", "e", "t", "th", " ", "  ", "\n", "é", "中", "ﬁ", "<", ">", "/s", "<0x0A>", ".", "1", "22", "▁", "\t", "\0", "E", "ing", "😀", "ß", "     ", "ción", "'s", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.model_path())


@pytest.fixture(scope="module")
def vocabulary():
    return pc.Vocabulary(pc.model_path())


@pytest.fixture(scope="module")
def texts(vocabulary, rows):
    rng = random.Random(7)
    out = ["", " ", "  ", "a", "▁", "\n\n", "x" * 3000, " " * 100, "ab " * 900, "the" * 500]
    out += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    out += ["".join(rng.choice(vocabulary.text[259:]) for _ in range(rng.randint(1, 8))) for _ in range(1000)]
    return out + [r[1] for r in rows if r[1]]


def test_ids_equal_the_library(vocabulary, library, texts):
    assert [vocabulary.encode(t) for t in texts] == [library.encode(t, add_eos=True) for t in texts]


def test_decoding_equals_the_library(vocabulary, library):
    rng = random.Random(8)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 7))]
        assert vocabulary.decode(ids) == library.decode(ids)


def test_edges_tell_what_merging_tells(vocabulary):
    rng = random.Random(9)
    plain = [i for i in vocabulary.ids.values() if vocabulary.is_plain(i)]
    ends = {}
    for i in plain:
        ends.setdefault(vocabulary.text[i][-1], []).append(i)
    close = [(a, b) for a, b in ((rng.choice(plain), rng.choice(plain)) for _ in range(20_000)) if a != b]
    for a, b in close:
        assert vocabulary._edges_hold(a, b) == vocabulary._stay_apart(a, b)
    assert 0 < sum(vocabulary._edges_hold(a, b) for a, b in close) < len(close)


def test_cuts_change_no_ids(vocabulary, texts):
    letters = set(vocabulary.ids)
    for t in texts[:1500]:
        whole = pc.BLANK + t.replace(" ", pc.BLANK)
        if t and set(whole) <= letters:
            assert vocabulary.encode_segment(whole) == vocabulary.encode(t)[:-1]


def test_memory_is_bounded_and_changes_nothing(vocabulary, texts):
    small, large = pc.Memory(vocabulary, 2000), pc.Memory(vocabulary)
    for t in texts[:400]:
        assert pc.digests(small, t) == pc.digests(large, t)
        assert len(small) < 10 and len(small.older) < 10
    assert all(len(x) <= pc.LONG for x in large)


def test_groups_of_a_long_text(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pc, "GROUP", 3)
    for t in ("  one two, three\n four.", "\na b c d e f"):
        ids = library.encode(t, add_eos=True)
        assert pc.digests(pc.Memory(vocabulary), t) == (len(ids), _sha(" ".join(map(str, ids))), _sha(library.decode(ids)))


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_documents(spark, docs, odd, none, rows, library):
    want = {i: (len(ids), _sha(" ".join(map(str, ids))), _sha(library.decode(ids))) for i, ids in ((r[0], library.encode(r[1] or "", add_eos=True)) for r in rows)}
    assert {r[0]: tuple(r[1:]) for r in pc.coded(docs).collect()} == want
    assert pc.coded(none).collect() == [] and pc.coded(none).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((r[0] is not None, r[0] or 0, r[1]) for r in pc.coded(odd).collect())
    assert [x[:2] for x in got] == [(False, 0), (False, 0), (True, 1), (True, 1), (True, 2)] and got[-1][2] == 1


def test_round_trip_through_tables(spark, docs, rows):
    ids = pc.encoded(docs)
    assert {r.doc_id: r.text for r in pc.decoded(ids).collect()} == {r[0]: r[1] or "" for r in rows}
    gone = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pc.decoded(gone).collect()[0].text is None


@pytest.mark.parametrize(("piece", "says"), [("a▁b", "blank"), ("ɸɸ", "every letter")])
def test_other_vocabularies_are_refused(tmp_path, piece, says):
    made = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    made.ParseFromString(open(pc.model_path(), "rb").read())
    made.pieces[900].piece = piece
    (tmp_path / "m.model").write_bytes(made.SerializeToString())
    with pytest.raises(ValueError, match=says):
        pc.Vocabulary(str(tmp_path / "m.model"))
