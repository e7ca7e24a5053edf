import random

import pytest

from strandlake.llm import language_id as li

WORDS = {
    "en": "the of and to that with which have from this they would there their what about could other than then these some only over after".split(),
    "de": "der die und das nicht mit sich auf eine werden aber auch nach wird sind noch wie einem über haben zwischen durch wurde wenn".split(),
    "fr": "le les des une dans que pour qui sur avec est pas plus par mais ont cette aussi leur bien sans être où même".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    return [(i, text(rng, lang, rng.randint(20, 200)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]


def test_held_out_accuracy(spark, labelled):
    frame = spark.createDataFrame(labelled, "doc_id bigint, text string, lang string")
    model = li.train(frame.filter("doc_id % 3 <> 1 or doc_id < 30"), sample_docs=20)
    got = {r.doc_id: r for r in li.identify(frame, model).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang in labelled)
    assert right / len(labelled) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_shouting_and_symbols_change_nothing(labelled):
    model = li.fit({k: [li.normal(t) for _, t, lang in labelled if lang == k][:20] for k in WORDS})
    assert model.predict("Der Und Die NICHT!! 123 ### Werden*** auch nach wird")[0] == "de"


@pytest.mark.parametrize("nothing", [None, "", "  \n", "123 !?", "'"])
def test_without_a_letter(labelled, nothing):
    model = li.fit({"en": [b"the of and"], "de": [b"der die und"]})
    assert model.predict(nothing) == ("und", 0.0, True)


def test_ties_single_and_no_languages():
    same = li.Model({"b": b"abc abc", "a": b"abc abc"})
    assert same.predict("abc")[0] == "a" and same.predict("abc")[2]
    assert li.Model({"x": b"abc"}).predict("hello") == ("x", 1.0, False)
    assert li.Model({}).predict("hello")[0] == "und"
    assert li.Model({"x": b"abc", "y": b"def"}).predict("中文字")[0] in ("x", "y")


def test_odd_and_empty_tables(odd, none, docs):
    model = li.train(docs)
    assert set(model.samples) == {"en", "de"}
    assert li.identify(odd, model, ("doc_id", "chunk", "rest")).count() == 5
    assert li.train(none).samples == {} and li.identify(none, model).count() == 0


def test_rows_of_one_id_are_sampled_within_the_bound(spark):
    rows = [(1, "ab cd ef gh " * 30, "xx")] * 50 + [(2, "zu zo zi ze " * 30, "yy")]
    model = li.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=4)
    assert set(model.samples) == {"xx", "yy"}
    assert len(model.samples["xx"]) <= 4 * (li.SAMPLE_BYTES + 1)
