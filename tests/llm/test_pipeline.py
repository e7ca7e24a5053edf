import corpus_pipeline as cp
import pytest

from strandlake.llm import decontaminate, quality_rules

from .conftest import SCHEMA, prose
from .test_ngram_join import brute as groups
from .test_packing import check, tokenizer  # noqa: F401
from .test_substring_dedup import brute as passages


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    import random

    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(4)]
    more = [(600 + i, f"{prose(rng, 60)} {t} {prose(rng, 20)}", "en", "src1", 1) for i, t in items]
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(cp.STAGES)
    assert [n.split("_")[0] for n in stages] == ["quality", "ngram", "substring", "benchmark", "best"]

    docs = cp.cut(stages["quality_rules"](spark, docs, folder))
    kept = {r.doc_id for r in quality_rules.quality_report(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r.kept}
    assert {r.doc_id for r in docs.collect()} == kept
    left = {i: t for i, t in left.items() if i in kept}

    docs = cp.cut(stages["ngram_jaccard_join"](spark, docs, folder))
    want = {c for _, c in groups(left.items(), 5, 80).values()}
    assert {r.doc_id for r in docs.collect()} == want and len(want) < len(left)
    left = {i: left[i] for i in want}

    docs = cp.cut(stages["substring_dedup"](spark, docs, folder))
    gone = {i: n for i, (_, n, _) in passages(left.items(), 13).items()}
    for r in docs.collect():
        assert len(r.text.split()) == len(left[r.doc_id].split()) - gone[r.doc_id]
        assert gone[r.doc_id] or r.text == left[r.doc_id]
        left[r.doc_id] = r.text

    docs = cp.cut(stages["benchmark_decontamination"](spark, docs, folder))
    assert docs.columns == cp.COLUMNS
    assert set(left) - {r.doc_id for r in docs.collect()} == {600, 601, 602, 603}
    left = {i: t for i, t in left.items() if i < 600}

    pieces = stages["best_fit_packing"](spark, docs, folder).collect()
    check(pieces, sorted(left.items()), tokenizer, 2048)


def test_run_returns_the_last_stage(spark, folder):
    assert cp.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages_stand_nulls_repeats_and_empty_tables(spark, folder, none, stage):
    run = dict(cp.STAGES)[stage]
    text = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text, None, None, None), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = run(spark, docs, folder).collect()
    most = {"quality_rules": 3, "ngram_jaccard_join": 3, "substring_dedup": 4, "benchmark_decontamination": 4, "best_fit_packing": 4}
    assert len(got) == most[stage]
    assert run(spark, none, folder).count() == 0
    assert decontaminate.PAIRS


def test_of_rows_with_one_id_the_least_stays(spark):
    rows = [(1, "b " * 3, "en", "s", 6), (1, None, "en", "s", None), (1, "a " * 3, "en", "s", 6), (2, "c", None, None, 1), (None, "d", "en", "s", 1), (None, "d", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in cp.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, None), (2, "c"), (None, "d"), (None, "d")], key=str)
