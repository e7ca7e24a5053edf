import duckdb
import pyarrow as pa

from strandlake.llm import quality_rules as q


def test_report_equals_its_sql(docs, rows):
    got = sorted(map(tuple, q.quality_report(docs).collect()))
    con = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())})
    con.register("documents", documents)
    assert got == sorted(con.sql(q.OP7_SQL).fetchall())


def test_order_never_changes_the_verdict(docs, rows):
    names = tuple(r.name for r in q.RULES)
    want = {r.doc_id for r in q.quality_report(docs).collect() if r.kept}
    for order in (names, names[::-1]):
        assert {r.doc_id for r in q.quality_filter(docs, order=order).collect()} == want


def test_each_rule_rejects_its_kind():
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    bad = {
        "few_words": "too few", "repeated_words": "same old words " * 30, "symbols": good.replace(" ", "### "), "capitals": good.upper(),
        "repeated_lines": good + "\nline one\nline two" * 5, "few_letters": good + " 12" * 50, "word_length": " ".join("x" * 20 + str(i) for i in range(60)),
    }
    rules = {r.name: r for r in q.RULES}
    for name, text in bad.items():
        assert rules[name].rejects(q.Batch(pa.array([good, text]))).tolist() == [False, True], name
    assert q.survivors(q.Batch(pa.array([good, *bad.values(), None, ""])), tuple(rules)).tolist() == [True] + [False] * (len(bad) + 2)


def test_cheap_and_strict_rules_come_first():
    texts = pa.array(["a b"] * 50 + [" ".join(f"w{i}" for i in range(400))] * 50)
    for _ in range(20):  # word_length rejects as many and needs all that few_words needs
        assert q.ordered(texts)[0] == "few_words"
    assert q.ordered(pa.array([], pa.string())) == tuple(r.name for r in q.RULES)


def test_order_follows_new_rejections_and_features_at_hand():
    rules = {r.name: r for r in q.RULES}
    some = tuple(rules[x] for x in ("symbols", "capitals", "few_words"))
    seconds = {"n_symbols": 1.0, "word_chars": 1.0, "n_upper": 1.0, "n_lower": 1.0, "words": 0.1, "n_words": 0.1}
    # symbols rejects all that capitals does and more; few_words one that neither does
    verdicts = {0b001: 3, 0b011: 6, 0b100: 1, 0b000: 90}
    assert q.cascade((seconds, verdicts), some) == ("few_words", "symbols", "capitals")
    verdicts[0b101] = 9
    assert q.cascade((seconds, verdicts), some)[0] == "few_words"
    assert q.cascade((seconds, {0b001: 30, 0b010: 40}), some, frozenset({"n_symbols", "word_chars"}))[0] == "symbols"


def test_the_estimate_of_a_table_is_that_of_its_texts(docs, rows):
    seconds, verdicts = q.estimated(docs)
    assert verdicts == q.estimate(pa.array([r[1] for r in rows]))[1]
    assert set(seconds) >= {"words", *q.BASE} and min(seconds.values()) >= 0


def test_narrowed_batches_equal_fresh_ones(rows):
    col = pa.array([r[1] for r in rows])
    batch = q.Batch(col)
    for name in ("n_words", "lines"):
        batch.get(name)
    some = q.np.arange(1, len(col), 3)
    left, fresh = batch.narrowed(some), q.Batch(col.take(pa.array(some)))
    for name in q._FEATURES:
        assert q.np.array_equal(left.get(name), fresh.get(name)), name


def test_odd_and_empty_tables(odd, none):
    got = q.quality_report(odd).collect()
    assert len(got) == 5 and all(r.base_failed and not r.kept for r in got)
    assert q.quality_filter(odd).count() == 0
    assert q.quality_report(none).count() == 0
    assert q.quality_filter(none).columns == none.columns
