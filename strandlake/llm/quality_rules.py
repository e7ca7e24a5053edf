"""Quality rules as a short-circuit cascade.

Each rule needs some features of a text.  On a sample every feature is timed by itself,
and every rule is asked about every document: tasks send back how many documents have
each combination of verdicts, and the seconds of each feature.  The cascade then takes,
again and again, the rule that rejects most of the documents still standing for each
second of the features it needs beyond those at hand.  In each batch a rule looks only
at documents that none before it has rejected, and features found once stay at hand.  A
document is kept when no rule rejects it, so the order changes the work, never the
verdict.

Defined results: null and empty texts have no words and fail ``few_words``.  Repeated
rows are judged alike, one result each.  An empty sample leaves the rules as declared.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.words import Words, slices, split_words, string_buffers, window_hashes, window_starts

#: Expected rows of the sample on which costs and selectivity are estimated.
SAMPLE_ROWS = 2000
SAMPLE_SEED = 7

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 5
MAX_DUP_LINE_PERCENT = 40
MIN_ALPHA_PERCENT = 60
MEAN_WORD_CHARS = (2, 15)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POINT = np.array([not 9 <= b <= 13 and b != 32 and b & 0xC0 != 0x80 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Batch:
    """Features of a slice of documents, each computed once, when it is first asked for."""

    def __init__(self, col: pa.Array):
        self.col = col
        self._known: dict[str, np.ndarray] = {}
        self._words: Words | None = None
        self.seconds: dict[str, float] = {}
        self._inner = 0.0

    def _timed(self, name: str, make):
        """Its seconds are its own, without those of the features it asks for."""
        began, outer, self._inner = time.perf_counter(), self._inner, 0.0
        out = make()
        took = time.perf_counter() - began
        self.seconds[name] = took - self._inner
        self._inner = outer + took
        return out

    def get(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = self._timed(name, lambda: _FEATURES[name](self))
        return self._known[name]

    def words(self) -> Words:
        if self._words is None:
            self._words = self._timed("words", lambda: split_words(self.col))
        return self._words

    def narrowed(self, rows: np.ndarray) -> Batch:
        """Only these rows (ascending), with all that is known of them."""
        out = Batch(self.col.take(pa.array(rows)))
        out._known = {name: value[..., rows] for name, value in self._known.items()}
        out._words = self._words.narrowed(rows) if self._words is not None else None
        return out

    def per_row(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each row the table marks."""
        offsets, data = string_buffers(self.col)
        return np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])


def _lines(batch: Batch) -> np.ndarray:
    out = np.zeros((2, len(batch.col)), np.int64)
    for i, text in enumerate(batch.col.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        out[:, i] = len(lines), len(lines) - len(set(lines))
    return out


def _repeated(batch: Batch) -> np.ndarray:
    w = batch.words()
    counts = w.counts()
    at = window_starts(w.first, 3)
    if not len(at):
        return np.zeros(len(counts), np.int64)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - 2, 0))
    key = window_hashes(w.hashes(), 3)[at] + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    mark = np.zeros(len(w.starts), bool)
    for j in range(3):
        mark[at[twice] + j] = True
    return np.diff(np.concatenate([[0], np.cumsum(mark)])[w.first])


def _alpha(batch: Batch) -> np.ndarray:
    w = batch.words()
    if not len(w.starts):
        return np.zeros(len(batch.col), np.int64)
    before = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
    has = before[w.ends] > before[w.starts]
    return np.diff(np.concatenate([[0], np.cumsum(has)])[w.first])


_FEATURES: dict[str, Callable[[Batch], np.ndarray]] = {
    "n_words": lambda b: b.words().counts(),
    "word_chars": lambda b: b.per_row(_POINT),
    "n_symbols": lambda b: b.per_row(_SYMBOL),
    "n_upper": lambda b: b.per_row(_UPPER),
    "n_lower": lambda b: b.per_row(_LOWER),
    "n_alpha_words": _alpha,
    "lines": _lines,
    "n_lines": lambda b: b.get("lines")[0],
    "n_dup_lines": lambda b: b.get("lines")[1],
    "n_repeat_words": _repeated,
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Batch], np.ndarray]


RULES = (
    Rule("few_words", lambda b: b.get("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda b: 100 * b.get("n_repeat_words") > MAX_REPEAT_PERCENT * b.get("n_words")),
    Rule("symbols", lambda b: 100 * b.get("n_symbols") > MAX_SYMBOL_PERCENT * b.get("word_chars")),
    Rule("capitals", lambda b: b.get("n_upper") > b.get("n_lower")),
    Rule("repeated_lines", lambda b: 100 * b.get("n_dup_lines") > MAX_DUP_LINE_PERCENT * b.get("n_lines")),
    Rule("few_letters", lambda b: 100 * b.get("n_alpha_words") < MIN_ALPHA_PERCENT * b.get("n_words")),
    Rule("word_length", lambda b: (b.get("word_chars") < MEAN_WORD_CHARS[0] * b.get("n_words")) | (b.get("word_chars") > MEAN_WORD_CHARS[1] * b.get("n_words"))),
)
BASE_RULES = ("few_words", "repeated_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Seconds of the features and numbers of documents by verdicts, bit i for rule i.
Estimate = tuple[dict[str, float], dict[int, int]]


def estimate(texts: pa.Array, rules: tuple[Rule, ...] = RULES, repeats: int = 2) -> Estimate:
    """From all rules on all texts, slice by slice; of several timings of a feature the least counts."""
    seconds: dict[str, float] = {}
    verdicts: dict[int, int] = {}
    for part in slices(pa.table({"text": texts}), "text"):
        least: dict[str, float] = {}
        for _ in range(repeats):
            batch = Batch(part.column("text").combine_chunks())
            found = sum((r.rejects(batch).astype(np.int64) << i for i, r in enumerate(rules)), np.zeros(len(batch.col), np.int64))
            least = {name: min(took, least.get(name, took)) for name, took in batch.seconds.items()}
        for name, took in least.items():
            seconds[name] = seconds.get(name, 0.0) + took
        for pattern, n in zip(*(x.tolist() for x in np.unique(found, return_counts=True)), strict=True):
            verdicts[pattern] = verdicts.get(pattern, 0) + n
    return seconds, verdicts


def needs(rule: Rule) -> frozenset[str]:
    """The features that a rule asks for, with those that they ask for."""
    batch = Batch(pa.array(["a b c"]))
    rule.rejects(batch)
    return frozenset(batch.seconds)


def cascade(found: Estimate, rules: tuple[Rule, ...] = RULES, at_hand: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """Names of the rules in the order of documents newly rejected per second; ties as declared."""
    seconds, verdicts = found
    left, names = list(enumerate(rules)), []
    have = set(at_hand)
    while left:
        gain = []
        for i, rule in left:
            cost = sum(seconds.get(name, 0.0) for name in needs(rule) - have)
            gain.append(sum(n for pattern, n in verdicts.items() if pattern >> i & 1) / max(cost, 1e-9))
        i, rule = left.pop(int(np.argmax(gain)))
        names.append(rule.name)
        have |= needs(rule)
        verdicts = {pattern: n for pattern, n in verdicts.items() if not pattern >> i & 1}
    return tuple(names)


def ordered(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> tuple[str, ...]:
    """The cascade for a sample of texts."""
    return cascade(estimate(texts, rules), rules)


def estimated(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Estimate:
    """The estimate on about ``rows`` rows drawn from ``docs``, taken in the tasks that read them; no text comes to the driver."""

    def run(batches):
        for batch in batches:
            seconds, verdicts = estimate(batch.column("text"))
            names = [*seconds, *[None] * len(verdicts)]
            patterns = [*[None] * len(seconds), *verdicts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(patterns, pa.int64()), pa.array([*seconds.values(), *map(float, verdicts.values())], pa.float64())], names=["feature", "verdicts", "amount"])

    drawn = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=min(1.0, rows / max(docs.count(), 1)), seed=SAMPLE_SEED)
    sums = drawn.mapInArrow(run, "feature string, verdicts long, amount double").groupBy("feature", "verdicts").agg(F.sum("amount").alias("amount")).collect()
    return {r.feature: r.amount for r in sums if r.feature}, {r.verdicts: int(r.amount) for r in sums if not r.feature}


def survivors(batch: Batch, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Which rows no rule rejects, each rule seeing only what those before it left."""
    by_name = {r.name: r for r in rules}
    out = np.zeros(len(batch.col), bool)
    alive = np.arange(len(out))
    for name in names:
        if not len(alive):
            break
        bad = by_name[name].rejects(batch)
        if bad.any():
            rows = np.flatnonzero(~bad)
            alive, batch = alive[rows], batch.narrowed(rows)
    out[alive] = True
    return out


def quality_filter(docs: DataFrame, *, order: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with all their columns."""
    names = order or cascade(estimated(docs))

    def keep(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(survivors(Batch(part.column("text")), names)))

    return docs.mapInArrow(keep, docs.schema)


def quality_report(docs: DataFrame, *, order: tuple[str, ...] | None = None) -> DataFrame:
    """For each document its base features, whether a base rule fails it, and the verdict of the cascade.

    The report shows the base features of all rows, so these cost the cascade nothing
    more: it goes on from them over the rows that the base rules leave.
    """
    base = tuple(r for r in RULES if r.name in BASE_RULES)
    names = order or cascade(estimated(docs), at_hand=frozenset(BASE) | {"words", "lines"})
    names = tuple(x for x in names if x not in BASE_RULES)

    def report(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                feats = Batch(part.column("text"))
                values = [pa.array(feats.get(x).astype(np.int64)) for x in BASE]
                failed = np.logical_or.reduce([r.rejects(feats) for r in base])
                rows = np.flatnonzero(~failed)
                kept = np.zeros(len(failed), bool)
                kept[rows] = survivors(feats.narrowed(rows), names)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *values, pa.array(failed), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "kept"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(report, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_alpha
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars OR n_upper > n_lower
            OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines OR 100 * n_alpha < {MIN_ALPHA_PERCENT} * n_words
            OR word_chars < {MEAN_WORD_CHARS[0]} * n_words OR word_chars > {MEAN_WORD_CHARS[1]} * n_words) AS kept
FROM b
"""
