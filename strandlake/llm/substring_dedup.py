"""Substring deduplication by difference-cover anchors.

A word is removed when a window of ``window`` consecutive words that covers it also
starts in a document with a smaller doc_id.  Hashing every window would deal every word
of the corpus out once more; instead only anchors of ``anchor`` words are hashed, at the
word positions whose remainder modulo the period lies in a difference cover.  For any
two positions some shift below the period puts both on the cover, so two equal windows
of anchor + period - 1 words share an aligned anchor.  Round 1 finds the anchors that
two documents share, round 2 extends around those alone: the full windows that hold one
are compared, and the smallest doc_id that has each is found.

Defined results: null or empty text has no words and keeps none (digest of the empty
string).  A null doc_id is passed through: nothing is removed from it and it removes
nothing.  Repeated rows of one doc_id don't remove each other.  Windows are judged on
the input.  Words are compared by hashes: 64 bits for anchors, which only select, and
96 bits for windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandlake.llm import spread
from strandlake.llm.words import SLICE_BYTES, Words, slices, split_words, window_hashes, window_starts

WINDOW = 13
ANCHOR = 7
PERIOD = 7
COVER = (1, 2, 4)  # every difference modulo 7 occurs

_BIG = np.iinfo(np.int64).max


class _Chunk:
    """What the rounds need of one chunk's documents, slice by slice of text."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window = table, window
        self.parts: list[tuple[pa.Table, Words]] = []
        for part in slices(table, "text", SLICE_BYTES):
            self.parts.append((part, split_words(part.column("text"))))
        self.ids = [
            (part.column("doc_id").fill_null(-1).to_numpy().astype(np.int64), part.column("doc_id").is_valid().to_numpy())
            for part, _ in self.parts
        ]

    def anchors(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each slice: hashes of the aligned anchors, the words they begin with, their rows."""
        out = []
        self.hashes = []
        for _, w in self.parts:
            h = w.hashes()
            self.hashes.append(h)
            counts = w.counts()
            usable = np.where(counts >= self.window, counts, 0)
            starts = window_starts(w.first, ANCHOR)
            rows = np.repeat(np.arange(len(counts)), np.maximum(counts - ANCHOR + 1, 0))
            inside = (starts - w.first[rows]) % PERIOD
            keep = np.isin(inside, COVER) & (usable[rows] > 0)
            starts, rows = starts[keep], rows[keep]
            out.append((window_hashes(h, ANCHOR)[starts], starts, rows))
        return out

    def docs(self, i: int, rows: np.ndarray) -> np.ndarray:
        ids, valid = self.ids[i]
        return np.where(valid, ids, _BIG)[rows]


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their smallest doc and whether two docs have it."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(begin):
        return keys, docs, np.zeros(0, np.uint8)
    low, high = np.minimum.reduceat(docs, begin), np.maximum.reduceat(docs, begin)
    return keys[begin], low, (low != high).astype(np.uint8)


def _flat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _send_anchors(n: int, window: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window)
        found = chunk.anchors()
        keys = _flat([x[0] for x in found], np.uint64)
        docs = _flat([chunk.docs(i, x[2]) for i, x in enumerate(found)], np.int64)
        known = docs != _BIG  # a document without an id shares with none
        keys, _, many = _distinct(keys[known], docs[known])
        return spread.packed(table.column("chunk")[0].as_py(), keys, spread.low32(keys), many, n)

    return send


def _shared(table: pa.Table) -> pa.Table:
    keys, lengths = spread.joined(table.column("keys"), np.uint32)
    many, _ = spread.joined(table.column("tags"), np.uint8)
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    heavy = np.zeros(len(counts), bool)
    heavy[at[many > 0]] = True
    return spread.answers(table, ((counts > 1) | heavy)[at].astype(np.uint8), lengths, 1)


def _candidates(chunk: _Chunk, marks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice the windows that hold a shared anchor: hash, second hash, first word, row."""
    found = chunk.anchors()
    keys = _flat([x[0] for x in found], np.uint64)
    docs = _flat([chunk.docs(i, x[2]) for i, x in enumerate(found)], np.int64)
    keys = np.unique(keys[docs != _BIG])
    shared = keys[marks > 0] if len(marks) else keys[:0]
    out = []
    k = chunk.window
    for i, (hashes, starts, rows) in enumerate(found):
        w, h = chunk.parts[i][1], chunk.hashes[i]
        hit = np.zeros(len(h) + 1, np.int64)
        if len(shared):
            place = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
            good = (shared[place] == hashes) & (chunk.docs(i, rows) != _BIG)
            hit[starts[good]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        at = window_starts(w.first, k)
        at = at[before[at + k - ANCHOR + 1] > before[at]]
        row = np.searchsorted(w.first, at, "right") - 1
        if len(at):
            first, second = window_hashes(h, k)[at], window_hashes(h, k, 77)[at]
        else:
            first = second = np.zeros(0, np.uint64)
        out.append((first, second, at, row))
    return out


def _windows(chunk: _Chunk, found) -> tuple[np.ndarray, ...]:
    """Distinct windows of the chunk, sorted; smallest doc_id of each; for every occurrence its place among them."""
    first = _flat([x[0] for x in found], np.uint64)
    second = spread.low32(_flat([x[1] for x in found], np.uint64))
    docs = _flat([chunk.docs(i, x[3]) for i, x in enumerate(found)], np.int64)
    order = np.lexsort((second, first))
    a, b, d = first[order], second[order], docs[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(fresh)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(fresh) - 1
    low = np.minimum.reduceat(d, begin) if len(begin) else d
    return a[begin], b[begin], low, place, docs


def _send_windows(n: int, window: int):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return spread.packed(0, *[np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)], n)
        chunk = _Chunk(left, window)
        keys, check, low, _, _ = _windows(chunk, _candidates(chunk, spread.answered(right, 1)))
        payload = np.stack([*keys[:, None].view(np.uint32).T, check], axis=1)  # all 96 bits
        tags = low.astype(np.uint32) if len(low) and 0 <= low.min() and low.max() < 2**32 else low
        return spread.packed(left.column("chunk")[0].as_py(), keys, payload, tags, n)

    return send


def _earlier(table: pa.Table) -> pa.Table:
    """1 for each window sent whose smallest document lies in another chunk."""
    bits, lengths = spread.joined(table.column("keys"), np.uint32)
    bits, lengths = bits.reshape(-1, 3), lengths // 3
    keys, check = np.ascontiguousarray(bits[:, :2]).view(np.uint64)[:, 0], bits[:, 2]
    docs = []
    for x, k in zip(table.column("tags").combine_chunks() if table.num_rows else [], lengths, strict=True):
        raw = x.as_buffer()
        docs.append(np.frombuffer(raw, np.uint32 if raw.size == 4 * k else np.int64).astype(np.int64))
    low = _flat(docs, np.int64)
    order = np.lexsort((check, keys))
    a, b = keys[order], check[order]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(keys) else np.zeros(0, np.int64)
    marks = np.zeros(len(keys), np.uint8)
    if len(begin):
        least = np.repeat(np.minimum.reduceat(low[order], begin), np.diff(np.append(begin, len(keys))))
        marks[order] = low[order] > least
    return spread.answers(table, marks, lengths, 2)


def _kept_text(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, gone: np.ndarray, lo: int, hi: int) -> bytes:
    """The text without its removed words, each taken with the white space after it."""
    reach = np.append(begins[1:], hi)
    keep = np.ones(hi - lo, bool)
    edge = np.zeros(hi - lo + 1, np.int64)
    np.add.at(edge, begins[gone] - lo, 1)
    np.add.at(edge, reach[gone] - lo, -1)
    keep &= np.cumsum(edge[:-1]) == 0
    return data[lo:hi][keep].tobytes()


def _finish(window: int, digest: bool, schema: pa.Schema):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        if left.num_rows:
            chunk = _Chunk(left, window)
            found = _candidates(chunk, spread.answered(right, 1))
            keys, _, low, place, docs = _windows(chunk, found)
            marks = spread.answered(right, 2)
            marks = marks if len(marks) else np.zeros(len(keys), np.uint8)
            drop = (marks[place] > 0) | (docs > low[place])
            at = 0
            for (part, w), (_, _, starts, _) in zip(chunk.parts, found, strict=True):
                dropped = starts[drop[at : at + len(starts)]]
                at += len(starts)
                edge = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(edge, dropped, 1)
                np.add.at(edge, dropped + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                out = _digests(w, gone, n_gone) if digest else _texts(w, gone, n_gone)
                last = pa.array(out, pa.string())
                if not digest:  # a text that loses nothing stays as it is, null too
                    last = pc.coalesce(last, part.column("text").cast(pa.string()))
                extra = [part.column("rest")] if "rest" in schema.names else []
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(w.counts()), pa.array(n_gone), last, *extra]
                tables.append(pa.table(columns, names=schema.names))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return finish


def _digests(w: Words, gone: np.ndarray, n_gone: np.ndarray) -> list[str]:
    raw, out = w.data.tobytes(), []
    for i, n in enumerate(n_gone):
        if n:
            f, t = w.first[i], w.first[i + 1]
            words = [raw[w.starts[j] : w.ends[j]] for j in (np.flatnonzero(~gone[f:t]) + f).tolist()]
        else:
            words = raw[w.offsets[i] : w.offsets[i + 1]].split()
        out.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return out


def _texts(w: Words, gone: np.ndarray, n_gone: np.ndarray) -> list[str | None]:
    out: list[str | None] = []
    for i, n in enumerate(n_gone):
        f, t = w.first[i], w.first[i + 1]
        out.append(_kept_text(w.data, w.starts[f:t], w.ends[f:t], gone[f:t], int(w.offsets[i]), int(w.offsets[i + 1])).decode() if n else None)
    return out


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, the text that is left (or with ``digest`` kept_sha256 of
    its words joined by one space), and the columns named in ``keep``, for each row.

    ``docs`` needs doc_id and text.  ``window`` is at least 13.
    """
    if window < ANCHOR + PERIOD - 1:
        raise ValueError(f"windows of under {ANCHOR + PERIOD - 1} words have no certain anchor")
    spark = docs.sparkSession
    n, p = spread.buckets(spark), spread.partitions(spark)
    rest = [F.struct(*[F.col(c) for c in keep]).alias("rest")] if keep else []
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    texts = spread.by_chunk(picked, picked.columns, spread.chunks(spark))
    one = (
        texts.groupBy("chunk").applyInArrow(_send_anchors(n, window), spread.SENT)
        .repartition(p, "bucket").groupBy("bucket").applyInArrow(_shared, spread.ANSWER_DDL)
        .repartition(p, "chunk")
    )
    two = (
        texts.groupBy("chunk").cogroup(one.groupBy("chunk")).applyInArrow(_send_windows(n, window), spread.SENT)
        .repartition(p, "bucket").groupBy("bucket").applyInArrow(_earlier, spread.ANSWER_DDL)
        .repartition(p, "chunk")
    )
    kept = "kept_sha256" if digest else "text"
    ddl = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(kept, T.StringType())])
    if keep:
        ddl = ddl.add("rest", picked.schema["rest"].dataType)
    schema = to_arrow_schema(ddl)
    # the union keeps both rounds' answers on the chunk's partitioning
    out = texts.groupBy("chunk").cogroup(one.union(two).groupBy("chunk")).applyInArrow(_finish(window, digest, schema), ddl)
    return out.select("doc_id", "n_words", "n_removed", kept, *[F.col(f"rest.`{c}`").alias(c) for c in keep])


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, digest=True)


OP6_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS d FROM p GROUP BY k),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT p.doc_id, unnest(range(p.i, p.i + {WINDOW})) AS j FROM p JOIN m ON p.k = m.k WHERE m.d < p.doc_id)),
e AS (SELECT doc_id, ws[j] AS x, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
t AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
