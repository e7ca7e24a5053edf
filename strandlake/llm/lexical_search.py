"""Ranked lexical search by the Best Position Algorithm over impact lists.

Items are a stated query set, read in blocks of bounded size.  Documents are cut to terms
once for a block, and what they hold of its terms is written as a table of postings, a row
a document.  Tasks read that table in segments.  A segment has an impact list for each
term, the documents in order of falling impact, and each document's own postings for
direct access.  For an item the lists of its terms are read side by side, a stretch at a
time; each document met is scored at once by direct access, which also marks its place in
the item's other lists as seen.  The best position of a list is the end of its unbroken run
of seen places: what isn't seen yet stands behind it in every list, so its score is at
most the sum of the next impacts there.  Reading stops when that sum is strictly below the
score of the k-th best document so far, as a document of equal score may have the lesser
id.  A task carries its k best on to its next segment.

Only the k best of each task and item are sent, and they meet in two steps: by item and a
part of the tasks, then by item.

Defined results: null texts and texts without a term are in no list and no count; an item
without a term, or of null text or id, has no row.  Repeated rows of documents are
documents each.  Null doc_ids stand behind all others of equal score.  Repeated rows of
items are one item; items of one id and other texts are ranked each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.store import cut
from strandlake.llm.words import PUNCTUATION, slices, split_words

TOP = 20
#: Bytes of item text that one reading of the documents serves.
BLOCK_BYTES = 1 << 20
#: Postings that a task holds as one segment; bounds its memory, not the search.
SEGMENT_POSTINGS = 2_000_000
#: Places of each list that are read at first; doubled until the search can stop.
STRETCH = 64
#: Groups of tasks whose rows meet before all of an item's do.
FAN_IN = 64

POSTINGS = "doc_id long, n long, terms binary, tfs binary, dfs binary"
FOUND = "query int, item_id long, doc_id long, score long, part int"


class Queries:
    """A block of items: its terms, and which of them each item holds how often."""

    def __init__(self, items: list[int], texts: pa.Array):
        words = split_words(texts, PUNCTUATION)
        self.items = items
        self.terms, first, which = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
        self.sizes = (words.ends - words.starts)[first]
        self.held = [np.unique(which[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]

    def postings(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms with repeats of each text; then (row, term, times) of the block's terms in them, by row and term."""
        words = split_words(texts, PUNCTUATION)
        hashes = words.hashes(lower=True)
        place = np.minimum(np.searchsorted(self.terms, hashes), max(len(self.terms) - 1, 0))
        hit = np.flatnonzero((self.terms[place] == hashes) & (self.sizes[place] == words.ends - words.starts))
        pairs, times = np.unique(words.rows()[hit] * len(self.terms) + place[hit], return_counts=True)
        return words.counts(), pairs // len(self.terms), pairs % len(self.terms), times


def queries(items: DataFrame, block_bytes: int) -> Iterator[Queries]:
    """The items with a term in blocks of about ``block_bytes`` of text, read one at a time."""
    picked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    n = int((picked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // block_bytes) + 1
    for k in range(n):
        table = picked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if table.num_rows:
            block = Queries(table.column("item_id").to_pylist(), table.column("text").combine_chunks())
            if len(block.terms):
                yield block


def weights(n_docs: int, dfs: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in dfs], np.int64)


class Segment:
    """Impact lists over some documents, and the same postings by document."""

    def __init__(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        if len(n) and int(n.max()) * n_docs >= 1 << 58:
            n = n.astype(object)
        length = (100 - 25 + (25 * n * n_docs) // n_terms).astype(np.int64)
        times = times.astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * length[row]))
        order = np.lexsort((-impact, term))
        self.list_start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.list_doc = row[order]
        self.list_impact = impact[order]
        self.term, self.impact = term, impact  # by document
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.doc_start = np.searchsorted(row, np.arange(len(n) + 1))
        self.seen = np.zeros(len(order), bool)
        self.met = np.zeros(len(n), bool)
        self.times = np.zeros(len(weight), np.int64)

    def direct(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of some documents under the terms set in ``times``, and the places of their postings in these terms' lists."""
        size = self.doc_start[docs + 1] - self.doc_start[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.doc_start[docs] - ends + size, size) + np.arange(int(ends[-1]))
        times = self.times[self.term[at]]
        gained = np.concatenate([[0], np.cumsum(times * self.impact[at])])
        return gained[ends] - gained[ends - size], self.place[at[times > 0]]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, among them every one of the k best that isn't below ``least``, the k-th score so far (0: none yet)."""
        begin, end = self.list_start[terms], self.list_start[terms + 1]
        self.times[terms] = times
        docs, scores, marked = [], [], []
        best, stretch = begin.copy(), STRETCH
        while True:
            left = best < end
            bound = int((self.list_impact[best[left]] * times[left]).sum())
            if not left.any() or bound < least:
                break
            to = np.minimum(best + stretch, end)
            stretch *= 2
            read = np.concatenate([self.list_doc[a:b] for a, b in zip(best[left].tolist(), to[left].tolist(), strict=True)])
            new = np.unique(read[~self.met[read]])
            if len(new):
                self.met[new] = True
                score, places = self.direct(new)
                self.seen[places] = True
                docs.append(new)
                scores.append(score)
                marked.append(places)
                if len(every := np.concatenate(scores)) >= k:
                    least = max(least, int(np.partition(every, len(every) - k)[len(every) - k]))
            best = np.array([self._run(a, b) for a, b in zip(to.tolist(), end.tolist(), strict=True)], np.int64)
        self.times[terms] = 0
        for d, places in zip(docs, marked, strict=True):
            self.met[d] = False
            self.seen[places] = False
        none = np.zeros(0, np.int64)
        return (np.concatenate(docs) if docs else none), (np.concatenate(scores) if scores else none)

    def _run(self, at: int, end: int) -> int:
        """Where the unbroken run of seen places that goes on at ``at`` ends."""
        step = 32
        while at < end:
            part = self.seen[at : min(at + step, end)]
            if not part.all():
                return at + int(np.argmin(part))
            at += len(part)
            step *= 2
        return end


class Best:
    """The k best documents of each item so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * n
        self.known = [np.zeros(0, bool)] * n
        self.scores = [np.zeros(0, np.int64)] * n

    def least(self, i: int) -> int:
        return int(self.scores[i][-1]) if len(self.scores[i]) == self.k else 0

    def add(self, i: int, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        ids, known, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.known[i], known]), np.concatenate([self.scores[i], scores])
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        order = order[scores[order] > 0]
        self.ids[i], self.known[i], self.scores[i] = ids[order], known[order], scores[order]


def _segments(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch of postings with about ``most`` postings each: ids, n, row, term, times."""
    batch = batch.filter(batch.column("n").is_valid())
    counts = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        part = batch.slice(at, to - at)
        term, times = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int32).astype(np.int64) for c in ("terms", "tfs"))
        yield part.column("doc_id"), part.column("n").to_numpy(zero_copy_only=False), np.repeat(np.arange(to - at), counts[at:to]), term, times
        at = to


def _index(block):
    """Postings of documents; the last row of a task holds in how many of its documents each term stands."""

    def index(batches):
        dfs = np.zeros(len(block.value.terms), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                n, row, term, times = block.value.postings(part.column("text"))
                dfs += np.bincount(term, minlength=len(dfs))
                cuts = np.searchsorted(row, np.arange(len(n) + 1)).tolist()
                term, times = term.astype(np.int32), times.astype(np.int32)
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (term, times)]
                whole = pa.table({"doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "terms": packed[0], "tfs": packed[1], "dfs": pa.nulls(len(n), pa.binary())})
                yield from whole.filter(pa.array(n > 0)).to_batches()
        yield pa.RecordBatch.from_pydict({c: pa.array([dfs.tobytes() if c == "dfs" else None], pa.binary() if c in ("terms", "tfs", "dfs") else pa.int64()) for c in ("doc_id", "n", "terms", "tfs", "dfs")})

    return index


def _spread(batches):
    """(term, df) of packed counts, summed over each batch."""
    for batch in batches:
        total = sum(np.frombuffer(x, np.int64) for x in batch.column("dfs").to_pylist())
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(len(total)), pa.int32()), "df": pa.array(total, pa.int64())})


def _search(block, weight: np.ndarray, n_docs: int, n_terms: int, k: int, most: int):
    def search(batches):
        from pyspark import TaskContext

        found = Best(len(block.value.items), k)
        for batch in batches:
            for ids, n, row, term, times in _segments(batch, most):
                segment = Segment(n, row, term, times, weight, n_docs, n_terms)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for i, (held, often) in enumerate(block.value.held):
                    docs, scores = segment.best(held, often, k, found.least(i))
                    if len(docs):
                        found.add(i, number[docs], known[docs], scores)
        size = [len(x) for x in found.scores]
        if sum(size):
            part = TaskContext.get().partitionId() % FAN_IN
            yield pa.RecordBatch.from_pydict(
                {
                    "query": pa.array(np.repeat(np.arange(len(size)), size), pa.int32()),
                    "item_id": pa.array(np.repeat(np.array(block.value.items, np.int64), size)),
                    "doc_id": pa.array(np.concatenate(found.ids), pa.int64(), mask=~np.concatenate(found.known)),
                    "score": pa.array(np.concatenate(found.scores), pa.int64()),
                    "part": pa.array(np.full(sum(size), part), pa.int32()),
                }
            )

    return search


def ranked(docs: DataFrame, items: DataFrame, *, k: int = TOP, block_bytes: int = BLOCK_BYTES, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score for each item."""
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in queries(items, block_bytes):
        shared = spark.sparkContext.broadcast(block)  # at most a block, whatever the number of items
        index = cut(picked.mapInArrow(_index(shared), POSTINGS))
        n_docs, n_terms = index.filter("n IS NOT NULL").agg(F.count("n"), F.sum("n")).first()
        if not n_docs:
            continue
        dfs = np.zeros(len(block.terms), np.int64)  # one number for each of the block's terms
        for term, df in index.filter("dfs IS NOT NULL").select("dfs").mapInArrow(_spread, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
            dfs[term] = df
        found = index.select("doc_id", "n", "terms", "tfs").mapInArrow(_search(shared, weights(n_docs, dfs), n_docs, n_terms, k, segment_postings), FOUND)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        near = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= k)
        last = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        out = out.unionAll(last.select("item_id", "rank", "doc_id", "score"))
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""WITH w AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), z AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
d AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM n, z),
q AS (SELECT item_id, term, count(*) AS often FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
p AS (SELECT term, doc_id, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, z GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(often * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}"""
