"""Language-model scores: a unigram base over the whole corpus, mixed with causal attention.

Word counts come from every training document: chunks send the buckets of the hash space
their distinct words with counts, and get back the corpus count of each.  The units of the
attention model (attention_lm) are those most frequent in all training documents, counted
in the same pass.  Five in six of these documents train its net, every word of every one,
the others fit the mixture.  The net begins with stretches of STRETCH words from any place
of texts of any length, drawn by hash, of bounded size, on the driver; tasks then go on
from these weights over groups of whole texts where they read them, and the weights of
all groups are averaged, each by its size.  A word's probability is (1 - w) of what the
model gives its units plus w of its corpus share; w is fitted by EM on every word of the
documents that the net hasn't seen, each document's own words taken out of the counts.

Defined results: a null or empty text is its end alone.  A null doc_id counts as held
out: it is scored and teaches nothing.  Repeated rows count as often as they stand in
the table.  With no training document the model is untrained and every base count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import spread
from strandlake.llm.attention_lm import BATCH, CONTEXT, END, RATE, SCORED, STEPS, WINDOW, Attention, Units, chosen, stretch_windows, vocabulary_path, windows
from strandlake.llm.store import cut, remainder
from strandlake.llm.words import Words, mix64, slices, split_words

#: Words in a stretch, and those before it whose units are its context.
STRETCH = 48
BEFORE = CONTEXT + 1
#: The share of the net's documents that trains it: all; the bytes that begin it on the driver, and those of a group.
TRAIN_SHARE = 1.0
FIRST_BYTES = 2_400_000
#: One training document of so many fits the mixture, not the net.
HELD_SHARE = 6
#: Chunk numbers of rows that aren't documents: totals, unit counts, and (downwards) documents that fit the mixture.
TOTALS, UNIT_TOTALS, SAMPLE = -1, -2, -10
#: Buckets beyond those of the words, that sum the counts of units.
UNIT_BUCKETS = 16
#: The histogram of log ratios that fits the mixture.
BINS, REACH = 2000, 40.0

_units: dict[str, Units] = {}


def _whole(path: str) -> Units:
    """The vocabulary with no unit chosen, once a worker."""
    if path not in _units:
        _units[path] = Units(path, [])
    return _units[path]


def _send_counts(n: int, path: str):
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        hashes, weights, words = [], [], []
        for part in slices(table, "text"):
            w = split_words(part.column("text"))
            h = w.hashes(lower=True)
            learns = ~part.column("held_out").to_numpy(zero_copy_only=False) if chunk >= 0 else np.zeros(part.num_rows, bool)
            taught = np.repeat(learns, w.counts())
            hashes.append(h)
            weights.append(taught)
            if taught.any():
                own = np.flatnonzero(taught)
                _, index = np.unique(h[own], return_index=True)
                raw = w.data.tobytes()
                words.append((h[own[index]], [raw[w.starts[i] : w.ends[i]].lower() for i in own[index].tolist()]))
        keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(weights), minlength=len(keys))
        out = spread.packed(chunk, keys, keys, counts.astype(np.uint32), n)
        if not words:
            return out
        heard = np.concatenate([x for x, _ in words])
        named = [x for _, part in words for x in part]
        known, index = np.unique(heard, return_index=True)
        codes, totals = _whole(path).counted([named[i] for i in index.tolist()], counts[np.searchsorted(keys, known)])
        rows: dict[str, list] = {"bucket": [], "chunk": [], "keys": [], "tags": []}
        for b in range(UNIT_BUCKETS):
            mine = codes % UNIT_BUCKETS == b
            if mine.any():
                for k, v in zip(rows, (n + b, chunk, codes[mine].astype(np.int32).tobytes(), totals[mine].astype(np.int64).tobytes()), strict=True):
                    rows[k].append(v)
        return pa.concat_tables([out, pa.table(rows, schema=out.schema)])

    return send


def _corpus_counts(n: int):
    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= n:
            codes, sums = spread.joined(table.column("keys"), np.int32)[0], spread.joined(table.column("tags"), np.int64)[0]
            used, at = np.unique(codes, return_inverse=True)
            total = np.zeros(len(used), np.int64)
            np.add.at(total, at, sums)
            return pa.table({"chunk": [UNIT_TOTALS], "round": [1], "bucket": [bucket], "marks": [np.stack([used.astype(np.int64), total]).tobytes()]}, schema=spread.ANSWER)
        keys, lengths = spread.joined(table.column("keys"), np.uint64)
        counts, _ = spread.joined(table.column("tags"), np.uint32)
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, at, counts.astype(np.uint64))
        out = spread.answers(table, total[at], lengths, 1)
        sums = np.array([total.sum(), (total > 0).sum()], np.uint64).tobytes()
        row = pa.table({"chunk": [TOTALS], "round": [1], "bucket": [bucket], "marks": [sums]}, schema=spread.ANSWER)
        return pa.concat_tables([out, row])

    return count


def _drawn(w: Words, seeds: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches drawn from texts with these 64-bit seeds: row, number in its text, and 31 bits of a hash."""
    per = w.counts() // STRETCH + 1
    row = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    key = mix64(mix64(seeds)[row] + number.astype(np.uint64)) >> np.uint64(32)
    at = np.flatnonzero(key < np.uint64(int(min(1.0, share) * 2**32)))
    return row[at], number[at], (key[at] >> np.uint64(1)).astype(np.int64)


WINDOWS = "key long, shown binary, goal binary, first binary"


def _training(shared, share: float):
    """Windows of the stretches drawn from (h, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = split_words(part.column("text"))
                seeds = part.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                raw, out = w.data.tobytes(), []
                for row, number, key in zip(*(x.tolist() for x in _drawn(w, seeds, share)), strict=True):
                    begin, end = int(w.first[row]), int(w.first[row + 1])
                    low = begin + number * STRETCH
                    high = min(low + STRETCH, end)
                    words = range(max(begin, low - BEFORE), high)
                    spelt = shared.value.of([raw[w.starts[i] : w.ends[i]].lower() for i in words])
                    before, seq = (np.frombuffer(b"".join(x), np.int16).astype(np.int64) for x in (spelt[: low - words.start], spelt[low - words.start :]))
                    shown, goal, first = stretch_windows(before, np.append(seq, END) if high == end else seq)
                    out.append((key, shown.astype(np.int16).tobytes(), goal.astype(np.int16).tobytes(), first.astype(np.int8).tobytes()))
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["key", "shown", "goal", "first"])

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.sort_by([(c, "ascending") for c in ("key", "shown", "goal")])
    shown, goal = (spread.joined(table.column(c), np.int16)[0].astype(np.int64) for c in ("shown", "goal"))
    return shown.reshape(-1, WINDOW), goal.reshape(-1, SCORED), spread.joined(table.column("first"), np.int8)[0] > 0


def _onward(shared):
    """The weights of a task's groups, each after one pass over its whole texts from the shared net's, times their windows and summed."""

    def run(batches):
        units, start = shared.value
        total, n, slot = 0.0, 0, TaskContext.get().partitionId() % UNIT_BUCKETS
        for batch in batches:
            for part in slices(batch, "text", FIRST_BYTES):
                w = split_words(part.column("text"))
                seq, begin, first = unit_rows(units, w, w.data.tobytes(), w.hashes(lower=True))
                rows = windows(seq.astype(np.int16), begin[first])
                net = Attention()
                net.p = {k: v.copy() for k, v in start.items()}
                net.train(*rows, steps=-(-len(rows[0]) // BATCH), rate=RATE / 4, fresh=False)
                total = total + np.concatenate([net.p[k].ravel() for k in sorted(net.p)]).astype(np.float64) * len(rows[0])
                n += len(rows[0])
        if n:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})

    return run


def _sum_weights(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("weights").combine_chunks())
    return pa.table({"slot": table.column("slot")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def _ratios(shared):
    """For a group of documents a histogram of the log of corpus share over the net's probability; the last bin counts words without a share."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model: Model = shared.value
        total = np.zeros(BINS + 1, np.int64)
        if left.num_rows:
            parts = [split_words(p.column("text")) for p in slices(left, "text")]
            hashes = [w.hashes(lower=True) for w in parts]
            keys = np.unique(np.concatenate(hashes))
            corpus = spread.answered(right, 1, np.uint64).astype(np.float64)
            for w, h in zip(parts, hashes, strict=True):
                log_model, _ = model.log_words(w, w.data.tobytes(), h)
                at = np.searchsorted(keys, h)
                _, index, own = np.unique(w.rows() * len(keys) + at, return_inverse=True, return_counts=True)
                counts = _rows(w, np.maximum(corpus[at] - own[index], 0) if len(h) else np.zeros(0), float(model.ends - 1))
                ratio = model.base_log(counts) - log_model
                place = np.clip(((ratio + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)
                total += np.bincount(np.where(counts > 0, place, BINS), minlength=BINS + 1)
        return pa.table({"found": pa.array([total.tobytes()], pa.binary())})

    return run


def unit_rows(units: Units, w: Words, raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The units of all tokens of all rows (a row's words, then its end), where each token begins in them, and which token each row begins with."""
    rows = len(w.first) - 1
    _, index, at = np.unique(hashes, return_index=True, return_inverse=True)
    spelt = units.of([raw[w.starts[i] : w.ends[i]].lower() for i in index.tolist()])
    sizes = np.array([1] + [len(s) // 2 for s in spelt], np.int64)
    pool = np.frombuffer(b"".join([np.array([END], np.int16).tobytes(), *spelt]), np.int16).astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    token = np.zeros(len(hashes) + rows, np.int64)  # 0 is the end
    token[np.arange(len(hashes)) + w.rows()] = at + 1
    size = sizes[token]
    begin = np.cumsum(size) - size
    return pool[np.repeat(offsets[token] - begin, size) + np.arange(int(size.sum()))], begin, w.first[:-1] + np.arange(rows)


class Model:
    def __init__(self, units: Units, net: Attention, share: float, tokens: int, distinct: int, ends: int):
        self.units, self.net, self.share = units, net, share
        self.tokens, self.distinct, self.ends = tokens, distinct, ends

    def log_words(self, w: Words, raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each token of each row (its words, then its end), and where each row's tokens begin."""
        seq, begin, first = unit_rows(self.units, w, raw, hashes)
        shown, goal, head = windows(seq, begin[first])
        found = self.net.log_probs(shown, goal, head)[goal >= 0]
        return np.add.reduceat(found.astype(np.float64), begin), first

    def mixed(self, log_model: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 of the mixture for tokens with these corpus counts."""
        share = np.log(self.share * (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)), where=counts > 0, out=np.full(len(counts), -np.inf))
        return np.logaddexp(np.log1p(-self.share) + log_model, share) / np.log(10)

    def base_log(self, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def _rows(w: Words, values: np.ndarray, end: float) -> np.ndarray:
    """Values of words with one for the end of each row put in."""
    out = np.full(len(values) + len(w.first) - 1, end, float)
    out[np.arange(len(values)) + w.rows()] = values
    return out


def _score(shared):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        model: Model = shared.value
        out: dict[str, list] = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        if left.num_rows:
            parts = [(p, split_words(p.column("text"))) for p in slices(left, "text")]
            hashes = [w.hashes(lower=True) for _, w in parts]
            keys = np.unique(np.concatenate(hashes))
            corpus = spread.answered(right, 1, np.uint64).astype(np.float64)
            for (part, w), h in zip(parts, hashes, strict=True):
                log_model, first = model.log_words(w, w.data.tobytes(), h)
                counts = _rows(w, corpus[np.searchsorted(keys, h)] if len(h) else np.zeros(0), float(model.ends))
                out["doc_id"].append(part.column("doc_id"))
                out["held_out"].append(part.column("held_out"))
                out["n_tokens"].append(pa.array(w.counts() + 1))
                out["n_known"].append(pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)))
                out["base_score"].append(pa.array(np.add.reduceat(model.base(counts), first)))
                out["score"].append(pa.array(np.add.reduceat(model.mixed(log_model, counts), first)))
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        flat = {k: pa.chunked_array([c for x in v for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])], kinds[k]) for k, v in out.items()}
        return pa.table(flat).append_column("train_tokens", pa.array(np.full(len(flat["doc_id"]), model.tokens, np.int64)))

    return score


def _mixture(found: np.ndarray, rounds: int = 30) -> float:
    """The weight of the corpus share that makes the words of the histogram likeliest, by EM."""
    weight = 0.5
    ratio = np.append(np.exp((np.arange(BINS) + 0.5) * (2 * REACH / BINS) - REACH), 0.0)
    for _ in range(rounds):
        mine = weight * ratio / (weight * ratio + (1 - weight))
        weight = float(np.clip((mine * found).sum() / found.sum(), 0.01, 0.99))
    return weight


def _go_on(seen: DataFrame, units: Units, net: Attention) -> int:
    """Takes the net on over all windows of all texts, in groups whose weights are averaged; how many windows they were."""
    form = "slot int, n long, weights binary"
    shared = seen.sparkSession.sparkContext.broadcast((units, net.p))
    sums = seen.select("text").mapInArrow(_onward(shared), form).groupBy("slot").applyInArrow(_sum_weights, form).collect()  # UNIT_BUCKETS rows at most
    n = sum(r.n for r in sums)
    if n:
        flat = sum(np.frombuffer(bytes(r.weights), np.float64) for r in sorted(sums, key=lambda r: r.slot)) / n
        at = 0
        for k in sorted(net.p):
            shape, many = net.p[k].shape, net.p[k].size
            net.p[k] = flat[at : at + many].reshape(shape).astype(np.float32)
            at += many
    return n


def _fitted(taught: DataFrame, units: Units, size: int, steps: int) -> Attention:
    """The net, trained on documents (h, text) with ``size`` bytes in all."""
    spark = taught.sparkSession
    net = Attention()
    low = FIRST_BYTES / max(size, 1)
    seen = taught.filter(F.pmod("h", F.lit(HELD_SHARE)) != 0)
    net.train(*_unpacked(seen.mapInArrow(_training(spark.sparkContext.broadcast(units), min(low, TRAIN_SHARE)), WINDOWS).toArrow()), steps=steps)
    if low < TRAIN_SHARE and steps:
        _go_on(seen, units, net)
    return net


def score(docs: DataFrame, held: str = "held_out", *, path: str | None = None, steps: int = STEPS) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, ``held``), learning from those not held out."""
    spark = docs.sparkSession
    path = path or vocabulary_path()
    n, p = spread.buckets(spark), spread.partitions(spark)
    picked = docs.select("doc_id", F.col(held).alias("held_out"), F.col("text").cast("string").alias("text"))
    texts = spread.by_chunk(picked, ["doc_id", "held_out", "text"], spread.chunks(spark))
    taught = picked.filter("NOT held_out").select(F.xxhash64("doc_id").alias("h"), "text")
    ends, size = taught.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, spread.chunks(spark) // HELD_SHARE)  # as large as chunks
    unseen = taught.filter(F.pmod("h", F.lit(HELD_SHARE)) == 0).select((SAMPLE - F.pmod(F.xxhash64("h"), F.lit(groups))).cast("int").alias("chunk"), "text")
    extra = unseen.select("chunk", F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("held_out"), "text")
    counted = cut(
        texts.unionAll(extra).groupBy("chunk").applyInArrow(_send_counts(n, path), spread.SENT)
        .repartition(p, "bucket").groupBy("bucket").applyInArrow(_corpus_counts(n), spread.ANSWER_DDL)
    )
    totals = [np.frombuffer(bytes(r[0]), np.uint64) for r in counted.filter(F.col("chunk") == TOTALS).select("marks").collect()]
    tokens, distinct = (int(sum(int(t[i]) for t in totals)) + (ends if i == 0 else int(ends > 0)) for i in (0, 1))
    # as many rows as the vocabulary has units, whatever the corpus
    seen = [np.frombuffer(bytes(r[0]), np.int64).reshape(2, -1) for r in counted.filter(F.col("chunk") == UNIT_TOTALS).select("marks").collect()]
    codes, sums = np.concatenate(seen, axis=1) if seen else np.zeros((2, 0), np.int64)
    units = chosen(path, codes, sums)
    model = Model(units, _fitted(taught, units, size, steps), 0.3, tokens, distinct, ends)
    fits = unseen.groupBy("chunk").cogroup(counted.filter(F.col("chunk") <= SAMPLE).groupBy("chunk")).applyInArrow(_ratios(spark.sparkContext.broadcast(model)), "found binary").collect()
    found = sum((np.frombuffer(bytes(r[0]), np.int64) for r in fits), np.zeros(BINS + 1, np.int64))
    if found.sum():
        model.share = _mixture(found)
    shared = spark.sparkContext.broadcast(model)  # UNITS units and a small net, whatever the corpus
    back = counted.filter("chunk >= 0").repartition(p, "chunk")
    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    found = texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_score(shared), columns)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(True))
    return score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text"))
