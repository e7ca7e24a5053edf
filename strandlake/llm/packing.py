"""Packing token sequences by bounded-space online best fit.

Documents are tokenised and ended by ``end_id``; only those longer than a sequence are
cut.  Full pieces are sequences of their own.  The others go, in the order read, into
one of a fixed number of open bins, kept in a bitset keyed by free space: the fullest
bin that still holds the piece takes it.  When none does and all bins are open, the
fullest closes first.  Bins that are still open when a task ends are packed again, as
wholes, with those of other tasks, in rounds that join a fixed number of tasks.

Defined results: a null or empty text is the end id alone.  Repeated rows are packed
each on their own.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.store import cut
from strandlake.llm.words import byte_letters

LENGTH = 2048
OPEN_BINS = 1024
END_ID = 0
#: Tasks whose open bins one task of the next round packs together.
FAN_IN = 16
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_MARKS = ".,;:?!\"()[]{}<>|/\\*$%&#@+=-_~^`"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    This vocabulary drops white space and never joins across it, nor between letters and
    marks, so a word has ids of its own, and so have its letters and the marks after
    them.  Letters that no normaliser would change go straight to the merges; any other
    word goes through the whole tokenizer.  Both are remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _letters(self, core: str) -> bytes:
        found = self.parts.get(core)
        if found is None:
            shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            found = self.parts[core] = array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()
        return found

    def _whole(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            found = self.parts[word] = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return found

    def word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha() and len(core) <= 64:
            if core.isascii():
                return self._letters(core.lower()) + self._whole(word[len(core) :])
            if core.islower() and unicodedata.is_normalized("NFC", core):
                return self._letters(core) + self._whole(word[len(core) :])
        return self._whole(word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts = {"": b""}
        known, out = self.words, []
        for text in texts:
            words = text.replace("\n", " ").split(" ") if text else []
            for w in set(words):
                if w not in known:
                    known[w] = self.word(w)
            out.append(b"".join(map(known.__getitem__, words)))
        return out


class BestFit:
    """Open bins by free space.  place() returns (bin, offset); closed bins are final."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most = length, open_bins
        self.bits, self.free, self.count, self.next = 0, [[] for _ in range(length + 1)], 0, 0
        self.used: dict[int, int] = {}

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.count -= 1
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.count >= self.most:  # the fullest closes first
                del self.used[self._take((self.bits & -self.bits).bit_length() - 1)]
            bin_, space = self.next, self.length
            self.next += 1
        offset, left = self.length - space, space - n
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.count += 1
            self.used[bin_] = self.length - left
        else:
            self.used.pop(bin_, None)
        return bin_, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, bin long, offset long, open boolean"


def _pack_texts(path: str, length: int, open_bins: int, end_id: int):
    def pack(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        coder, fit, end = Encoder(path), BestFit(length, open_bins), np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 512):
                for doc, raw in zip(ids[at : at + 512], coder.encode(texts.slice(at, 512).to_pylist()), strict=True):
                    raw += end
                    total = len(raw) // 4
                    for piece, start in enumerate(range(0, total, length)):
                        n = min(length, total - start)
                        rows.append((doc, piece, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, *fit.place(n)))
            if len(rows) > 100_000:  # bins that have closed are final: their rows go out
                gone = [r for r in rows if r[6] not in fit.used]
                rows = [r for r in rows if r[6] in fit.used]
                yield _piece_rows(gone, fit.used)
        yield _piece_rows(rows, fit.used)

    return pack


def _piece_rows(rows: list[tuple], used: dict[int, int]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 8
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
    arrays.append(pa.array([b in used for b in cols[6]], pa.bool_()))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "bin", "offset", "open"])


def _merge(length: int, open_bins: int):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "task", "bin"], ascending=[False, True, True])
        fit = BestFit(length, open_bins)
        placed = [fit.place(int(n)) for n in frame.used]
        out = frame[["task", "bin"]].copy()
        out["to_task"] = frame.task // FAN_IN
        out["to_bin"] = [b for b, _ in placed]
        out["shift"] = [o for _, o in placed]
        out["total"] = frame.used
        return out

    return merge


def pack(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(picked.mapInArrow(_pack_texts(path or tokenizer_path(), length, open_bins, end_id), PIECES))
    bins = pieces.filter("open").groupBy("task", "bin").agg(F.sum("length").alias("used"))
    tasks = pieces.agg(F.max("task")).first()[0] or 0
    # where each open bin of the first round now lies: (level, task, bin) and the offset there
    place = None
    level = 0
    while tasks > 0 or level == 0:
        level += 1
        moved = cut(
            bins.withColumn("group", F.floor(F.col("task") / FAN_IN)).groupBy("group")
            .applyInPandas(_merge(length, open_bins), "task int, bin long, to_task int, to_bin long, shift long, total long")
        )
        if place is None:
            place = moved.select(F.col("task").alias("t0"), F.col("bin").alias("b0"), F.col("to_task").alias("task"), F.col("to_bin").alias("bin"), "shift")
        else:
            now = moved.select("task", "bin", "to_task", "to_bin", F.col("shift").alias("more"))
            place = place.join(now, ["task", "bin"]).select("t0", "b0", F.col("to_task").alias("task"), F.col("to_bin").alias("bin"), (F.col("shift") + F.col("more")).alias("shift"))
        bins = moved.groupBy(F.col("to_task").alias("task"), F.col("to_bin").alias("bin")).agg(F.sum("total").alias("used"))
        tasks //= FAN_IN
    # closed: even numbers, by task and bin; open: odd numbers, by the last round's
    closed = pieces.filter("NOT open").select("doc_id", "piece", "start", "length", "ids_crc32", _number("task", "bin", 0).alias("sequence_id"), "offset")
    merged = (
        pieces.filter("open").withColumnsRenamed({"task": "t0", "bin": "b0"}).join(place, ["t0", "b0"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", _number("task", "bin", 1).alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    )
    return closed.unionAll(merged)


def _number(task: str, bin_: str, low: int):
    return F.shiftleft(F.shiftleft(F.col(task).cast("long"), 36) + F.col(bin_), 1) + F.lit(low)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
