"""Language identification by compression with per-language dictionaries.

Training takes a bounded sample of labelled documents (``sample_docs`` a language, up to
``sample_bytes`` from the middle of each) as the raw content of one zstandard dictionary
per language.  Each half of the sample is first predicted with the other half's
dictionaries, and documents that seem to be in another language than their label are
left out.  A text is compressed, in segments, with each dictionary; the language with
the smallest total wins.  ``rejected`` tells that the margin over the second is narrow.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected.  Ties go to the language first in the alphabet.  With no labelled document
every text is ``und``.  Repeated rows are predicted alike.  In the query a row without a
doc_id counts as held out: it is predicted and teaches nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.store import remainder

SAMPLE_DOCS = 256
SAMPLE_BYTES = 1024
#: Languages that are told apart at most: the model is sent to every executor.
MAX_LANGUAGES = 200
SEGMENT_BYTES = 16384
LEVEL = 3
#: A margin over the second language of less than this share of its size is rejected.
MIN_MARGIN = 0.02

_DROP = bytes(b for b in range(128) if not chr(b).isalpha() and b not in (32, 39))


def normal(text: str) -> bytes:
    """Lower case, letters and single blanks only."""
    raw = text.lower().translate(_BLANKS).encode("utf-8", "ignore").translate(None, _DROP)
    return b" ".join(raw.split())


_BLANKS = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


class Model:
    def __init__(self, samples: dict[str, bytes]):
        self.samples = dict(sorted(samples.items()))
        self._coders: list | None = None

    def __getstate__(self):
        return self.samples

    def __setstate__(self, state):
        self.samples, self._coders = state, None

    def coders(self) -> list:
        if self._coders is None:
            self._coders = []
            for raw in self.samples.values():
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=LEVEL)
                self._coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._coders

    def sizes(self, raw: bytes) -> list[int]:
        parts = [raw[i : i + SEGMENT_BYTES] for i in range(0, len(raw), SEGMENT_BYTES)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders()]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        raw = normal(text) if text else b""
        if not self.samples or not raw.strip(b" '") or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = np.array(self.sizes(raw), float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return next(iter(self.samples)), 1.0, False
        second = float(np.partition(sizes, 1)[1])
        # bytes saved are bits of evidence; a short text proves little
        score = 1.0 / float(np.exp2(np.minimum(0, sizes.min() - sizes) / 2).sum())
        return list(self.samples)[best], score, second - sizes[best] < MIN_MARGIN * second


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows of ``docs`` (text, lang): for each language the documents with the lowest hash."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    langs = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    low = known.filter(F.col("lang").isin(langs)).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    ids = low.filter(F.col("rank") <= sample_docs).select("doc_id").distinct()
    rows = (
        docs.filter("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids), "doc_id", "left_semi")
        .select("lang", "doc_id", _middle(sample_bytes).alias("text"))
    )
    # an id may stand in any number of rows: rank these before they are collected
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs).collect()
    parts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        raw = normal(r.text)[:sample_bytes]
        if raw and r.lang in langs and len(mine := parts.setdefault(r.lang, [])) < sample_docs:
            mine.append(raw)
    return fit(parts)


def _middle(n: int):
    return F.expr(f"substring(text, cast(greatest(1, length(text) div 2 - {n}) as int), {2 * n})")


def fit(parts: dict[str, list[bytes]]) -> Model:
    """A model from samples, without those whose label the rest of the sample contradicts."""
    halves = [Model({k: b" ".join(v[i::2]) for k, v in parts.items() if v[i::2]}) for i in (0, 1)]
    kept: dict[str, list[bytes]] = {}
    for lang, texts in parts.items():
        for i, raw in enumerate(texts):
            other = halves[1 - i % 2]
            sizes = dict(zip(other.samples, other.sizes(raw), strict=True))
            if lang not in sizes or sizes[lang] == min(sizes.values()):
                kept.setdefault(lang, []).append(raw)
    return Model({k: b" ".join(kept.get(k) or v) for k, v in parts.items()})


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred, score, rejected beside the kept columns, from the whole text of each row."""
    picked = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES dictionaries of sample_docs * sample_bytes at most

    def predict(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*keep, "lang_pred", "score", "rejected"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in keep)
    return picked.mapInArrow(predict, f"{kept}, lang_pred string, score double, rejected boolean")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(True))  # a row without an id teaches nothing
    model = train(docs.filter(~held))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return identify(marked, model, ("doc_id", "held_out"))
