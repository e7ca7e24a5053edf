"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs.  All but the last return the columns of
documents: quality rules drop rejected documents, the n-gram join keeps the smallest
doc_id of each group of near copies (five words, similarity 0.8), substring dedup
rewrites texts without the passages that an earlier document has, decontamination drops
documents that hold benchmark items, and packing returns one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, ngram_join, packing, quality_rules, substring_dedup
from strandlake.llm.store import cut

#: No SQL: packing and token ids can't be expressed; tests compare with brute force.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.quality_filter(docs).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; rows without an id stay."""
    found = ngram_join.components(docs, k=5, percent=80)
    others = found.filter("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(others, "doc_id", "left_anti")
    if _repeats(docs):  # rows of one id are one document: the least of them, null before any text
        least = left.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
        left = least.select("doc_id", "row.*").unionAll(left.filter("doc_id IS NULL").select(*COLUMNS))
    return left.select(*COLUMNS)


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").head(1))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that an earlier document has; a text that loses nothing stays as it is."""
    found = substring_dedup.substring_dedup(docs, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = cut(decontaminate.contaminated_pairs(docs, items).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as best fit finds."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_free),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
