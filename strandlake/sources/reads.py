"""Reads from FASTA and FASTQ files, or from any text column.

All sources give (id1, seq, id2, qual).  By default the last record of a file counts and
carriage returns at line ends are dropped; ``compat`` loses the last FASTA record of
each file, and a last FASTQ record without a newline, as some older tools do, and keeps
carriage returns (which encode as A).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.nucleotide import encode
from strandlake.operators.components import settle
from strandlake.sources import splits
from strandlake.sources.files import listed

EXTENSIONS = {"fa": "fasta", "fasta": "fasta", "fna": "fasta", "ffn": "fasta", "fq": "fastq", "fastq": "fastq"}


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id1 string, seq string, id2 string, qual string")


def _fasta_record(record: Column, compat: bool) -> list[Column]:
    """Header line and joined sequence lines; blanks in them are deleted."""
    head = F.substring_index(record, "\n", 1)
    body = F.when(F.instr(record, "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise("")
    if not compat:
        head = F.regexp_replace(head, "\r$", "")
    drop = "[\n ]" if compat else "[\n\r ]"
    return [head.alias("id1"), F.regexp_replace(body, drop, "").alias("seq")]


def read_fasta(spark: SparkSession, paths: str | list[str], compat: bool = False) -> DataFrame:
    """Records begin with a > at a line's start; what stands before the first is ignored.

    Files are split anywhere between records.  The first row of a file is told by its place,
    so that it is dropped if it doesn't begin with >.  Under ``compat`` the last record
    of each file is left out, and an empty header adds its sequence to the next record's.
    """
    files = [f for f, n in listed(spark, paths) if n]
    if not files:
        return _empty(spark)
    rows = splits.firsts(splits.rows(spark, files, "\n>")).filter(F.col("value").startswith(">") | ~F.col("first"))
    record = F.when(F.col("first"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    found = rows.withColumn("record", record).select(*splits.PLACE, *_fasta_record(F.col("record"), compat))
    if compat:
        found = settle(found)
        last = found.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last")).select("file", "last.block", "last.at")
        found = splits.carried(found.join(last, splits.PLACE, "left_anti"))
    return found.select("id1", "seq", F.lit("").alias("id2"), F.lit("").alias("qual"))


def read_fastq(spark: SparkSession, paths: str | list[str], compat: bool = False) -> DataFrame:
    """Records are four lines each, by position: a quality line may begin with @.  A record cut short is dropped.

    Files are split anywhere between lines; a first pass counts the lines of the splits.
    """
    files = [f for f, n in listed(spark, paths) if n]
    if not files:
        return _empty(spark)
    lines = splits.numbered_lines(spark, files)
    if compat:  # without a last newline the last line, and so its record, isn't there
        lines = lines.filter("ended OR line < lines - 1")
    else:
        lines = lines.withColumn("value", F.regexp_replace("value", "\r$", ""))
    found = splits.line_groups(lines, 4)
    return found.select(F.regexp_replace("l0", "^@", "").alias("id1"), F.col("l1").alias("seq"), F.regexp_replace("l2", "^\\+", "").alias("id2"), F.col("l3").alias("qual"))


def read(spark: SparkSession, paths: str | list[str], fmt: str | None = None, compat: bool = False) -> DataFrame:
    """Reads of files of one format; without ``fmt`` their extensions tell it, .gz and the like aside."""
    if fmt is None:
        kinds = {EXTENSIONS.get(([x for x in f.lower().split("/")[-1].split(".")[1:] if x not in ("gz", "bz2", "zst")] or [""])[-1]) for f, _ in listed(spark, paths)}
        if len(kinds) != 1 or None in kinds:
            raise ValueError("the files' extensions don't tell one format; name it")
        fmt = kinds.pop()
    if fmt not in ("fasta", "fastq"):
        raise ValueError(f"fmt is fasta or fastq, not {fmt}")
    return (read_fasta if fmt == "fasta" else read_fastq)(spark, paths, compat)


def from_text(frame: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """A text column as encoded reads: (key, seq)."""
    return frame.filter(F.col(text).isNotNull()).select(*([key] if key else []), encode(F.col(text)).alias("seq"))


def encoded(reads: DataFrame) -> DataFrame:
    return reads.withColumn("seq", encode(F.col("seq")))


def write_fastq(reads: DataFrame, path: str) -> None:
    line = F.concat(F.lit("@"), "id1", F.lit("\n"), "seq", F.lit("\n+"), F.coalesce("id2", F.lit("")), F.lit("\n"), "qual")
    reads.select(line.alias("value")).write.text(path)


def write_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), "id1", F.lit("\n"), "seq").alias("value")).write.text(path)
