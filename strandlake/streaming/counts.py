"""k-mer counts kept up to date as reads arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.nucleotide import canonical, encode
from strandlake.operators.kmers import kmers
from strandlake.operators.superkmers import count_within


def read_lines(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A folder that text files are put into, one read a line, as a stream of encoded reads."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(encode(F.col("value")).alias("seq"))


def running_counts(stream: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) over all reads, or any text in seq, so far; for update or complete output.  Tasks count their own k-mers before the exchange."""
    return count_within(stream, k).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def windowed_counts(stream: DataFrame, k: int, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, kmer, cnt) by event time; windows close when the watermark passes, so append output works."""
    found = kmers(stream.withWatermark(time, late), k, keep=(time,))
    grouped = found.groupBy(F.window(time, width), canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("cnt"))
    return grouped.select(F.col("window.start").alias("start"), "kmer", "cnt")
