"""Sparse matrices as text: Matrix Market and Harwell-Boeing out, Matrix Market in.

A matrix is (row, col, val) with numbers from 1.  Files are written as ordered parts of
a folder, whose concatenation is the file; ``single`` writes one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import prefix

BANNER = "%%MatrixMarket matrix coordinate integer general"
TITLE = "adjacency matrix of an overlap graph of k-mers"
# A fixed value: the label in the first card of the files that users of such tools have.
KEY = "padjmat"


def _write(lines: DataFrame, path: str, single: bool) -> None:
    """lines: (section, a, b, line); written in the order of the first three."""
    n = 1 if single else int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["section", "a", "b", "line"]
    lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("line").write.text(path)


def _head(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(lines)], "section int, a bigint, b bigint, line string")


def matrix_market_lines(matrix: DataFrame, n: int) -> DataFrame:
    m = matrix.count()
    body = matrix.select(F.lit(1).alias("section"), F.col("row").alias("a"), F.col("col").alias("b"), F.concat_ws(" ", "row", "col", "val").alias("line"))
    return _head(matrix.sparkSession, [BANNER, f"{n} {n} {m}"]).unionAll(body)


def column_pointers(matrix: DataFrame, n: int) -> DataFrame:
    """(col, ptr) for col = 1 .. n + 1: one more than the entries in the columns before it."""
    per = matrix.groupBy("col").agg(F.count("*").alias("c"))
    every = matrix.sparkSession.range(1, n + 2).withColumnRenamed("id", "col").join(per, "col", "left").select("col", F.coalesce("c", F.lit(0)).alias("c"))
    summed = prefix.running(every.withColumn("place", F.col("col") - 1), "place", "c", n + 1)
    return summed.select("col", (1 + F.col("running") - F.col("c")).cast("bigint").alias("ptr"))


def harwell_boeing_lines(matrix: DataFrame, n: int) -> DataFrame:
    m = matrix.count()
    cards = [
        f"{TITLE:<72}{KEY:<8}", "".join(f"{x:14d}" for x in (n + 2 * m + 1, n + 1, m, m, 0)),
        f"RUA{n:25d}{n:14d}{m:14d}{0:14d}", f"{'(1I11)':>16}{'(1I11)':>16}{'(1E9.0)':>20}{'':20}",
    ]
    pointers = column_pointers(matrix, n).select(F.lit(1).alias("section"), F.col("col").alias("a"), F.lit(0).cast("bigint").alias("b"), F.format_string("%11d", "ptr").alias("line"))
    rows = matrix.select(F.lit(2).alias("section"), F.col("col").alias("a"), F.col("row").alias("b"), F.format_string("%11d", "row").alias("line"))
    values = matrix.select(F.lit(3).alias("section"), F.col("col").alias("a"), F.col("row").alias("b"), F.format_string("%9d", "val").alias("line"))
    return _head(matrix.sparkSession, cards).unionAll(pointers).unionAll(rows).unionAll(values)


def write_matrix(matrix: DataFrame, n: int, path: str, fmt: str = "mm", single: bool = False) -> None:
    if fmt not in ("mm", "hb"):
        raise ValueError(f"fmt is mm or hb, not {fmt}")
    _write((matrix_market_lines if fmt == "mm" else harwell_boeing_lines)(matrix, n), path, single)


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((row, col, val), n, m) of an integer coordinate file; raises where the banner or the size line is wrong."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    banner = lines.filter(F.col("value").startswith("%%")).head(2)
    if [r["value"].rstrip() for r in banner] != [BANNER]:
        raise ValueError(f"{path} isn't an integer coordinate Matrix Market file")
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("x", F.split(F.trim("value"), "\\s+"))
    cells = [F.col("x")[i].cast("bigint").alias(c) for i, c in enumerate(("row", "col", "val"))]
    numbers = body.select(*cells, "file", "block", F.monotonically_increasing_id().alias("at"))
    # parts come in any order, so the size line is the first of the part with the banner
    size = numbers.filter(F.col("file") == banner[0]["file"]).orderBy("block", "at").first()
    if size is None or size["row"] != size["col"]:
        raise ValueError(f"{path} has no size line of a square matrix")
    mine = (F.col("file") == size["file"]) & (F.col("block") == size["block"]) & (F.col("at") == size["at"])
    return numbers.filter(~mine).select("row", "col", "val"), size["row"], size["val"]
