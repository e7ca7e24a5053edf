"""Rows of split text files with their place in the file, told from each split's own count.

A task knows where its split begins and in which order it reads rows, but not how many
rows stand before.  What a parser has to know of these is a number: how many lines, or how
many named records.  One pass counts a split's, running sums over the splits give
where each begins, and a second pass reads every split from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import prefix
from strandlake.operators.components import settle
from strandlake.operators.graph import dense_ids

PLACE = ["file", "block", "at"]


def rows(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """(value, file, block, at, size): what stands between separators; block is where the row's split begins, at orders a split's rows."""
    text = spark.read.option("lineSep", sep).text(files)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size")]
    return text.select("value", *place)


def _first(batches):
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        changes = pc.or_(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)))
        new = pa.concat_arrays([pa.array([(file[0].as_py(), block[0].as_py()) != before]), changes])
        before = file[-1].as_py(), block[-1].as_py()
        yield pa.RecordBatch.from_arrays([*batch.columns, pc.and_(new, pc.equal(block, 0))], names=[*batch.schema.names, "first"])


def firsts(found: DataFrame) -> DataFrame:
    """The rows with ``first``: whether a row is the first of its file."""
    return found.mapInArrow(_first, "value string, file string, block long, at long, size long, first boolean")


def begins(found: DataFrame, total: Column, fan: int = prefix.FAN, **more: Column) -> DataFrame:
    """(file, block, start, ahead, in_file, ...): of each split, its first row's ``at``, the total of the file's splits before it, and that of the whole file."""
    counted = found.groupBy("file", "block").agg(F.min("at").alias("start"), total.alias("total"), *[c.alias(name) for name, c in more.items()])
    numbered = settle(dense_ids(settle(counted).withColumn("key", F.struct("file", "block")), "key", first=0).drop("key"))
    before = prefix.ahead(numbered.select(F.col("id").alias("block"), "total"), numbered.count(), fan)
    placed = numbered.join(before.withColumnsRenamed({"block": "id", "ahead": "_ahead"}), "id")
    files = placed.groupBy("file").agg(F.min("_ahead").alias("_from"), F.sum("total").alias("in_file"))
    return settle(placed.join(files, "file").select("file", "block", "start", (F.col("_ahead") - F.col("_from")).alias("ahead"), "in_file", *more))


def numbered_lines(spark: SparkSession, files: list[str], fan: int = prefix.FAN) -> DataFrame:
    """(file, line, value, lines, ended): each line's number in its file from 0, how many there are, and whether the last one ends in a newline."""
    found = rows(spark, files, "\n")
    splits = begins(found, F.count(F.lit(1)), fan, octets=F.sum(F.octet_length("value") + 1), size=F.max("size"))
    sizes = splits.groupBy("file").agg((F.sum("octets") != F.max("size") + 1).alias("ended"))
    known = splits.join(sizes, "file").select("file", "block", "start", "ahead", F.col("in_file").alias("lines"), "ended")
    return found.join(settle(known), ["file", "block"]).select("file", (F.col("ahead") + F.col("at") - F.col("start")).alias("line"), "value", "lines", "ended")


def _groups(width: int):
    def group(batches):
        """Whole groups of lines that stand together in a batch are a row each; any other line is one by itself."""
        for batch in batches:
            line, value = batch.column("line").to_numpy(), batch.column("value")
            file = batch.column("file").dictionary_encode().indices.to_numpy()
            end = max(len(line) - width + 1, 0)
            together = line[:end] % width == 0  # a partition may hold splits in any order
            for j in range(1, width):
                together &= (line[j : j + end] == line[:end] + j) & (file[j : j + end] == file[:end])
            at = np.flatnonzero(together)
            alone = np.ones(len(line), bool)
            alone[(at[:, None] + np.arange(width)).reshape(-1)] = False
            rest = np.flatnonzero(alone)
            parts = [pa.concat_arrays([value.take(pa.array(at + j)), pc.if_else(pa.array(line[rest] % width == j), value.take(pa.array(rest)), pa.scalar(None, pa.string()))]) for j in range(width)]
            own = np.concatenate([at, rest])
            yield pa.RecordBatch.from_arrays(
                [batch.column("file").take(pa.array(own)), pa.array(line[own] // width), *parts, pa.array(np.arange(len(own)) < len(at))],
                names=["file", "record", *[f"l{j}" for j in range(width)], "whole"],
            )

    return group


def line_groups(lines: DataFrame, width: int) -> DataFrame:
    """(l0, l1, ...): each ``width`` lines of a file, by number; a last group that is cut short is dropped.

    Only lines of groups that lie over the ends of batches and splits are exchanged; the files are read
    once more for these, as a table of all lines would take more disk than a reading takes time.
    """
    names = [f"l{j}" for j in range(width)]
    schema = ", ".join(["file string, record long", *[f"{c} string" for c in names], "whole boolean"])
    found = lines.select("file", "line", "value").mapInArrow(_groups(width), schema)
    cut = found.filter("NOT whole").groupBy("file", "record").agg(*[F.max(c).alias(c) for c in names])
    return found.filter("whole").select(*names).unionAll(cut.filter(f"{names[-1]} IS NOT NULL").select(*names))


def carried(records: DataFrame, fan: int = prefix.FAN) -> DataFrame:
    """(id1, seq) of records (file, block, at, id1, seq), where the sequences of unnamed records are put before the next named one's of their file.

    Files without unnamed records stay as they are; unnamed records at a file's end are lost.
    """
    odd = records.filter("id1 = ''").select("file").distinct()
    plain = records.join(odd, "file", "left_anti").select("id1", "seq")
    placed = settle(dense_ids(records.join(odd, "file", "left_semi").withColumn("key", F.struct(*PLACE)), "key", first=0).withColumn("named", (F.col("id1") != "").cast("int")))
    summed = prefix.running(placed, "id", "named", placed.count(), fan=fan).withColumn("group", F.col("running") - F.col("named"))
    whole = summed.groupBy("file", "group").agg(F.max("id1").alias("id1"), F.sort_array(F.collect_list(F.struct("id", "seq"))).alias("parts"))
    return plain.unionAll(whole.filter("id1 <> ''").select("id1", F.concat_ws("", F.col("parts.seq")).alias("seq")))
