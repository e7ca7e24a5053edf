"""Sums of all that stands before, over any number of blocks, in levels.

A block's sum is one row.  Blocks are grouped by ``FAN`` neighbours and summed, until one
group is left; its running sums are handed down again, each group to its blocks.  No task
holds more than ``FAN`` rows of a level, and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring blocks whose running sums one task computes.
FAN = 4096


def ahead(sums: DataFrame, blocks: int, fan: int = FAN, backwards: bool = False) -> DataFrame:
    """(block, ahead) for sums (block, total), block from 0 to ``blocks`` - 1: the totals of the blocks before it, or after it if backwards.

    Blocks without a row count as zero and get none.
    """
    if fan < 2:
        raise ValueError("a group has two blocks or more")
    found = sums.select(F.col("block").cast("bigint").alias("block"), F.col("total").cast("bigint").alias("total"))
    return _ahead(found, max(int(blocks), 1), fan, F.desc("block") if backwards else F.asc("block"), backwards)


def _ahead(found: DataFrame, blocks: int, fan: int, order, backwards: bool) -> DataFrame:
    grouped = found.withColumn("group", F.floor(F.col("block") / fan))
    own = Window.partitionBy("group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.withColumn("inside", F.coalesce(F.sum("total").over(own), F.lit(0).cast("bigint")))
    if blocks <= fan:
        return inside.select("block", F.col("inside").alias("ahead"))
    totals = grouped.groupBy(F.col("group").alias("block")).agg(F.sum("total").alias("total"))
    above = _ahead(totals, -(-blocks // fan), fan, order, backwards).select(F.col("block").alias("group"), F.col("ahead").alias("above"))
    return inside.join(above, "group").select("block", (F.col("inside") + F.col("above")).alias("ahead"))


def running(frame: DataFrame, place: str, value: str, places: int, name: str = "running", size: int = 1 << 16, fan: int = FAN, backwards: bool = False) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over all rows from the first (or last, if backwards) place to their own.

    ``place`` is a distinct number from 0 to ``places`` - 1.  A task holds the rows of ``size`` places at once.
    """
    dealt = frame.withColumn("_block", F.floor(F.col(place) / size))
    before = ahead(dealt.groupBy(F.col("_block").alias("block")).agg(F.sum(value).alias("total")), -(-max(int(places), 1) // size), fan, backwards)
    own = Window.partitionBy("_block").orderBy(F.desc(place) if backwards else F.asc(place)).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("_inside", F.sum(value).over(own)).join(before.withColumnRenamed("block", "_block"), "_block")
    return inside.withColumn(name, (F.col("_inside") + F.col("ahead")).cast("bigint")).drop("_block", "_inside", "ahead")
