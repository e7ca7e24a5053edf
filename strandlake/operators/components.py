"""Connected components by alternating large-star and small-star rounds.

Each round is a pair of shuffles on the current edges.  The lineage is cut by a table in
the folder the cluster shares, which also gives the planner fresh sizes: frames that are
checkpointed in a loop carry size estimates that multiply with every join.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Where tables are settled, if not among the shared rounds.
_passing: ContextVar[str | None] = ContextVar("passing", default=None)


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset and all tasks run on this machine, a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def remove(spark, path: str) -> None:
    """Deletes a folder on any file system that Spark reads; one that isn't there is left so."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing(spark):
    """Tables that are settled within are deleted at the end; what is left must have been written elsewhere."""
    path = f"{shared_folder(spark)}/rounds/{uuid.uuid4().hex}"
    token = _passing.set(path)
    try:
        yield
    finally:
        _passing.reset(token)
        remove(spark, path)


def settle(frame: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder."""
    path = f"{_passing.get() or shared_folder(frame.sparkSession) + '/rounds'}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _settle_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Settled edges, with their number and a checksum taken while they are written."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    out = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), checksum.alias("s")))
    return out, (seen.get["n"], seen.get["s"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least vertex around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(vertex, component) for every vertex on an edge; component is the least vertex reachable.

    Self loops make a vertex a component of its own.  Null ends are dropped.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    now, before = _settle_edges(pairs.filter("a <> b").distinct())
    for _ in range(max_rounds if before[0] else 0):
        now, seen = _settle_edges(_small_star(_large_star(now)))
        if seen == before:
            break
        before = seen
    else:
        if before[0]:
            raise RuntimeError("the components haven't settled")
    stars = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    vertices = pairs.select(F.col("a").alias("vertex")).union(pairs.select(F.col("b").alias("vertex"))).distinct()
    return vertices.join(stars, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))
