"""Connected components kept up to date as edges arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.components import connected_components, passing, settle
from strandlake.streaming.ledger import Ledger

#: Merges that are kept apart from the folded ones at least, and the part of these that they may reach.
FEW_MERGES = 1 << 16
MERGE_SHARE = 4


class GrowingComponents:
    """A label for each vertex, once, and merges of labels.

    A new vertex is stored with the label its batch ends with, and never written again.  A
    label is the least vertex of its component; when components join, the greater labels are
    merged into the least.  A batch looks up the labels of its own vertices, contracts
    its edges to edges between labels, and solves these alone: it reads the known vertices
    once and works on no more edges than came.  Merges lead straight to the last label.  New ones are kept
    apart until they reach a quarter of the folded ones, so a merge is rewritten few times.

    Null ends are dropped; a self loop makes its vertex known.  An edge that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, vertex_type: str = "bigint", few_merges: int = FEW_MERGES):
        self.few_merges = few_merges
        merges = f"label {vertex_type}, root {vertex_type}"
        log = "vertices bigint, components bigint, folded bigint, folded_rows bigint"
        self.ledger = Ledger(spark, path, log, labels=f"vertex {vertex_type}, label {vertex_type}", recent=merges, folded=merges)

    def _roots(self, frame: DataFrame, at, *columns: str) -> DataFrame:
        """Rows with labels led to what they are merged into after batch ``at``."""
        if at is None:
            return frame
        for merges in (self.ledger.only("folded", at.folded), self.ledger.only("recent", at.batch)):
            for column in columns:
                to = merges.select(F.col("label").alias(column), F.col("root").alias("_to"))
                frame = frame.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
        return frame

    def update(self, edges: DataFrame, batch: int, a: str = "a", b: str = "b") -> None:
        """Takes a batch of edges in; for ``foreachBatch``.  Batches come in rising order; one that comes again must hold the same rows."""
        at = self.ledger.last(before=batch)
        with passing(edges.sparkSession):
            self._take(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), batch, at)
        before = self.ledger.last(before=at.batch) if at else None
        if before:  # batch ``at`` may be gone back to, none before it
            self.ledger.drop("recent", before.batch)
            if before.folded not in (-1, at.folded):
                self.ledger.drop("folded", before.folded)

    def _take(self, edges: DataFrame, batch: int, at) -> None:
        pairs = settle(edges.filter("a IS NOT NULL AND b IS NOT NULL").distinct())
        ends = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
        stored = self._roots(ends.join(self.ledger.upto("labels", at.batch if at else -1), "vertex", "left"), at, "label")
        named = settle(stored.select("vertex", F.coalesce("label", "vertex").alias("label"), F.col("label").isNull().alias("new")))
        tops = named.select("vertex", "label")
        over = pairs.join(tops.toDF("a", "la"), "a").join(tops.toDF("b", "lb"), "b").select("la", "lb").distinct()
        joined = settle(connected_components(over, "la", "lb").select(F.col("vertex").alias("label"), F.col("component").alias("root")))

        self.ledger.write("labels", batch, named.filter("new").join(joined, "label").select("vertex", F.col("root").alias("label")))
        old = named.filter("NOT new").select("label").distinct()
        merges = settle(joined.filter("label <> root").join(old, "label", "left_semi"))
        recent, folded, folded_rows = merges, -1, 0
        if at is not None:
            moved = self.ledger.only("recent", at.batch).join(merges.toDF("root", "_to"), "root", "left")
            recent = settle(moved.select("label", F.coalesce("_to", "root").alias("root")).unionAll(merges))
            folded, folded_rows = at.folded, at.folded_rows
        n_recent = recent.count()
        if n_recent > max(self.few_merges, folded_rows // MERGE_SHARE):
            moved = self.ledger.only("folded", folded).join(recent.toDF("root", "_to"), "root", "left")
            self.ledger.write("folded", batch, moved.select("label", F.coalesce("_to", "root").alias("root")).unionAll(recent))
            folded, folded_rows, recent = batch, folded_rows + n_recent, recent.limit(0)
        self.ledger.write("recent", batch, recent)

        new = self.ledger.only("labels", batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vertex") == F.col("label")).alias("own")).first()
        vertices, components = (at.vertices, at.components) if at else (0, 0)
        self.ledger.finish(batch, vertices + new.n, components + new.own - merges.count(), folded, folded_rows)

    def components(self) -> DataFrame:
        """(vertex, component) after the last finished batch; component is the least vertex reachable."""
        at = self.ledger.last()
        labels = self.ledger.upto("labels", at.batch if at else -1)
        return self._roots(labels, at, "label").select("vertex", F.col("label").alias("component"))

    def totals(self) -> tuple[int, int]:
        """How many vertices and components there are, from the log."""
        at = self.ledger.last()
        return (at.vertices, at.components) if at else (0, 0)
