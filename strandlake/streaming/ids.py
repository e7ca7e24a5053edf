"""Numbers for keys that stay as they are while keys arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.components import passing
from strandlake.operators.graph import dense_ids
from strandlake.streaming.ledger import Ledger


class GrowingIds:
    """Ids from 1 without gaps: a batch's new keys are numbered in their order after all of the batches before.

    The numbers depend on which batch a key came in first, not on how rows are dealt to
    tasks.  A batch reads the known keys once and exchanges its own; new keys are
    dealt by ranges and numbered in each.  Null keys get no id.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key", key_type: str = "string"):
        self.key = key
        self.ledger = Ledger(spark, path, "n bigint", ids=f"`{key}` {key_type}, id bigint")

    def update(self, frame: DataFrame, batch: int) -> None:
        """Takes a batch in; for ``foreachBatch``.  Batches come in rising order; one that comes again must hold the same rows."""
        at = self.ledger.last(before=batch)
        known, n = self.ledger.upto("ids", at.batch if at else -1), at.n if at else 0
        new = frame.select(self.key).filter(F.col(self.key).isNotNull()).distinct().join(known, self.key, "left_anti")
        with passing(frame.sparkSession):
            self.ledger.write("ids", batch, dense_ids(new, self.key, first=n + 1).select(self.key, "id"))
        self.ledger.finish(batch, n + self.ledger.only("ids", batch).count())

    def ids(self) -> DataFrame:
        """(key, id) of the finished batches."""
        at = self.ledger.last()
        return self.ledger.upto("ids", at.batch if at else -1)
