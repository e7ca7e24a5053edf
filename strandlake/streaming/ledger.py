"""Tables that grow by batches, in a folder that driver and executors share.

A batch writes its tables, then one row to the log: only batches in the log count, and a
batch that runs again writes the same folders anew, so a restart repeats the last batch
and changes nothing before it.  One stream at a time may write to a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.components import remove


class Ledger:
    """A log of finished batches and the tables, by name and DDL, that they wrote."""

    def __init__(self, spark: SparkSession, path: str, log: str, **tables: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ddl = {"log": log, **tables}
        for name, ddl in self.ddl.items():  # an empty first batch, so that every table can be read
            spark.createDataFrame([], ddl).write.mode("ignore").parquet(self._folder(name, -1))

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def write(self, name: str, batch: int, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(self._folder(name, batch))

    def only(self, name: str, batch: int) -> DataFrame:
        """What a batch wrote to a table."""
        return self.spark.read.schema(self.ddl[name]).parquet(self._folder(name, batch))

    def upto(self, name: str, batch: int) -> DataFrame:
        """What a table's batches wrote, the given one included."""
        return self.spark.read.schema(f"{self.ddl[name]}, batch bigint").parquet(f"{self.path}/{name}").filter(F.col("batch") <= batch).drop("batch")

    def finish(self, batch: int, *fields) -> None:
        self.write("log", batch, self.spark.createDataFrame([fields], self.ddl["log"]).coalesce(1))

    def last(self, before: int | None = None) -> Row | None:
        """The log's row, with its batch, of the last finished batch (before the given one)."""
        log = self.spark.read.schema(f"{self.ddl['log']}, batch bigint").parquet(f"{self.path}/log")
        return (log if before is None else log.filter(F.col("batch") < before)).orderBy(F.desc("batch")).first()

    def drop(self, name: str, batch: int) -> None:
        remove(self.spark, self._folder(name, batch))
