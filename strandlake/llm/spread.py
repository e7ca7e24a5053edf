"""Dealing packed hash lists between document chunks and hash buckets.

Documents are dealt into chunks by a hash of doc_id.  A chunk sends each bucket of the
hash space one packed list of its distinct hashes; a bucket answers each chunk with one
byte per hash it sent, in the order sent.  A hash that fills a third of all documents
is one entry for each chunk, however many rows it has, so no bucket or task grows with
a hot key.  Lists are a pure function of the chunk's rows: a recomputed task sends the
same bytes, so lost executors cost only recomputation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENT = "bucket int, chunk int, keys binary, tags binary"
ANSWER = pa.schema([("chunk", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("marks", pa.binary())])
ANSWER_DDL = "chunk int, round int, bucket int, marks binary"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def chunks(spark: SparkSession) -> int:
    """Number of chunks: some for each of the session's shuffle partitions, which follow the data."""
    return 4 * partitions(spark)


def buckets(spark: SparkSession) -> int:
    """Number of buckets: one a partition, as every chunk sends a row to nearly every bucket."""
    return partitions(spark)


def chunk_of(doc_id: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n)).cast("int")


def by_chunk(docs: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The needed columns with their chunk, dealt by it.  Used several times in a plan, it is one exchange that Spark reuses."""
    picked = docs.select(chunk_of(F.col("doc_id"), n).alias("chunk"), *[F.col(c) for c in columns])
    return picked.repartition(partitions(docs.sparkSession), "chunk")


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """For sorted 64-bit keys, where each of the n buckets (by the top 32 bits) begins and the last ends."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))


def low32(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def packed(chunk: int, keys: np.ndarray, payload: np.ndarray, tags: np.ndarray, n: int) -> pa.Table:
    """Rows (bucket, chunk, keys, tags) for sorted keys; payload and tags are arrays of fixed width beside them."""
    bounds = bucket_bounds(keys, n)
    used = np.flatnonzero(np.diff(bounds))
    cut = [(int(bounds[b]), int(bounds[b + 1])) for b in used]
    return pa.table(
        {
            "bucket": pa.array(used.astype(np.int32)),
            "chunk": pa.array(np.full(len(used), chunk, np.int32)),
            "keys": pa.array([payload[a:b].tobytes() for a, b in cut], pa.binary()),
            "tags": pa.array([tags[a:b].tobytes() for a, b in cut], pa.binary()),
        }
    )


def joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All packed arrays of a column in one, with the length of each."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for c in column.chunks for x in c]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def answers(table: pa.Table, marks: np.ndarray, lengths: np.ndarray, number: int) -> pa.Table:
    """One row for each row received, with its part of marks."""
    ends = np.cumsum(lengths)
    return pa.table(
        {
            "chunk": table.column("chunk").combine_chunks(),
            "round": pa.array(np.full(table.num_rows, number, np.int32)),
            "bucket": table.column("bucket").combine_chunks(),
            "marks": pa.array([marks[e - k : e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary()),
        },
        schema=ANSWER,
    )


def answered(table: pa.Table, number: int, dtype=np.uint8) -> np.ndarray:
    """The marks of a chunk's round, in the order of its sorted keys."""
    import pyarrow.compute as pc

    part = table.filter(pc.equal(table.column("round"), number)).sort_by("bucket")
    return joined(part.column("marks"), dtype)[0]
