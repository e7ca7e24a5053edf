"""File listing and spooling by Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from typing import BinaryIO

from pyspark.sql import SparkSession


def listed(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(file, size) of the files that paths (files, folders, patterns) name, in order; raises where there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: list[tuple[str, int]] = []
    for path in [paths] if isinstance(paths, str) else paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        found = fs.globStatus(place)
        if not found:
            raise FileNotFoundError(path)
        stack = sorted(found, key=lambda s: s.getPath().toString(), reverse=True)
        while stack:
            status = stack.pop()
            if status.isDirectory():
                stack += sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().toString(), reverse=True)
            elif not status.getPath().getName().startswith(("_", ".")):
                out.append((status.getPath().toString(), status.getLen()))
    return out


def spooled(spark: SparkSession, stream: BinaryIO, path: str, block: int = 1 << 20) -> str:
    """Copies a stream, a block at a time, to a file that every executor can read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        while data := stream.read(block):
            out.write(data)
    finally:
        out.close()
    return path
