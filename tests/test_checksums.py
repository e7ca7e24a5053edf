import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import hashing


def test_shifts_are_those_of_texts_that_go_on_and_come_back():
    draw = random.Random(5)
    for n in (0, 1, 7, 8, 300, 5000):
        a, b = draw.randbytes(draw.randrange(50)), draw.randbytes(n)
        first, second = (np.array([hashing.crc64_bytes(x)], np.uint64) for x in (a, b))
        moved = hashing.crc64_shift(first, np.array([n]))
        assert int((moved ^ second)[0]) == hashing.crc64_bytes(a + b)
        assert hashing.crc64_shift(moved, np.array([-n])) == first
    far = np.array([1 << 41, -(1 << 41)])
    there = hashing.crc64_shift(np.array([77, 77], np.uint64), far)
    assert hashing.crc64_shift(there, -far).tolist() == [77, 77]


def test_an_initial_value_goes_on_from_it(spark):
    rows = [("12345", "6789"), ("", "x"), ("x", ""), (None, "x"), ("x", None), ("é" * 40, "y" * 3000)]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(hashing.crc64(F.col("b"), hashing.crc64(F.col("a"))).alias("c")).collect()
    want = [None if None in row else np.uint64(hashing.crc64_bytes("".join(row).encode())).astype(np.int64) for row in rows]
    assert [r.c for r in got] == want


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 1000])
def test_parts_of_any_size_add_up_to_the_whole(spark, size):
    texts = {1: "GATTACA" * 30, 2: "", 3: None, 4: "é", 5: "x" * 101}
    frame = spark.createDataFrame(list(texts.items()), "id int, text string")
    parts = hashing.in_parts(frame, "text", size).repartition(3)
    got = {r.id: r.crc64 for r in hashing.crc64_of_parts(parts, "id").collect()}
    assert got == {i: None if t is None else int(np.uint64(hashing.crc64_bytes(t.encode())).astype(np.int64)) for i, t in texts.items()}
