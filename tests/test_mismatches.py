import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import nucleotide as nt


@pytest.mark.parametrize("most", [None, 3])
def test_equals_comparing_base_by_base(spark, most):
    rng = random.Random(5)
    rows = [("", "", 0), ("", "ACGT", 2), ("ACGT", "", 0), ("A" * 31, "A" * 31, 0), ("A" * 32, "T" * 40, 7), ("ACG", "ACG", 9), (None, "A", 0)]
    for _ in range(300):
        q = "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 5, 30, 31, 32, 62, 63, 100, 200])))
        s = "".join(rng.choice("ACGT") if rng.random() < 0.3 else c for c in "ACG" + q) + "ACGT" * rng.randint(0, 9)
        rows.append((q, s[: rng.randint(0, len(s))], rng.randint(0, 6)))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, s string, at int").repartition(3)
    got = {r.i: r.d for r in frame.select("i", nt.mismatches(F.col("q"), F.col("s"), F.col("at"), most).alias("d")).collect()}
    for i, (q, s, at) in enumerate(rows):
        if q is None:
            continue
        d = sum(j + at >= len(s) or q[j] != s[j + at] for j in range(len(q)))
        assert got[i] == (d if most is None else min(d, most)), (q, s, at)
