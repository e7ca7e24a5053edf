"""Seeded samples and orders.

A row's draw is a pure function of its key columns and the seed: a task that runs again
draws the same, rows needn't meet, and rows with equal keys stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
DRAWS = 1 << 32


def digest_number(text: Column, at: int = 0) -> Column:
    """32 bits of a text's digest, the at-th of the four."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 8 * at + 1, 8), 16, 10).cast("bigint")


def draw(seed: int, *keys: str) -> Column:
    """A number from 0 to DRAWS - 1 for the keys' values; a null counts as an empty text."""
    return digest_number(F.concat_ws(":", F.lit(str(int(seed))), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def sample(frame: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """The rows whose draw falls below fraction; a greater fraction keeps a superset of the rows."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction is from 0 to 1, not {fraction}")
    return frame.filter(draw(seed, *(keys or frame.columns)) < round(fraction * DRAWS))
