"""Tables between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.operators.components import settle as cut

__all__ = ["cut", "remainder"]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
