"""From reads to the adjacency matrix, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from strandlake.operators import graph, kmers
from strandlake.operators.components import settle


@dataclass
class Assembly:
    """The steps' tables; counts and edges are settled, as several others read them."""

    counts: DataFrame
    edges: DataFrame
    ids: DataFrame
    matrix: DataFrame

    def size(self) -> int:
        return self.ids.count()


def assemble(reads: DataFrame, k: int, *, saturate: int | None = None, seeds: int | None = None, multigraph: bool = False) -> Assembly:
    """``reads`` holds reads, encoded or not, in seq.  With ``seeds`` only components that the most frequent k-mers reach are kept."""
    counts = settle(kmers.count_canonical(reads, k, saturate=saturate))
    found = graph.edges(counts, k, multigraph)
    if seeds is not None:
        found = graph.reachable(settle(found), kmers.seeds(counts, seeds))
    edges = settle(found)
    ids = settle(graph.node_ids(edges))
    return Assembly(counts, edges, ids, graph.matrix(edges, ids))
