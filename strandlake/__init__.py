"""Spark-native analytics over nucleotide reads: k-mers, overlap graphs, matrices."""

__version__ = "0.1.0"
