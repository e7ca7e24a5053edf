"""Operators on k-mer tables and graphs."""
