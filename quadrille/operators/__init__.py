"""Partitioning, tree building, overlap search, local kNN and merging, as DataFrame operators."""
