"""Exact nearest-neighbour joins and spatial partitioning of large point sets, as Spark DataFrame jobs."""
