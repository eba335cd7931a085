"""Training-data operators: ten stages of a corpus pipeline as Spark jobs.

Nothing outside this folder imports it.
"""
