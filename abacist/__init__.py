"""Abacist: statistics, causal inference and training-data operators as Spark jobs."""
