"""Spark analytics for batches of financial transactions, plus operators for training-data pipelines."""
