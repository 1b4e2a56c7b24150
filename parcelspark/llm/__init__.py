"""Operators for training-data pipelines: filtering, joining, tokenising and writing corpora."""
