"""Semiring collections on Spark: every dataset is a map from keys to addable values."""
