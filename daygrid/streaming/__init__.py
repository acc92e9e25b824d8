"""Incremental variants of the batch counts."""
