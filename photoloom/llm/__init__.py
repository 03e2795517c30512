"""Operators for building training data: selection, deduplication, grouping, tokenising and text checks."""
