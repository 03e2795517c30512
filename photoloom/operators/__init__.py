"""Relational operators built on the column functions."""
