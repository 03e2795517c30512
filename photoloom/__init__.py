"""Photoloom: photo-archive curation and data-quality analytics as Spark DataFrame programs."""

__version__ = "0.1.0"
