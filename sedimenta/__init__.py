"""Corpus preparation on Spark: classify, clean, rank, describe and pack tables of project files."""

__version__ = "0.1.0"
