"""Similarity analytics over large collections of small attributed graphs, as Spark plans."""

__version__ = "0.1.0"
