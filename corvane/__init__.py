"""Corvane: retrieval, text-graph and corpus operators expressed as Spark plans."""

__version__ = "0.1.0"
