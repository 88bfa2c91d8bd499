"""Strandline: a PySpark-native engine for exact sequence k-mer analytics."""

__version__ = "0.1.0"
