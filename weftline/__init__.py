"""Weftline: narrative-text analytics expressed as Spark DataFrames."""

__version__ = "0.2.0"
