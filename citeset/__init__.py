"""citeset: citation-grounded retrieval data sets, built on Spark DataFrames."""

__version__ = "0.1.0"
