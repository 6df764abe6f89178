"""lexmill: lexical retrieval and text ingestion on Spark DataFrames."""

__version__ = "0.1.0"
