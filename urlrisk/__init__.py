"""Malicious-URL analytics on Spark: curation, lexical features, balancing,
training, scoring, all as DataFrame and Spark ML jobs."""

__version__ = "0.1.0"
