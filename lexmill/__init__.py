"""lexmill: a PySpark-native analytics engine for citation-linked document corpora."""

__version__ = "0.1.0"
