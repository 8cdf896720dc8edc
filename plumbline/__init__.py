"""Spark-native curation, validation and scoring of point-and-box annotation corpora."""

__version__ = "0.1.0"
