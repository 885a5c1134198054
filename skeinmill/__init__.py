"""Skeinmill: retrieval pipelines and training-data preparation as PySpark DataFrame programs."""

__version__ = "0.1.0"
