"""Spark-native assembly-graph analytics.

Every operator takes and returns lazy DataFrames; nothing here starts a job at import.
"""

__version__ = "0.1.0"
