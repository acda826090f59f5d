"""Paths and walks as ordered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_TYPES = ("P", "O")


def path_records(records: DataFrame) -> DataFrame:
    """(name, path_rank, steps): of each name the last record's steps, at the first record's place in the order."""
    own = records.where(F.col("rec_type").isin(*PATH_TYPES))
    return own.groupBy("name").agg(F.min("ord").alias("path_rank"), F.max_by("steps", "ord").alias("steps"))


def load_paths(records: DataFrame) -> DataFrame:
    """(name, path_rank, pos, node, orient): one row per step, positions from 0."""
    return path_records(records).select("name", "path_rank", F.posexplode("steps").alias("pos", "s")).select("name", "path_rank", "pos", F.col("s.seg").alias("node"), F.col("s.orient").alias("orient"))


def path_count(records: DataFrame) -> DataFrame:
    """(paths): path and walk records, repeated names included."""
    return records.where(F.col("rec_type").isin(*PATH_TYPES)).agg(F.count("*").alias("paths"))
