"""Reading lines, from files plain or gzipped, from standard input, or from memory."""

from __future__ import annotations

import sys
import uuid
import warnings
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions.records import parse_lines, unsupported_lines
from braidlake.session import shared_folder

#: Lines of a stream that the driver holds at a time.
PART = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord) of a file, folder or pattern; `.gz` files are unpacked, `-` is standard input.

    Only a line feed ends a line, so a carriage return stays in its last field. ord orders lines by file, block and place.
    """
    if path == "-":
        # bytes, as text mode would take a carriage return for the end of a line
        return from_lines(spark, getattr(sys.stdin, "buffer", sys.stdin))
    text = spark.read.option("lineSep", "\n").text(path)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return text.select("value", block.alias("ord"))


def from_lines(spark: SparkSession, lines: Iterable[str | bytes], part: int = PART) -> DataFrame:
    """(value, ord) of lines in memory or of an open stream, which is left open.

    No more than `part` lines are held at a time: a longer stream is written to the shared folder part by part.
    """
    schema = "ord bigint, value string"
    rows = enumerate((x.decode() if isinstance(x, bytes) else x).removesuffix("\n") for x in lines)
    held = list(islice(rows, part))
    if len(held) < part:
        return spark.createDataFrame(held, schema).select("value", "ord")
    folder = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    while held:
        spark.createDataFrame(held, schema).write.mode("append").parquet(folder)
        held = list(islice(rows, part))
    return spark.read.schema(schema).parquet(folder).select("value", "ord")


def warn_unsupported(lines: DataFrame) -> None:
    """One RuntimeWarning naming the first skipped line's letter, if there is one. Runs a job."""
    first = unsupported_lines(lines).agg(F.min_by(F.left("value", F.lit(1)), "ord")).collect()[0][0]
    if first is not None:
        warnings.warn(f"Skipping unsupported record: {first}", RuntimeWarning, stacklevel=2)


def read_records(spark: SparkSession, path: str, mode: str = "FAILFAST", strict_gfa2: bool = False, warn: bool = True) -> DataFrame:
    """Records of a file; see read_lines and parse_lines. A gzipped file is one split, so its records are spread anew."""
    lines = read_lines(spark, path)
    if warn:
        warn_unsupported(lines)
    records = parse_lines(lines, mode, strict_gfa2)
    return records.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else records
