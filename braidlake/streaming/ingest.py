"""Files of lines as they arrive: an extension, as the text format itself knows no time.

The parser is stateless Column code, so it serves streams unchanged. Merged edges are kept as one row per edge by a stateful
aggregation; links counted per period are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions.records import parse_lines

EDGE_TYPES = ("L", "E", "C")


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(value, ord) of files appearing in `folder`; ord is the file's time, its name and the block.

    Streams can't number lines, so those of one block are of equal rank; where the order within a file matters, read it in batch.
    """
    text = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    ord_ = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return text.select("value", ord_.alias("ord"))


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of arriving files; those without enough fields are left out, so one of them doesn't stop the stream."""
    return parse_lines(stream_lines(spark, folder), "DROPMALFORMED")


def merged_edges(records: DataFrame) -> DataFrame:
    """(src, dst, orientation_from, orientation_to, n_records) so far: the last record of an edge wins, of equal rank the one with the greater orientations. For output mode update or complete."""
    edges = records.where(F.col("rec_type").isin(*EDGE_TYPES))
    last = F.max(F.struct("ord", "orientation_from", "orientation_to"))
    return edges.groupBy("src", "dst").agg(last.alias("last"), F.count("*").alias("n_records")).select("src", "dst", "last.orientation_from", "last.orientation_to", "n_records")


def links_per_period(rows: DataFrame, time: str = "loaded_at", period: str = "1 day", late: str = "7 days") -> DataFrame:
    """(period_start, from_segment, n_links) of a stream of link rows; rows later than `late` are dropped, so state stays bounded."""
    stamped = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", period).alias("w"), "from_segment").agg(F.count("*").alias("n_links")).select(F.col("w.start").alias("period_start"), "from_segment", "n_links")


def deduplicated(rows: DataFrame, time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Each rec_id once, however often it is delivered within `late`."""
    return rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(["rec_id"]).drop("_t")
