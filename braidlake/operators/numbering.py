"""Dense numbers in a given order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.session import checkpointed

_LOW = (1 << 33) - 1


def at_key(df: DataFrame, key: str, values: dict[int, int], name: str) -> DataFrame:
    """`df` with the value of its whole-number key as `name`, null where there is none; `values` has an entry per task at most."""
    side = df.sparkSession.createDataFrame(list(values.items()), f"`{key}` bigint, `{name}` bigint")
    return df.withColumn(key, F.col(key).cast("bigint")).join(F.broadcast(side), key, "left")


def densely_numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """`df` with `name`: 0, 1, 2, ... in the given order.

    Rows are range-partitioned and sorted, and each partition's offset is added; the driver sees one count per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written first, as ranges are found by reading all rows once before they are moved
    ordered = checkpointed(df).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the numbers depend on the partitioning, so it is fixed before they are used
    fixed = checkpointed(ordered.withColumns({"_part": F.spark_partition_id(), "_low": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))}))
    counts = dict(fixed.groupBy("_part").count().collect())
    offsets, at = {}, 0
    for p in sorted(counts):
        offsets[p] = at
        at += counts[p]
    return at_key(fixed, "_part", offsets, "_offset").withColumn(name, F.col("_offset") + F.col("_low")).drop("_part", "_low", "_offset")
