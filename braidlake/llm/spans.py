"""Long stretches of steps that occur verbatim in other records.

Relative Lempel-Ziv parsing. The reference is all records; its index holds, for every stretch of `least` steps, the first
and the last place where it occurs, and is cut into blocks by the hash of the stretch. A factor of at least `least` steps
begins with such a stretch, so a record visits only the blocks of its own stretches instead of all of them and
finds the same places. Each record is then cut into factors, a factor going on as long as its source does. Stretches that
begin before a factor's end and reach over it are looked up like all others, so no run is lost at a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators.skew import skewed_join
from braidlake.session import checkpointed, fair_share

#: The least number of stretches from which looking for heavy ones is worth while.
LEAST_HEAVY = 100_000
#: Odd multipliers of the two rolling hashes of a stretch, together 128 bits.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def rolled(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every `least` values in a row of each list (flat[starts[i]:starts[i] + lengths[i]]): which list, the place in it, and two polynomial hashes."""
    n = np.maximum(lengths - least + 1, 0)
    which = np.repeat(np.arange(len(lengths)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[which] + pos
    hashes = []
    for seed, multiplier in enumerate(MULTIPLIERS, 1):
        # values are scattered anew for each hash, so that the two share no weakness
        x = (flat ^ np.uint64(seed)) * np.uint64(multiplier)
        x ^= x >> np.uint64(29)
        h = np.zeros(max(0, len(flat) - least + 1), dtype=np.uint64)
        for k in range(least):
            h = h * np.uint64(multiplier) + x[k : k + len(h)]
        h = h[at]
        hashes.append(h ^ (h >> np.uint64(32)))
    return which, pos, hashes


def _stretches(records: DataFrame, least: int) -> DataFrame:
    """(record, pos, h1, h2): every `least` steps in a row, as 128 bits of hash. Each step is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column("hashes")
                lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                which, pos, (h1, h2) = rolled(flat, np.cumsum(lengths) - lengths, lengths, least)
                yield pa.RecordBatch.from_arrays([batch.column("record").take(pa.array(which)), pa.array(pos), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["record", "pos", "h1", "h2"])

    long = records.where(F.size("steps") >= least).select(F.col("record").cast("bigint").alias("record"), F.transform("steps", lambda x: F.xxhash64(x)).alias("hashes"))
    return long.mapInArrow(run, "record bigint, pos bigint, h1 bigint, h2 bigint")


def located(records: DataFrame, least: int = 12) -> DataFrame:
    """(record, pos, source, source_pos): the starts of stretches that another record has too, with one place there.

    `records` is (record, steps array of strings). Rows of the same record are one record, however often delivered.
    """
    stretches = _stretches(records, least)
    places = [F.min("record").alias("first"), F.min_by("pos", "record").alias("first_pos"), F.max("record").alias("last"), F.max_by("pos", "record").alias("last_pos"), F.count("*").alias("n")]
    index = checkpointed(stretches.groupBy("h1", "h2").agg(*places).where("first <> last"))
    # A stretch of a group of copies may be in a third of all records: such rows meet their entry by broadcast. The index
    # knows how often each occurs, and at most 1 / share of them can hold such a share.
    total = records.agg(F.sum(F.greatest(F.size("steps") - (least - 1), F.lit(0)))).collect()[0][0] or 0
    share = fair_share(records.sparkSession)
    heavy = [row[0] for row in index.where(F.col("n") >= F.lit(share * total)).select("h1").distinct().collect()] if total >= LEAST_HEAVY else []
    met = skewed_join(stretches, index.drop("n"), ["h1", "h2"], "inner", heavy=heavy)
    other = F.col("first") != F.col("record")
    places = met.select("record", "pos", F.when(other, F.col("first")).otherwise(F.col("last")).alias("source"), F.when(other, F.col("first_pos")).otherwise(F.col("last_pos")).alias("source_pos"))
    return places.repartition("record").dropDuplicates(["record", "pos"])


def factors(places: DataFrame, least: int = 12) -> DataFrame:
    """(record, start_pos, end_pos, source, source_pos): maximal pieces that go on in the same source, ends included."""
    order = Window.partitionBy("record").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    goes_on = (F.col("pos") - before("pos") == 1) & (F.col("source") == before("source")) & (F.col("source_pos") - before("source_pos") == 1)
    numbered = places.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_factor", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("record", "_factor").agg(F.min("pos").alias("start_pos"), (F.max("pos") + least - 1).alias("end_pos"), F.min("source").alias("source"), F.min("source_pos").alias("source_pos")).drop("_factor")


def shared_runs(factored: DataFrame) -> DataFrame:
    """(record, start_pos, end_pos): factors that overlap or touch made one run."""
    order = Window.partitionBy("record").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = factored.withColumn("_reach", reach).withColumn("_new", F.when(F.col("start_pos") > F.col("_reach") + 1, 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("record", "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_run")


def shared_spans(records: DataFrame, least: int = 12) -> DataFrame:
    """(record, start_pos, end_pos) of every maximal run of steps shared with another record, positions from 0.

    Records without steps, or with fewer than `least`, share nothing; runs repeated within one record only don't count.
    """
    return shared_runs(factors(located(records, least), least))


def shared_amounts(records: DataFrame, least: int = 12) -> DataFrame:
    """(record, n_steps, n_shared) for every record, null steps counting as none."""
    spans = shared_spans(records, least).groupBy("record").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("n_shared"))
    sizes = records.groupBy("record").agg(F.max(F.when(F.col("steps").isNotNull(), F.size("steps")).otherwise(0)).cast("bigint").alias("n_steps"))
    return sizes.join(spans, "record", "left").select("record", "n_steps", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"))
