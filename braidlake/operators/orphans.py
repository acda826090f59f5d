"""References to keys that are absent, deleted or not yet loaded at the time of the reference.

Skew-aware: references are summed per key first, to the period from its first to its last reference, on the map side, so
that a hot key is a row per task. A key present all through its period has no orphan. Only references to the remaining
keys are looked at one by one: those to heavy keys against a broadcast of the keys' periods of presence, the others in a
shuffled anti-join; the orphans of both are unioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators.skew import fits_broadcast, frequent_candidates, split_by_weight
from braidlake.session import checkpointed, unused

#: After any time that occurs.
FOREVER = "9999-12-31 00:00:00"
#: Rows of keys that may be sent to all tasks; fits_broadcast bounds their bytes as well.
MOST_KEYS = 500_000


def merged_periods(periods: DataFrame, within: list[str]) -> DataFrame:
    """Overlapping or touching periods (start, stop) of each group made one; the group columns `within` are kept."""
    order = Window.partitionBy(*within).orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.col("_reach"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = periods.withColumn("_reach", reach).withColumn("_island", island)
    return marked.groupBy(*within, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")


def presence(rows: DataFrame, key: str = "seg_id", loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(key, start, stop): the time a row is present, [loaded, deleted). Rows without key or load time are never present."""
    stop = F.coalesce(F.col(deleted), F.lit(FOREVER).cast("timestamp_ntz"))
    out = rows.select(F.col(key), F.col(loaded).alias("start"), stop.alias("stop"))
    return out.where(F.col(key).isNotNull() & (F.col(key) != "") & (F.col("start") < F.col("stop")))


def presence_islands(periods: DataFrame, heavy: list) -> DataFrame:
    """(seg_id, start, stop), merged. Periods of the given heavy keys are merged by day first, so that many tasks share a key."""
    light, hot = split_by_weight(periods, "seg_id", heavy)
    islands = merged_periods(light, ["seg_id"])
    if not heavy:
        return islands
    by_day = merged_periods(hot.withColumn("_day", F.to_date("start")), ["seg_id", "_day"]).drop("_day")
    return islands.unionByName(merged_periods(by_day, ["seg_id"]))


def suspects(refs: DataFrame, islands: DataFrame) -> DataFrame:
    """(seg_id): keys that are not present from their first reference to their last. References without time are left out.

    What is shuffled is one row per key and task.
    """
    spans = refs.where("t is not null").groupBy("seg_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    held = islands.select("seg_id", "start", "stop")
    return spans.join(held, (spans.seg_id == held.seg_id) & (held.start <= spans["first"]) & (spans["last"] < held.stop), "left_anti").select("seg_id")


def _month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t)


def _absent(refs: DataFrame, islands: DataFrame, heavy: list) -> DataFrame:
    """The rows of refs at a time when their key is on no island; heavy keys by broadcast, or by key and month if they have too many islands."""
    key, start, stop, month = (unused(x, refs.columns) for x in ("key", "start", "stop", "month"))
    named = islands.select(F.col("seg_id").alias(key), F.col("start").alias(start), F.col("stop").alias(stop))
    hit = (F.col("seg_id") == F.col(key)) & (F.col(start) <= F.col("t")) & (F.col("t") < F.col(stop))
    (light, hot), (light_side, hot_side) = split_by_weight(refs, "seg_id", heavy), split_by_weight(named, key, heavy)
    found = light.join(light_side, hit, "left_anti")
    if not heavy:
        return found
    if fits_broadcast(hot_side):
        return found.unionByName(hot.join(F.broadcast(hot_side), hit, "left_anti"))
    least, most = hot.agg(F.min(_month(F.col("t"))), F.max(_month(F.col("t")))).collect()[0]
    if least is None:
        return found.unionByName(hot)
    clipped = [F.greatest(_month(F.col(start)), F.lit(least)), F.least(_month(F.col(stop)), F.lit(most))]
    by_month = hot_side.where(clipped[0] <= clipped[1]).withColumn(month, F.explode(F.sequence(*clipped)))
    marked = hot.withColumn("_at", F.coalesce(_month(F.col("t")), F.lit(0)))
    return found.unionByName(marked.join(by_month, hit & (F.col("_at") == F.col(month)), "left_anti").drop("_at"))


def orphan_references(refs: DataFrame, periods: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of `refs` (seg_id, t, and any other columns) whose key is not present at t according to `periods` (seg_id, start, stop).

    Null and empty keys are no references. A reference without time is an orphan, as no row was loaded by then. Repeated
    rows stay repeated. With empty periods every reference is an orphan; empty refs give an empty result. Keys with more than
    `share` of the references or of the periods (default: a task's fair share) are heavy.
    """
    refs = refs.where(F.col("seg_id").isNotNull() & (F.col("seg_id") != ""))
    often = frequent_candidates(periods, "seg_id", share)
    keys = checkpointed(suspects(refs, presence_islands(periods, often)))
    heavy = frequent_candidates(refs, "seg_id", share)
    untimed, timed = refs.where("t is null"), refs.where("t is not null")
    if fits_broadcast(keys, MOST_KEYS):
        # the few references in question are told where they are read
        keys = F.broadcast(keys)
        return _absent(timed.join(keys, "seg_id", "left_semi"), presence_islands(periods.join(keys, "seg_id", "left_semi"), often), heavy).unionByName(untimed)
    (light, hot), (light_keys, hot_keys) = split_by_weight(timed, "seg_id", heavy), split_by_weight(keys, "seg_id", heavy)
    asked = light.join(light_keys, "seg_id", "left_semi").unionByName(hot.join(F.broadcast(hot_keys), "seg_id", "left_semi"))
    return _absent(asked, presence_islands(periods, often), heavy).unionByName(untimed)


def first_delivery_only(found: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Of `found` (rec_id, t, ...), the rows at the earliest t of their record; `deliveries` is (rec_id, t) of all rows as delivered.

    Only deliveries of records in `found` are compared, and only records delivered more than once can differ; t null counts as latest.
    """
    first = unused("first", found.columns)
    records = found.select("rec_id").distinct()
    mine = deliveries.join(F.broadcast(records) if fits_broadcast(records, MOST_KEYS) else records, "rec_id", "left_semi")
    again = mine.groupBy("rec_id").agg(F.min("t").alias(first), F.count("*").alias("n_deliveries")).where("n_deliveries > 1")
    joined = found.join(again.select("rec_id", first), "rec_id", "left")
    return joined.where(F.col(first).isNull() | F.col("t").eqNullSafe(F.col(first))).drop(first)


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per referring table and month of the reference: (table_name, month, n_orphans, n_records, n_keys)."""
    per_key = found.groupBy("table_name", F.date_trunc("month", "t").alias("month"), "seg_id", "rec_id").agg(F.count("*").alias("_n"))
    by = ["table_name", "month"]
    return per_key.groupBy(*by).agg(F.sum("_n").alias("n_orphans"), F.count_distinct("rec_id").alias("n_records"), F.count_distinct("seg_id").alias("n_keys"))
