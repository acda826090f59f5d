"""Per-key results when a few keys hold most rows.

Heavy keys are found by a frequent-items sketch (one bounded row per task, no shuffle of the data), confirmed by exact
counts, and joined by broadcast; the remaining keys go through an ordinary shuffle; the two results are unioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.session import fair_share, unused

#: Rows and bytes of the other side that may be broadcast for the heavy keys; beyond them the heavy keys are salted instead.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32_000_000
#: A sketch with m counters undercounts a key by at most 3.5 / m of all rows; 32 / share keeps that under a ninth of the share.
COUNTERS_PER_SHARE = 32
#: Heavy keys that are written into a plan as values; more are a small table in it.
MOST_VALUES = 256


def _counters(share: float) -> int:
    return 1 << max(10, int(COUNTERS_PER_SHARE / share - 1).bit_length())


def _sketched(df: DataFrame, key: str, share: float) -> tuple[list, int]:
    """Candidates and the number of all rows. The driver gets one row of at most 2 / share keys."""
    top = F.expr(f"approx_top_k(`{key}`, {int(2 / share)}, {_counters(share)}) FILTER (WHERE `{key}` IS NOT NULL)")
    found, n = df.agg(top.alias("top"), F.count("*").alias("n")).collect()[0]
    return [item["item"] for item in found or [] if item["count"] >= share * n / 2], n


def frequent_candidates(df: DataFrame, key: str, share: float | None = None) -> list:
    """Every key with at least `share` of all rows (default: a task's fair share), and possibly a few more; at most 2 / share keys."""
    return _sketched(df, key, share or fair_share(df.sparkSession))[0]


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least `share` of all rows, with their exact count: (key, n_rows, n_total).

    Null keys count towards the total and never come out; an empty table gives no row. Candidates come from the sketch,
    which misses none; they are counted exactly in one pass with map-side sums, so a key on the threshold is decided rightly.
    """
    found, n = _sketched(df, key, share)
    counted = df.where(F.col(key).isin(found)).groupBy(key).agg(F.count("*").alias("n_rows"))
    return counted.withColumn("n_total", F.lit(n).cast("bigint")).where(F.col("n_rows") >= F.lit(share) * n)


def split_by_weight(df: DataFrame, key: str, heavy: list) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, null ones included, rows of the heavy keys), without a shuffle."""
    if len(heavy) <= MOST_VALUES:
        is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
        return df.where(~is_heavy), df.where(is_heavy)
    keys = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in heavy], df.select(key).schema))  # at most 2 / share
    return df.join(keys, key, "left_anti").select(df.columns), df.join(keys, key, "left_semi").select(df.columns)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether `df` has at most so many rows and bytes (as text). Runs a job over no more rows than that."""
    text = F.length(F.to_json(F.struct(*df.columns)))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(text), F.lit(0))).collect()[0]
    return n <= rows and total <= size


def skewed_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", share: float | None = None, heavy_on: str | None = None, broadcast_rows: int = BROADCAST_ROWS, heavy: list | None = None) -> DataFrame:
    """`big` joined with `small` on equal columns `on`; `how` is inner, left, left_semi or left_anti.

    heavy_on names the one column of `on` by which heavy keys are told (default: the first); where they are known already,
    `heavy` lists them and `big` isn't read for them. Rows of a heavy key meet a
    broadcast of small's rows for the heavy keys. If those are more than `broadcast_rows`, the heavy rows of big are
    salted and small's are repeated for each salt, so that no key is handled by one task. Null keys match nothing.
    Columns of both sides other than `on` must have different names.
    """
    key = heavy_on or on[0]
    found = frequent_candidates(big, key, share) if heavy is None else heavy
    if not found:
        return big.join(small, on, how)
    (light_big, heavy_big), (light_small, heavy_small) = split_by_weight(big, key, found), split_by_weight(small, key, found)
    light = light_big.join(light_small, on, how)
    if fits_broadcast(heavy_small, broadcast_rows):
        joined = heavy_big.join(F.broadcast(heavy_small), on, how)
    else:
        salt = unused("salt", [*big.columns, *small.columns])
        salts = max(8, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salted = heavy_big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in on] or [F.monotonically_increasing_id()]), F.lit(salts)).cast("int"))
        repeated = heavy_small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(repeated, [*on, salt], how).drop(salt)
    return light.unionByName(joined)


def count_distinct_pairs(df: DataFrame, key: str, value: str, rows: str, distinct: str) -> DataFrame:
    """Per key the number of rows and of distinct values.

    Grouping by (key, value) first spreads a hot key over all tasks and sums on the map side; the second grouping gets at
    most one row per key and task. A null key forms its own group; null values count as rows but not as values.
    """
    pairs = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    return pairs.groupBy(key).agg(F.sum("_n").alias(rows), F.count(value).alias(distinct))


def per_key(df: DataFrame, side: DataFrame, key: str, value: str, rows: str, distinct: str, heavy: list | None = None) -> DataFrame:
    """Per key of `df` the number of rows and of distinct values, with the columns of its one row in `side`, null without one.

    Rows of heavy keys are spread by (key, value) and their results meet a broadcast of side's rows for these keys;
    the rest is shuffled once by key, in which it is counted and joined; the union has every key once. `side` has at
    most one row per key. Null keys have no row; null values count as rows only.
    """
    df = df.where(F.col(key).isNotNull())
    found = frequent_candidates(df, key) if heavy is None else heavy
    (light, hot), (light_side, hot_side) = split_by_weight(df, key, found), split_by_weight(side, key, found)
    counted = count_distinct_pairs(light.repartition(key), key, value, rows, distinct).join(light_side, key, "left")
    if not found:
        return counted
    # at most 2 / share keys, each with one row
    return counted.unionByName(count_distinct_pairs(hot, key, value, rows, distinct).join(F.broadcast(hot_side), key, "left"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
