"""All pairs of records whose sets overlap above a threshold.

Equal sets are made one class first. Classes get minwise hash signatures, cut into bands; classes sharing a band's bucket
are candidates, deduplicated and verified on the sets themselves. A bucket with more than a few classes is not paired
as it is: its classes are regrouped by the rarest items of their sets, of which two sets above the threshold share at least
one (prefix filter), so nothing is lost; a group that is still large is paired in salted parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.operators.skew import frequent_candidates, skewed_join, split_by_weight
from braidlake.session import checkpointed, fair_share

#: (bands, rows) by least threshold: a pair at the threshold is missed with a probability under 1e-7.
SIGNATURES = ((0.8, (32, 4)), (0.7, (42, 3)), (0.5, (58, 2)))
#: A bucket of at most so many classes is paired as it is.
CAP = 32
#: Items with at least this share of all items' occurrences come last in the order of the prefix filter.
COMMON = 0.0005


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finalizer of a well-known public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def band_buckets(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """For each set (flat[starts[i]:starts[i + 1]], not empty) one bucket per band: array (sets, bands) of uint64."""
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = np.empty((len(starts), bands), dtype=np.uint64)
    for band in range(bands):
        bucket = np.full(len(starts), band + 1, dtype=np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(_mixed(flat ^ seeds[band * rows + row]), starts)
            bucket = _mixed(bucket * np.uint64(31) + least)
        out[:, band] = bucket
    return out


def prefix_mask(flat: np.ndarray, lengths: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The items of which two sets above the threshold share one: the first n - ceil(t n) + 1 of each set, common items last.

    `common` holds the common items, most frequent first. Returns (items, how many of each set).
    """
    by_value = np.argsort(common)
    at = np.searchsorted(common[by_value], flat)
    at[at == len(common)] = 0
    rank = np.where(common[by_value][at] == flat, len(common) - by_value[at], 0) if len(common) else np.zeros(len(flat), np.int64)
    which = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((flat, rank, which))
    starts = np.cumsum(lengths) - lengths
    # 1e-9 keeps a product that is whole from being rounded up by floating-point error
    keep = lengths - np.ceil(lengths * threshold - 1e-9).astype(np.int64) + 1
    kept = np.arange(len(flat)) - np.repeat(starts, lengths) < np.repeat(keep, lengths)
    return flat[order][kept], keep


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _signed(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(class, items, hashes, buckets): hashed items and one bucket per band, kept together in one row per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat, lengths = _lists(batch.column("hashes"))
                buckets = band_buckets(flat.view(np.uint64), np.cumsum(lengths) - lengths, bands, rows).view(np.int64)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * batch.num_rows + 1, bands), pa.int32()), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "buckets"])

    hashed = classes.select("class", "items", F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    return hashed.mapInArrow(run, "class bigint, items array<string>, hashes array<bigint>, buckets array<bigint>")


def _prefixes(signed: DataFrame, common: list[int], threshold: float) -> DataFrame:
    """(class, item) for the items of each set's prefix."""
    ordered = np.array(common, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                items, keep = prefix_mask(*_lists(batch.column("hashes")), ordered, threshold)
                classes = batch.column("class").take(pa.array(np.repeat(np.arange(batch.num_rows), keep)))
                yield pa.RecordBatch.from_arrays([classes, pa.array(items)], ["class", "item"])

    return signed.select("hashes", "class").mapInArrow(run, "class bigint, item bigint")


def _sized(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups of at least two, with the group's size `n`. Sizes are summed on the map side; hot groups don't meet in one task."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return skewed_join(rows, sizes, keys, "inner")


def paired(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(a, b), a < b: all pairs of different values within a group; `rows` has the group's size `n`.

    Of a group each value goes to one of n / CAP parts and each part meets all values, so no task gets more than CAP * n pairs
    of a group.
    """
    parts = F.ceil(F.col("n") / CAP).cast("int")
    one = rows.withColumn("part", F.pmod(F.xxhash64(value), parts).cast("int")).select(*keys, "part", F.col(value).alias("x"))
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*keys, "part", F.col(value).alias("y"))
    return one.join(each, [*keys, "part"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def pairs_of_runs(keys: np.ndarray, classes: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b, of classes with equal neighbouring keys whose set sizes allow the threshold."""
    a, b = [], []
    for step in range(1, len(keys)):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        x, y = classes[same], classes[same + step]
        m, n = sizes[same], sizes[same + step]
        # the smaller set must be at least the threshold's share of the larger; 1e-9 is for floating-point error
        near = (x != y) & (np.minimum(m, n) >= threshold * np.maximum(m, n) - 1e-9)
        a.append(np.minimum(x, y)[near])
        b.append(np.maximum(x, y)[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _bucketed(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, key): the pairs within small buckets, key null; of buckets with over CAP classes each class as a, with the key and b null.

    `rows` is (key, class, size). Rows are shuffled once, by key, and come sorted; a bucket is held only up to CAP rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        rest = (none, none, none)

        def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
            null = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), null if b is None else pa.array(b), null if key is None else pa.array(key)], ["a", "b", "key"])

        def whole(key: np.ndarray, cls: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            begins = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0) != 0)
            lengths = np.diff(begins, append=len(key))
            many = np.repeat(lengths > CAP, lengths)
            yield out(cls[many], None, key[many])
            a, b = pairs_of_runs(key[~many], cls[~many], size[~many], threshold)
            yield out(a, b, None)

        overflowing = None  # the key of a bucket of which more than CAP rows have gone out already
        for batch in batches:
            key, cls, size = (np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("key", "class", "size"), strict=True))
            if overflowing is not None:
                over = key == overflowing
                yield out(cls[over], None, key[over])
                if over.all():
                    rest = (none, none, none)
                    continue
                key, cls, size, overflowing = key[~over], cls[~over], size[~over], None
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])
            yield from whole(key[:last], cls[:last], size[:last])
            rest = (key[last:], cls[last:], size[last:])
            if len(rest[0]) > CAP:
                overflowing = rest[0][0]
                yield out(rest[1], None, rest[0])
                rest = (none, none, none)
        yield from whole(*rest)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, key bigint")


def set_classes(sets: DataFrame, record: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(class, items) once per distinct set, and (class, record) once per record; the class is the least record of it.

    Null and empty sets don't count; null items are dropped. Record ids are whole numbers.
    """
    cleaned = sets.select(F.col(record).cast("bigint").alias("record"), F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("items")).where("size(items) > 0")
    # written once: making it reads and cleans every set
    keyed = checkpointed(cleaned.where("record is not null").withColumn("digest", F.md5(F.to_json("items"))))
    classes = checkpointed(keyed.groupBy("digest").agg(F.min("record").alias("class"), F.first("items").alias("items"), F.count("*").alias("n")))
    # the digest of a set that very many records have is met by broadcast; at most 1 / share digests are
    total = classes.agg(F.sum("n")).collect()[0][0] or 0
    heavy = [r[0] for r in classes.where((F.col("n") >= F.lit(fair_share(sets.sparkSession) * total)) & (F.col("n") > CAP)).select("digest").collect()]
    members = skewed_join(keyed.select("digest", "record"), classes.select("digest", "class"), ["digest"], heavy=heavy)
    return classes.select("class", "items"), members.select("class", "record").distinct()


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of different classes (class, items) whose sets have |A and B| / |A or B| >= threshold, which is at least 0.5."""
    if threshold < SIGNATURES[-1][0]:
        raise ValueError(f"thresholds under {SIGNATURES[-1][0]} have no signature")
    bands, rows = next(s for least, s in SIGNATURES if threshold >= least)
    signed = checkpointed(_signed(classes, bands, rows))
    buckets = signed.select(F.explode("buckets").alias("key"), "class", F.size("items").cast("bigint").alias("size"))
    # a bucket that would be more than a task's share is not brought together at all
    hot = frequent_candidates(buckets, "key", max(1e-4, fair_share(classes.sparkSession) / 4))
    light, heavy = split_by_weight(buckets, "key", hot)
    found = checkpointed(_bucketed(light, threshold).where("b is not null or key is not null"))
    candidates = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select("key", F.col("a").alias("class"))
    if hot:
        large = large.unionByName(heavy.select("key", "class"))
    if large.limit(1).count():
        # Large buckets are regrouped by rare items.
        common = frequent_candidates(signed.select(F.explode("hashes").alias("h")), "h", COMMON)
        regrouped = large.join(_prefixes(signed, common, threshold), "class").select("key", "item", "class")
        candidates = candidates.unionByName(paired(_sized(regrouped, ["item", "key"]), ["item", "key"], "class"))
    a, b = (signed.select(F.col("class").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = candidates.distinct().join(a, "a").join(b, "b").withColumn("n", F.size(F.array_intersect("items_a", "items_b")))
    return both.where(F.col("n") / (F.size("items_a") + F.size("items_b") - F.col("n")) >= F.lit(threshold)).select("a", "b")


def similar_records(sets: DataFrame, threshold: float, record: str = "rec_id", items: str = "items") -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs of records whose sets overlap at least to `threshold`, equal sets included.

    Records delivered repeatedly count once. Null and empty sets match nothing; ties on the threshold count; an empty
    table gives no pairs. Use `similar_classes` with `set_classes` where members of equal sets needn't be paired.
    """
    classes, members = set_classes(sets, record, items)
    members = checkpointed(members)
    pairs = similar_classes(classes, threshold)
    a, b = (members.select(F.col("class").alias(x), F.col("record").alias(f"r_{x}")) for x in "ab")
    across = pairs.join(a, "a").join(b, "b").select(F.least("r_a", "r_b").alias("rec_a"), F.greatest("r_a", "r_b").alias("rec_b")).where("rec_a < rec_b")
    within = paired(_sized(members, ["class"]), ["class"], "record").select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"))
    return across.unionByName(within)
