"""Adjacency matrices as coordinate rows, and their other sparse forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators.graph import Graph
from braidlake.operators.numbering import at_key, densely_numbered
from braidlake.operators.skew import frequent_candidates, skewed_join
from braidlake.schema import DTYPES, ITEM_BYTES
from braidlake.session import checkpointed


def node_index(graph: Graph) -> DataFrame:
    """(idx, node): nodes numbered from 0 by first appearance."""
    first = graph.appearances.groupBy("node").agg(F.min(F.struct("ord", "part")).alias("first"))
    return densely_numbered(first, ["first"], "idx").select("idx", "node")


def _value(graph: Graph, dtype: str) -> Column:
    return F.coalesce("weight", F.lit(1.0)).cast(DTYPES[dtype])


def triplets(graph: Graph, dtype: str = "float64") -> DataFrame:
    """(src, dst, value): an entry per edge before parallel ones are merged; two, mirrored, if direction doesn't count."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype: {dtype}")
    raw = graph.raw_edges.select("src", "dst", _value(graph, dtype).alias("value"))
    return raw if graph.options.matrix_directed else _with_mirrored(raw, "src", "dst")


def _with_mirrored(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every entry also the other way round, made from one reading of `df`."""
    both = F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b)))
    return df.select(F.explode(both).alias("e"), "value").select(f"e.{a}", f"e.{b}", "value")


def _summed(df: DataFrame, keys: list[str], dtype: str) -> DataFrame:
    total = F.bool_or("value") if dtype == "bool" else F.sum("value").cast(DTYPES[dtype])
    return df.groupBy(*keys).agg(total.alias("value"))


def coo_matrix(graph: Graph, index: DataFrame | None = None, dtype: str = "float64", asymmetric: bool = False) -> DataFrame:
    """(row, col, value) of the adjacency matrix.

    Repeated entries add up (bool: or). Unless asymmetric, a directed graph's matrix is made symmetric by the greater of an
    entry and its mirror, one that is missing counting as 0, and zeros are left out. Sums beyond the type's range raise an
    error. Entries are summed before they meet the index, and a node in very many of them is joined by broadcast.
    """
    index = node_index(graph) if index is None else index
    summed = checkpointed(_summed(triplets(graph, dtype), ["src", "dst"], dtype))
    heavy = frequent_candidates(summed, "dst")
    rows = skewed_join(summed, index.select(F.col("node").alias("src"), F.col("idx").alias("row")), ["src"])
    both = skewed_join(rows, index.select(F.col("node").alias("dst"), F.col("idx").alias("col")), ["dst"], heavy=heavy).select("row", "col", "value")
    if asymmetric or not graph.options.matrix_directed:
        return both
    mirrored = _with_mirrored(both, "row", "col")
    if dtype == "bool":
        return mirrored.groupBy("row", "col").agg(F.bool_or("value").alias("value")).where("value")
    best = mirrored.groupBy("row", "col").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    zero = F.lit(0).cast(DTYPES[dtype])
    return best.select("row", "col", F.when(F.col("n") == 1, F.greatest("value", zero)).otherwise(F.col("value")).alias("value")).where(F.col("value") != zero)


def compressed(coo: DataFrame, n: int, by: str = "row") -> tuple[DataFrame, DataFrame]:
    """(indptr, entries) of the CSR form, or of CSC with by="col".

    indptr is (k, start) for k = 0 .. n, entries is (pos, k, index, value) ordered by pos. No row is gathered, however many entries it has.
    """
    other = "col" if by == "row" else "row"
    entries = densely_numbered(coo.select(F.col(by).alias("k"), F.col(other).alias("index"), "value"), ["k", "index"], "pos").select("pos", "k", "index", "value")
    starts = entries.groupBy("k").agg(F.min("pos").alias("start"))
    total = entries.count()
    every = coo.sparkSession.range(n + 1).select(F.col("id").alias("k"))
    # an empty row starts where the next filled one does: carried backwards within ranges of k, then over whole ranges
    joined = every.join(starts, "k", "left")
    width = max(1, -(-(n + 1) // int(coo.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = joined.withColumn("_range", F.floor(F.col("k") / width))
    later = Window.partitionBy("_range").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    carried = ranged.withColumn("_start", F.min("start").over(later))
    firsts = dict(ranged.groupBy("_range").agg(F.min("start")).collect())  # one row per range
    after, following = total, {}
    for r in sorted(firsts, reverse=True):
        following[r] = after
        after = after if firsts[r] is None else firsts[r]
    nexts = at_key(carried, "_range", following, "_next")
    indptr = nexts.select("k", F.coalesce("_start", "_next").cast("bigint").alias("start"))
    return indptr, entries


def dok_matrix(coo: DataFrame) -> DataFrame:
    """(key struct<row, col>, value): one entry per key."""
    return coo.select(F.struct("row", "col").alias("key"), "value")


def convert_format(coo: DataFrame, fmt: str, n: int) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The matrix as csr, csc, coo or dok, in any case."""
    kind = fmt.lower()
    if kind in ("csr", "csc"):
        return compressed(coo, n, "row" if kind == "csr" else "col")
    if kind == "coo":
        return coo
    if kind == "dok":
        return dok_matrix(coo)
    raise ValueError(f"unknown matrix format: {fmt}")


def check_dense(n: int, nnz: int, dtype: str, max_dense_gb: float, by_nnz: bool = False) -> None:
    """MemoryError if the full matrix is larger than allowed; by_nnz counts only stored entries, which is far too little."""
    cells = nnz if by_nnz else n * n
    if cells * ITEM_BYTES[dtype] > max_dense_gb * 1e9:
        raise MemoryError(f"dense matrix of {cells * ITEM_BYTES[dtype] / 1e9:.1f} GB exceeds the limit of {max_dense_gb:g} GB")
