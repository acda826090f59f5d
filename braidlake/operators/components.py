"""Connected components by alternating contraction.

Rounds of large-star and small-star joins (Kiveris et al., SoCC 2014) need about log(nodes) rounds, however deep the
graph is. Each round is written to the shared folder, which cuts the lineage and survives a lost executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators.skew import skewed_join
from braidlake.session import checkpointed

MOST_ROUNDS = 60
#: Pairs from which on a round looks for nodes that hold very many of them; below, one task can sort any node's.
LEAST_SKEWED = 1_000_000


def _short_round(pairs: DataFrame) -> DataFrame:
    """Both stars in one plan of two shuffles each: the least neighbour comes from a window instead of a join."""
    least = F.min("b").over(Window.partitionBy("a"))
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    large = both.withColumn("m", F.least("a", least)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).withColumn("m", least)
    moved = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return down.select(F.explode(moved).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return skewed_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = skewed_join(down, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(pairs: DataFrame) -> tuple:
    """The number of pairs and a sum of their hashes, which wraps: equal for equal sets of pairs."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).collect()[0])


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the component is the least node of it; isolated nodes are their own. Direction doesn't count.

    Edges at null and loops connect nothing. The rounds run when this is called.
    """
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    pairs = checkpointed(pairs)
    state = _state(pairs)
    for _ in range(MOST_ROUNDS):
        pairs = checkpointed(_short_round(pairs) if state[0] < LEAST_SKEWED else _small_star(checkpointed(_large_star(pairs))))
        before, state = state, _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return nodes.select(F.col(node).alias("node")).join(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
