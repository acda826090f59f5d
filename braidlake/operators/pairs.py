"""Numbers of connected pairs of nodes by their distance, in graphs whose edges all count one step.

The graph is sent to the tasks as numbers (4 bytes an arc, 4 a node and 12 a node asked for), and each task searches from 64 sources at a time,
with one bit per source in a word per node. What comes out is a row per distance instead of one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.operators.graph import Graph
from braidlake.session import checkpointed

#: Edges up to which a graph is sent as numbers.
NUMBERED_EDGES = 16_000_000
#: Sources that are searched from at once.
BITS = 64
#: Arcs that are followed at once, which bounds what a step takes besides the graph.
ARCS_AT_ONCE = 1 << 21


class Numbered:
    """Compressed arcs between nodes numbered from 0 to n - 1."""

    def __init__(self, n: int, tails: np.ndarray, heads: np.ndarray, directed: bool):
        ways = [(tails, heads)] if directed else [(tails, heads), (heads, tails)]
        # one array sorted in place, as this is what takes most on the driver
        arcs, sizes = np.empty(len(tails) * len(ways), np.int64), np.zeros(n + 1, np.int64)
        for k, (a, b) in enumerate(ways):
            part = arcs[k * len(tails) : (k + 1) * len(tails)]
            part[:] = a
            part <<= 32
            part |= b
            sizes[1:] += np.bincount(a, minlength=n)
        arcs.sort()
        self.heads = arcs.astype(np.int32)  # the lower half
        self.start = np.cumsum(sizes).astype(np.int32)

    def levels(self, sources: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per step, from 0, the nodes reached first by any of the bits and those bits; sources may repeat."""
        n = len(self.start) - 1
        seen, offered = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        np.bitwise_or.at(seen, sources, bits)
        front = np.unique(sources)
        words = seen[front]
        while len(front):
            yield front, words
            reached = self._offer(front, words, offered)
            words = offered[reached] & ~seen[reached]
            offered[reached] = 0
            front, words = reached[words != 0], words[words != 0]
            seen[front] |= words

    def _offer(self, front: np.ndarray, words: np.ndarray, offered: np.ndarray) -> np.ndarray:
        """Adds the words of `front` to those offered to the heads of its arcs, and returns these heads once each."""
        sizes = self.start[front + 1] - self.start[front]
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = ends - sizes
        total, heads = int(ends[-1]), np.empty(0, np.int32)
        for low in range(0, total, ARCS_AT_ONCE):
            high = min(low + ARCS_AT_ONCE, total)
            # nodes with any of these arcs, and how many; a node's arcs may be followed in several parts
            some = slice(np.searchsorted(ends, low, "right"), np.searchsorted(begins, high, "left"))
            part = np.minimum(ends[some], high) - np.maximum(begins[some], low)
            heads = self.heads[np.arange(low, high) + np.repeat(self.start[front[some]] - begins[some], part)]
            np.bitwise_or.at(offered, heads, np.repeat(words[some], part))
        # sorting heads is cheaper than going over all nodes as long as they are few
        return np.unique(heads) if total <= min(ARCS_AT_ONCE, len(offered) // 16) else np.flatnonzero(offered)


def _hashed(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name)


def _column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(name).toArrow().column(name).to_numpy()


def _numbers(named: DataFrame) -> tuple[int, np.ndarray]:
    """A seed for which all nodes have different hashes, and these in order: a node's number is its place there."""
    for seed in count():
        hashes = np.sort(_column(named.select(_hashed(F.col("node"), seed).alias("h")), "h"))
        if not (hashes[1:] == hashes[:-1]).any():
            return seed, hashes
    raise AssertionError


def _counted(named: DataFrame, seed: int, hashes: np.ndarray, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nodes that `column` counts, and the counts."""
    rows = named.where(F.col(column) > 0).select(_hashed(F.col("node"), seed).alias("h"), column).toArrow()
    return np.searchsorted(hashes, rows.column("h").to_numpy()).astype(np.int32), rows.column(column).to_numpy()


def _numbered(edges: DataFrame, seed: int, hashes: np.ndarray, directed: bool) -> Numbered:
    rows = edges.select(_hashed(F.col("a"), seed).alias("a"), _hashed(F.col("b"), seed).alias("b")).toArrow()
    a, b = (np.searchsorted(hashes, rows.column(c).to_numpy()).astype(np.int32) for c in ("a", "b"))
    del rows
    return Numbered(len(hashes), a, b, directed)


class Pairs:
    """All pairs of a node of `a` and one of `b` (node), repeats counted. `edges` (a, b) are those of the graph, up to NUMBERED_EDGES and each once.

    A node of `a` that isn't in the graph is a KeyError.
    """

    def __init__(self, graph: Graph, edges: DataFrame, a: DataFrame, b: DataFrame):
        self.spark = edges.sparkSession
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        # ends are made one before the counts, so that a node with very many edges is one row here
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", one.alias("ends"), none.alias("n_a"), none.alias("n_b"))
        rows = ends.unionByName(a.select("node", none.alias("ends"), one.alias("n_a"), none.alias("n_b"))).unionByName(b.select("node", none.alias("ends"), none.alias("n_a"), one.alias("n_b")))
        named = checkpointed(rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("ends", "n_a", "n_b")]))
        # most sources have edges; only for others all nodes are read
        lone = checkpointed(named.where("n_a > 0 and ends = 0").select("node"))
        absent = lone.join(graph.nodes, "node", "left_anti").limit(1).collect() if lone.limit(1).count() else []
        if absent:
            raise KeyError(f"node {absent[0][0]} not in graph")
        seed, hashes = _numbers(named)
        self.sources, self.repeats = _counted(named, seed, hashes, "n_a")
        self.wanted = _counted(named, seed, hashes, "n_b")
        self.sizes = int(self.repeats.sum()), int(self.wanted[1].sum())
        self.arcs = _numbered(edges, seed, hashes, graph.directed)

    def by_distance(self, least_only: bool = False) -> DataFrame:
        """(dist, pairs): numbers of pairs at each distance, in several rows; with `least_only` the rows tell no more than the least one."""
        sets = 1 if least_only else -(-len(self.sources) // BITS)
        shared = self.spark.sparkContext.broadcast((self.arcs, self.wanted, self.sources, self.repeats))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arcs, (asked, counts), sources, repeats = shared.value
            wanted = np.zeros(len(arcs.start) - 1, np.int64)
            wanted[asked] = counts
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    if least_only:
                        levels, times = arcs.levels(sources, np.ones(len(sources), np.uint64)), {1: np.uint64(1)}
                    else:
                        mine, often = sources[k * BITS : (k + 1) * BITS], repeats[k * BITS : (k + 1) * BITS]
                        bits = np.left_shift(np.uint64(1), np.arange(len(mine), dtype=np.uint64))
                        levels, times = arcs.levels(mine, bits), {int(c): np.bitwise_or.reduce(bits[often == c]) for c in np.unique(often)}
                    found: list[tuple[int, int]] = []
                    for step, (nodes, words) in enumerate(levels):
                        n = wanted[nodes]
                        n, words = n[n > 0], words[n > 0]
                        if len(n):
                            found.append((step, sum(c * int(n @ np.bitwise_count(words & of).astype(np.int64)) for c, of in times.items())))
                            if least_only:
                                break
                    yield pa.record_batch({"dist": pa.array([float(d) for d, _ in found], pa.float64()), "pairs": pa.array([p for _, p in found], pa.int64())})

        tasks = max(1, min(sets, 4 * self.spark.sparkContext.defaultParallelism))
        return self.spark.range(0, sets, 1, tasks).mapInArrow(run, "dist double, pairs bigint")
