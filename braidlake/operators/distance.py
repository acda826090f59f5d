"""Shortest-path distances.

Graphs up to a checked number of arcs are sent to all tasks as arrays, and each task searches from its own set of sources.
Larger graphs are first contracted: nodes with few arcs are taken out, their in-arcs joined to their out-arcs, so chains,
trees and rows of bubbles vanish in about log(nodes) rounds however deep they are. What is left is searched - by the
arrays if it is small by then, else by rounds of joins on the frontier - and the nodes taken out get their distances back,
round by round, from the nodes they hung on. Negative weights are refused. Distances between two node lists in graphs without
weights are counted by pairs.py.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.operators.graph import Graph, build_graph, warn_directed_bidirected
from braidlake.operators.numbering import densely_numbered
from braidlake.operators.pairs import NUMBERED_EDGES, Pairs
from braidlake.operators.paths import load_paths
from braidlake.operators.skew import frequent_candidates, skewed_join
from braidlake.schema import GraphOptions
from braidlake.session import checkpointed

#: Edges up to which the graph is broadcast: about 60 MB with the names of its nodes.
BROADCAST_EDGES = 500_000
#: Arcs, in and out, of a node that may be taken out in contraction.
MOST_ARCS = 8
#: Contraction goes on while a round takes out at least this share of the arcs.
LEAST_TAKEN = 0.25
QUADRATIC = 1000


class NoPath(Exception):
    """No node of one side can be reached from the other."""


def _arcs(graph: Graph) -> DataFrame:
    """(a, b, w): steps that a search may take, of parallel ones the shortest; a missing weight is 1."""
    edges = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    if not graph.directed:
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = edges.select(F.explode(ways).alias("e"), "w").select("e.a", "e.b", "w")
    return edges.groupBy("a", "b").agg(F.min("w").alias("w"))


class Adjacency:
    """Compressed arcs (a, b, w) of a graph small enough to broadcast."""

    def __init__(self, arcs: pa.Table):
        n = arcs.num_rows
        ends = pa.chunked_array([*arcs.column("a").chunks, *arcs.column("b").chunks], pa.string()).combine_chunks().dictionary_encode()
        numbers, self.names = ends.indices.to_numpy(), ends.dictionary
        order = np.argsort(numbers[:n], kind="stable")
        self.heads = numbers[n:][order].astype(np.int32)
        self.start = np.searchsorted(numbers[:n][order], np.arange(len(self.names) + 1))
        weights = arcs.column("w").to_numpy()[order]
        self.weights, self.uniform = weights, bool((weights == 1).all())

    def search(self, sources: pa.Array, dists: np.ndarray, wanted: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
        """The nodes that are reached and their distances, of those `wanted` (a mask of names) only; sources have distances to start from, and one without arcs reaches itself."""
        known = pc.index_in(sources, value_set=self.names)
        lone = known.is_null()
        first, start = known.drop_null().to_numpy().astype(np.int64), dists[~lone.to_numpy(zero_copy_only=False)]
        distance = np.full(len(self.names), np.inf)
        np.minimum.at(distance, first, start)
        (self._by_hops if self.uniform and not start.any() else self._by_weight)(np.unique(first), distance)
        reached = np.flatnonzero(np.isfinite(distance) if wanted is None else np.isfinite(distance) & wanted)
        return pa.concat_arrays([self.names.take(pa.array(reached)), sources.filter(lone)]), np.concatenate([distance[reached], dists[lone.to_numpy(zero_copy_only=False)]])

    def _by_hops(self, front: np.ndarray, distance: np.ndarray) -> None:
        hops = 0
        while len(front):
            hops += 1
            sizes = self.start[front + 1] - self.start[front]
            # positions of all arcs that leave the frontier
            at = np.arange(sizes.sum()) + np.repeat(self.start[front] - (np.cumsum(sizes) - sizes), sizes)
            heads = self.heads[at]
            front = np.unique(heads[np.isinf(distance[heads])])
            distance[front] = hops

    def _by_weight(self, first: np.ndarray, distance: np.ndarray) -> None:
        """Relaxes all arcs of the nodes within a mean arc of the nearest waiting one at a time (delta stepping)."""
        front, delta = first, float(self.weights.mean())
        while len(front):
            due = distance[front] <= distance[front].min() + delta
            now, later = front[due], front[~due]
            sizes = self.start[now + 1] - self.start[now]
            at = np.arange(sizes.sum()) + np.repeat(self.start[now] - (np.cumsum(sizes) - sizes), sizes)
            heads, offers = self.heads[at], np.repeat(distance[now], sizes) + self.weights[at]
            better = offers < distance[heads]
            np.minimum.at(distance, heads[better], offers[better])
            front = np.unique(np.concatenate([later, heads[better]]))


def _broadcast_search(spark: SparkSession, arcs: pa.Table, sources: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(source, node, dist) from `sources` (source, node, dist), searched in memory, one task per source set at a time."""
    adjacency = Adjacency(arcs)
    mask = None
    if wanted is not None:
        # only names that the arrays have, which bounds what comes to the driver
        names = spark.createDataFrame(pa.table({"node": adjacency.names}))
        mine = wanted.join(F.broadcast(names), "node", "left_semi").distinct().toArrow().column("node").combine_chunks()
        mask = pc.is_in(adjacency.names, value_set=mine).to_numpy(zero_copy_only=False)
    shared = spark.sparkContext.broadcast((adjacency, mask))
    kind = sources.schema["source"].dataType.simpleString()

    def run(keys: tuple, group: pa.Table) -> pa.Table:
        adjacency, mask = shared.value
        found, distances = adjacency.search(group.column("node").combine_chunks().cast(pa.string()), group.column("dist").to_numpy(), mask)
        return pa.table({"source": pa.repeat(keys[0], len(found)).cast(group.schema.field("source").type), "node": found, "dist": distances})

    found = sources.groupBy("source").applyInArrow(run, f"source {kind}, node string, dist double")
    # sources without arcs aren't under the mask
    return found if wanted is None else found.join(wanted, "node", "left_semi")


def _eligible(arcs: DataFrame) -> DataFrame:
    """(node): nodes that may be taken out without making more arcs than they have: in * out <= in + out <= MOST_ARCS."""
    ends = arcs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    sized = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.count("*").alias("n"))
    ins = F.col("n") - F.col("outs")
    return sized.where((F.col("n") <= MOST_ARCS) & (ins * F.col("outs") <= F.col("n"))).select("node")


def _taken_out(arcs: DataFrame, round_: int, heavy: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes taken out, their arcs as (node, ins, outs), the arcs that are left and those that replace them).

    Of neighbouring nodes that may be taken out only the one with the greatest rank is, so what a node taken out hangs on stays.
    """
    may = _eligible(arcs)
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_)), F.col(c))
    between = skewed_join(skewed_join(arcs, may.withColumnRenamed("node", "a"), ["a"], "left_semi", heavy=heavy), may.withColumnRenamed("node", "b"), ["b"], "left_semi", heavy=heavy)
    beaten = between.select(F.when(rank("a") < rank("b"), F.col("a")).otherwise(F.col("b")).alias("node")).distinct()
    gone = checkpointed(may.join(beaten, "node", "left_anti"))
    marked = checkpointed(
        skewed_join(
            skewed_join(arcs, gone.select(F.col("node").alias("a"), F.lit(True).alias("a_gone")), ["a"], "left", heavy=heavy),
            gone.select(F.col("node").alias("b"), F.lit(True).alias("b_gone")), ["b"], "left", heavy=heavy,
        )
    )
    ins = marked.where("b_gone").groupBy(F.col("b").alias("node")).agg(F.collect_list(F.struct("a", "w")).alias("ins"))
    outs = marked.where("a_gone").groupBy(F.col("a").alias("node")).agg(F.collect_list(F.struct("b", "w")).alias("outs"))
    hung = checkpointed(ins.join(outs, "node", "full_outer"))
    through = F.flatten(F.transform("ins", lambda i: F.transform("outs", lambda o: F.struct(i["a"].alias("a"), o["b"].alias("b"), (i["w"] + o["w"]).alias("w")))))
    short = hung.select(F.explode(through).alias("e")).select("e.*").where("a <> b")
    left = marked.where("a_gone is null and b_gone is null").select("a", "b", "w").unionByName(short).groupBy("a", "b").agg(F.min("w").alias("w"))
    return gone, hung, checkpointed(left)


def _nearest(offers: DataFrame) -> DataFrame:
    return offers.groupBy("source", "node").agg(F.min("dist").alias("dist"))


def _contracted_search(arcs: DataFrame, sources: DataFrame, wanted: DataFrame | None, broadcast_arcs: int) -> DataFrame:
    """Takes nodes out until the arcs can be broadcast or few more go, searches what is left, and puts the nodes back."""
    arcs = checkpointed(arcs.where("a <> b"))
    sources = checkpointed(_nearest(sources))
    levels: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    # a node with very many arcs keeps them, as it is never taken out; new ones of its kind don't arise
    heavy = sorted({*frequent_candidates(arcs, "a"), *frequent_candidates(arcs, "b")})
    n = arcs.count()
    while n > max(broadcast_arcs, 0):
        gone, hung, left = _taken_out(arcs, len(levels), heavy)
        kept = left.count()
        if kept > (1 - LEAST_TAKEN) * n and levels or kept == n:
            break
        # what starts at a node taken out starts from the nodes behind it instead, and stays known for the way back
        held = checkpointed(sources.join(hung.select("node", "outs"), "node"))
        onward = held.where("outs is not null").select("source", "dist", F.explode("outs").alias("o")).select("source", F.col("o.b").alias("node"), (F.col("dist") + F.col("o.w")).alias("dist"))
        levels.append((hung.select("node", "ins"), held.select("source", "node", "dist"), gone if wanted is None else wanted))
        sources = checkpointed(_nearest(sources.join(gone, "node", "left_anti").unionByName(onward)))
        if wanted is not None:
            asked = hung.join(wanted, "node", "left_semi").where("ins is not null").select(F.explode("ins").alias("i")).select(F.col("i.a").alias("node"))
            wanted = checkpointed(wanted.join(gone, "node", "left_anti").unionByName(asked).distinct())
        arcs, n = left, kept
    if n <= broadcast_arcs:
        found = _broadcast_search(arcs.sparkSession, arcs.toArrow(), sources, wanted)
    else:
        found = _frontier_search(arcs, sources, wanted)
    for hung, held, asked in reversed(levels):
        found = checkpointed(found)
        back = hung.join(asked.select("node").distinct(), "node", "left_semi").where("ins is not null").select(F.col("node").alias("back"), F.explode("ins").alias("i"))
        arrived = skewed_join(back.select("back", F.col("i.a").alias("node"), F.col("i.w").alias("w")), found, ["node"], heavy=heavy)
        offers = arrived.select("source", F.col("back").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        mine = held.join(asked.select("node").distinct(), "node", "left_semi").select("source", "node", "dist")
        found = found.unionByName(_nearest(offers.unionByName(mine)))
    return found


def _frontier_search(arcs: DataFrame, sources: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Rounds of relaxing: nodes whose distance fell in a round are the next frontier. Ends when none did, as weights aren't negative."""
    arcs = checkpointed(arcs)
    best = front = checkpointed(_nearest(sources))
    heavy = frequent_candidates(arcs, "a")
    while front.limit(1).count():
        # a node with very many arcs is met by broadcast
        steps = skewed_join(arcs.withColumnRenamed("a", "node"), front, ["node"], heavy=heavy)
        offers = _nearest(steps.select("source", F.col("b").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))).withColumnRenamed("dist", "offer")
        better = checkpointed(offers.join(best, ["source", "node"], "left").where(F.col("dist").isNull() | (F.col("offer") < F.col("dist"))).select("source", "node", F.col("offer").alias("dist")))
        best = checkpointed(best.join(better, ["source", "node"], "left_anti").unionByName(better))
        front = better
    return best if wanted is None else best.join(wanted, "node", "left_semi")


def search(graph: Graph, sources: DataFrame, wanted: DataFrame | None = None, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(source, node, dist): least distance from any node of each source set to every node it reaches.

    `sources` is (source, node). With `wanted` (node) only those nodes come out. A source node that isn't in the graph is an
    error. Rows are made per source set, so the result is as large as what is reached.
    """
    spark = graph.edges.sparkSession
    absent = sources.join(graph.nodes, "node", "left_anti").select("node").limit(1).collect()
    if absent:
        raise KeyError(f"node {absent[0][0]} not in graph")
    arcs = _arcs(graph)
    if graph.options.weight_tag and arcs.where("w < 0").limit(1).count():
        raise ValueError("negative weight")
    started = sources.select("source", "node", F.lit(0.0).alias("dist")).distinct()
    head = arcs.limit(broadcast_edges + 1).toArrow()
    if head.num_rows <= broadcast_edges:
        return _broadcast_search(spark, head, started, wanted)
    found = _contracted_search(arcs, started, wanted, broadcast_edges)
    return found if wanted is None else found.join(wanted, "node", "left_semi")


def _one_set(spark: SparkSession, nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.lit(name).alias("source"), "node").distinct()


def nodes_with_sequence(graph: Graph, sequence: str) -> DataFrame:
    """(node): all nodes with exactly this sequence; `*` is a sequence like any other."""
    return graph.nodes.where(F.col("sequence") == sequence).select("node")


def sequence_distance(graph: Graph, a: str, b: str) -> float:
    """Least distance from a node with sequence `a` to one with sequence `b`. KeyError if a sequence is missing, NoPath if unreachable."""
    if "sequence" not in graph.nodes.columns:
        raise ValueError("the graph was built without sequences")
    ends = {s: checkpointed(nodes_with_sequence(graph, s)) for s in (a, b)}
    for s, nodes in ends.items():
        if not nodes.limit(1).count():
            raise KeyError(f"sequence not found: {s}")
    return genome_distance(graph, ends[a], ends[b])


def _as_nodes(graph: Graph, nodes: DataFrame | list[str]) -> DataFrame:
    return nodes if isinstance(nodes, DataFrame) else graph.nodes.sparkSession.createDataFrame([(x,) for x in nodes], "node string")


def genome_distance(graph: Graph, a: DataFrame | list[str], b: DataFrame | list[str], method: str = "min") -> float:
    """Distance from node list `a` to node list `b`: the least one, or the mean over all pairs that are connected, repeats counted.

    NoPath if nothing of b is reached, ValueError for another method.
    """
    return genome_distances(graph, a, b, (method,))[method]


def genome_distances(graph: Graph, a: DataFrame | list[str], b: DataFrame | list[str], methods: tuple[str, ...] = ("min", "mean")) -> dict[str, float]:
    """genome_distance by several methods, which one search answers in a graph without weights that can be sent as numbers."""
    for method in methods:
        if method not in ("min", "mean"):
            raise ValueError(f"unknown method: {method}")
    warn_directed_bidirected(graph)
    a, b = _as_nodes(graph, a), _as_nodes(graph, b)
    edges = None if graph.options.weight_tag else checkpointed(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    if edges is None or edges.count() > NUMBERED_EDGES:
        if edges is not None:
            graph = replace(graph, edges=edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("double").alias("weight")))
        best = {m: _least(graph, a, b) if m == "min" else _mean(graph, a, b) for m in methods}
    else:
        pairs = Pairs(graph, edges, a, b)
        if "mean" in methods:
            warn_quadratic(*pairs.sizes)
        counted = pairs.by_distance(least_only="mean" not in methods)
        least, mean = counted.agg(F.min("dist"), F.sum(F.col("dist") * F.col("pairs")) / F.sum("pairs")).collect()[0]
        best = {m: least if m == "min" else mean for m in methods}
    if None in best.values():
        raise NoPath("no path between the two sides")
    return best


def _least(graph: Graph, a: DataFrame, b: DataFrame) -> float | None:
    return search(graph, _one_set(graph.edges.sparkSession, a, "a"), b.distinct()).agg(F.min("dist")).collect()[0][0]


def _mean(graph: Graph, a: DataFrame, b: DataFrame) -> float | None:
    n_a, n_b = (x.groupBy("node").agg(F.count("*").alias("n")) for x in (a, b))
    pairs = n_a.agg(F.sum("n")).collect()[0][0] or 0, n_b.agg(F.sum("n")).collect()[0][0] or 0
    warn_quadratic(*pairs)
    found = search(graph, n_a.select(F.col("node").alias("source"), "node"), n_b.select("node"))
    weighed = found.join(n_a.select(F.col("node").alias("source"), F.col("n").alias("ca")), "source").join(n_b.select("node", F.col("n").alias("cb")), "node")
    return weighed.agg(F.sum(F.col("dist") * F.col("ca") * F.col("cb")) / F.sum(F.col("ca") * F.col("cb"))).collect()[0][0]


def warn_quadratic(n_a: int, n_b: int) -> None:
    """RuntimeWarning that a mean over pairs searches once per node, unless the environment switches it off."""
    if n_a * n_b > QUADRATIC and os.environ.get("BRAIDLAKE_DISABLE_WARNINGS") != "1":
        warnings.warn(f"mean distance over {n_a * n_b} pairs", RuntimeWarning, stacklevel=3)


def path_nodes(records: DataFrame) -> DataFrame:
    """(i, name, node): steps of all paths, paths numbered from 0 in file order. Repeated steps stay."""
    steps = load_paths(records)
    ranks = densely_numbered(steps.select("name", "path_rank").distinct(), ["path_rank"], "i").select("name", "i")
    return steps.join(ranks, "name").select("i", "name", "node")


def genome_distance_matrix(records: DataFrame, method: str = "min", broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(i, j, path_a, path_b, dist) for all pairs of paths in file order, both ways round; 0 on the diagonal, infinity if not connected.

    The graph is directed and unweighted. `min` is the least distance from a node of the earlier path to one of the later;
    `mean` averages, over the steps of either path, their distance from the other path's nodes, leaving out those not reached.
    One search per path; every path has a row with every other, which is what the result is.
    """
    graph = build_graph(records, GraphOptions())
    steps = checkpointed(path_nodes(records))
    counted = steps.groupBy("i", "node").agg(F.count("*").alias("n"))
    found = search(graph, steps.select(F.col("i").alias("source"), "node").distinct(), steps.select("node").distinct(), broadcast_edges)
    met = skewed_join(counted.withColumnRenamed("i", "at"), found, ["node"], share=0.05).where("source <> at")
    if method == "min":
        near = met.where("source < at").groupBy(F.col("source").alias("i"), F.col("at").alias("j")).agg(F.min("dist").alias("dist"))
    else:
        near = met.groupBy(F.least("source", "at").alias("i"), F.greatest("source", "at").alias("j")).agg((F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("dist"))
    names = steps.select("i", "name").distinct()
    n = names.count()
    every = names.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n - 1, 0)).cast("bigint"))))
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    full = every.join(both, ["i", "j"], "left").join(names.select(F.col("i").alias("j"), F.col("name").alias("path_b")), "j")
    dist = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.coalesce("dist", F.lit(float("inf"))))
    return full.select("i", "j", F.col("name").alias("path_a"), "path_b", dist.alias("dist"))


def labelled(matrix: DataFrame) -> tuple[list[str], np.ndarray]:
    """(names of the paths in file order, the distance matrix) on the driver, for writing it out; a path per row and column."""
    rows = matrix.select("i", "j", "path_a", "dist").toPandas()
    n = int(rows.i.max()) + 1 if len(rows) else 0
    out, names = np.zeros((n, n)), [""] * n
    out[rows.i, rows.j] = rows.dist
    for i, name in rows[rows.j == 0][["i", "path_a"]].itertuples(index=False):
        names[i] = name
    return names, out


def pivoted(matrix: DataFrame) -> np.ndarray:
    """The distance matrix without names."""
    return labelled(matrix)[1]
