"""Counts, degrees, components and density of a graph."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.operators.components import connected_components
from braidlake.operators.graph import Graph, build_graph
from braidlake.operators.paths import path_count
from braidlake.schema import GraphOptions
from braidlake.session import checkpointed


def degrees(graph: Graph) -> DataFrame:
    """(node, degree) of nodes with edges: in and out together, a loop counting twice."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def counts(graph: Graph) -> DataFrame:
    """(nodes, edges, max_degree, density) in one row; density is 0 with no edges or fewer than two nodes."""
    one = _in_one_row(
        graph.nodes.agg(F.count("*").alias("nodes")),
        graph.edges.agg(F.count("*").alias("edges")),
        degrees(graph).agg(F.coalesce(F.max("degree"), F.lit(0)).cast("bigint").alias("max_degree")),
    )
    n, m = F.col("nodes").cast("double"), F.col("edges").cast("double")
    density = F.when((F.col("edges") == 0) | (F.col("nodes") <= 1), F.lit(0.0)).otherwise((1 if graph.directed else 2) * m / (n * (n - 1)))
    return one.withColumn("density", density)


def _in_one_row(*singles: DataFrame) -> DataFrame:
    """The columns of several one-row results side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), singles)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def stats(records: DataFrame, directed: bool = True, strip_orientation: bool = False) -> DataFrame:
    """(nodes, edges, paths, components, max_degree, density) of the simple graph of `records`, in one row."""
    graph = build_graph(records, GraphOptions(directed=directed, strip_orientation=strip_orientation))
    # counted, joined and contracted below: written once, so that the text is parsed once
    graph = replace(graph, nodes=checkpointed(graph.nodes), edges=checkpointed(graph.edges.select("src", "dst")))
    parts = connected_components(graph.nodes, graph.edges).agg(F.count_distinct("component").alias("components"))
    return _in_one_row(counts(graph), path_count(records), parts).select("nodes", "edges", "paths", "components", "max_degree", "density")
