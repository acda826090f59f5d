"""One call per task, from a file to its result; each is a composition of sources and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidlake.operators import distance, matrix, paths, stats
from braidlake.operators.graph import Graph, build_graph
from braidlake.schema import GraphOptions
from braidlake.sources.gfa import read_records


def load_graph(spark: SparkSession, path: str, **options: object) -> Graph:
    """Graph of a file; keywords are those of GraphOptions."""
    return build_graph(read_records(spark, path), GraphOptions(**options))  # type: ignore[arg-type]


def load_matrix(spark: SparkSession, path: str, dtype: str = "float64", asymmetric: bool = False, **options: object) -> tuple[DataFrame, DataFrame]:
    """(entries, node index) of a file's adjacency matrix."""
    graph = load_graph(spark, path, **options)
    index = matrix.node_index(graph)
    return matrix.coo_matrix(graph, index, dtype, asymmetric), index


def load_multigraph(spark: SparkSession, path: str, **options: object) -> Graph:
    """Graph with all parallel edges, and of a node's attributes the first record's."""
    return load_graph(spark, path, multigraph=True, **options)


def load_paths(spark: SparkSession, path: str) -> DataFrame:
    """Ordered nodes of a file's paths and walks."""
    return paths.load_paths(read_records(spark, path))


def compute_stats(spark: SparkSession, path: str, directed: bool = True, strip_orientation: bool = False) -> dict[str, float]:
    """Nodes, edges, paths, components, max_degree and density of a file."""
    return stats.stats(read_records(spark, path).cache(), directed, strip_orientation).collect()[0].asDict()


def path_distances(spark: SparkSession, path: str, method: str = "min") -> DataFrame:
    """Distances between all paths of a file."""
    return distance.genome_distance_matrix(read_records(spark, path), method)
