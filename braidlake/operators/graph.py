"""Records to graphs."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.functions.records import tag_number
from braidlake.schema import GraphOptions

EDGE_TYPES = ("L", "E", "C")


@dataclass(frozen=True)
class Graph:
    """nodes and edges, and raw_edges: every edge before parallel ones are merged, as the matrix counts them."""

    nodes: DataFrame
    edges: DataFrame
    raw_edges: DataFrame
    appearances: DataFrame
    options: GraphOptions
    directed: bool

    def to_undirected(self) -> Graph:
        """The same edges without direction; parallel ones merge unless the graph keeps them."""
        merged = self.edges if self.options.parallel else _merged(self.raw_edges, self.options, directed=False)
        return Graph(self.nodes, merged, self.raw_edges, self.appearances, self.options, False)


def _flipped(orient: Column) -> Column:
    return F.when(orient == "+", F.lit("-")).otherwise(F.lit("+"))


def edge_rows(records: DataFrame, options: GraphOptions) -> DataFrame:
    """(src, dst, orientation_from, orientation_to, weight, tags, ord, part): one row per edge of every link-like record, reverse complements with part 1."""
    rows = records.where(F.col("rec_type").isin(*EDGE_TYPES))
    ends = [F.rtrim(F.col(c), F.lit("+-")) if options.strip_orientation else F.col(c) for c in ("src", "dst")]
    weight = tag_number(F.col("tags"), options.weight_tag) if options.weight_tag else F.lit(None).cast("double")
    u, v = ends
    a, b = F.col("orientation_from"), F.col("orientation_to")
    forward = lambda x, y: F.struct(x.alias("src"), y.alias("dst"))
    if not options.bidirected:
        pairs = F.array(forward(u, v))
    else:
        named = lambda x, o: F.concat(x, F.lit(":"), o)
        pairs = F.array(forward(named(u, a), named(v, b)))
        if not options.keep_directed_bidir:
            pairs = F.array(forward(named(u, a), named(v, b)), forward(named(v, _flipped(b)), named(u, _flipped(a))))
    exploded = rows.select("orientation_from", "orientation_to", weight.alias("weight"), "tags", "ord", F.posexplode(pairs).alias("part", "e"))
    return exploded.select("e.src", "e.dst", "orientation_from", "orientation_to", "weight", "tags", "ord", "part")


def node_rows(records: DataFrame, options: GraphOptions) -> DataFrame:
    """(node, sequence, length, tags, ord, part): one row per segment record and node."""
    rows = records.where(F.col("rec_type") == "S")
    if options.bidirected:
        rows = rows.select("*", F.posexplode(F.array(F.lit("+"), F.lit("-"))).alias("part", "o")).withColumn("id", F.concat("id", F.lit(":"), "o"))
    else:
        rows = rows.withColumn("part", F.lit(0))
    return rows.select(F.col("id").alias("node"), "sequence", "length", "tags", "ord", "part")


def _last(column: str, order: Column) -> Column:
    """The value of the last row that has one."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(column)


def _merged(raw: DataFrame, options: GraphOptions, directed: bool) -> DataFrame:
    """Parallel edges made one: of each attribute the last record's that has it."""
    ends = ("src", "dst") if directed else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    order = F.struct("ord", "part")
    keep = [c for c in raw.columns if c in ("orientation_from", "orientation_to", "tags")]
    weight = [_last("weight", order)] if options.weight_tag else []
    if not keep and not weight:
        return raw.select(*ends).distinct().withColumn("weight", F.lit(None).cast("double"))
    merged = raw.select(*ends, *keep, "weight", "ord", "part").groupBy("src", "dst").agg(*[_last(c, order) for c in keep], *weight)
    return merged if weight else merged.withColumn("weight", F.lit(None).cast("double"))


def build_graph(records: DataFrame, options: GraphOptions | None = None) -> Graph:
    """Graph of records.

    Simple graphs merge parallel edges attribute by attribute, the last record that sets one wins; an edge without weight
    doesn't erase an earlier weight. Multigraphs keep every edge. Endpoints without a segment record become nodes.
    Paths and walks make neither nodes nor edges. Nothing runs until a result is asked for.
    """
    options = options or GraphOptions()
    if options.split_on_alignment:
        from braidlake.operators.split import split_on_alignment

        records = split_on_alignment(records)
    raw = edge_rows(records, options)
    segments = node_rows(records, options)
    ends = raw.select(F.posexplode(F.array("src", "dst")).alias("k", "node"), "ord", (F.col("part") * 2).alias("base"))
    appearances = segments.select("node", "ord", "part").unionByName(ends.select("node", "ord", (F.col("base") + F.col("k")).alias("part")))
    stored = [*["sequence"] * options.store_seq, *["length", "tags"] * options.store_tags]
    if stored:
        order = F.struct("ord", "part")
        if options.multigraph:
            # The first appearance decides, and an edge brings no attributes.
            all_ = segments.select("node", "ord", "part", *stored).unionByName(appearances.join(segments.select("ord").distinct(), "ord", "left_anti").select("node", "ord", "part"), allowMissingColumns=True)
            nodes = all_.groupBy("node").agg(F.min_by(F.struct(*stored), order).alias("a")).select("node", "a.*")
        else:
            own = segments.groupBy("node").agg(*[_last(c, order) for c in stored])
            nodes = appearances.select("node").distinct().join(own, "node", "left")
    else:
        nodes = appearances.select("node").distinct()
    drop = ["orientation_from", "orientation_to"] * (options.strip_orientation or options.bidirected) + ["tags"] * (not options.store_tags)
    raw = raw.drop(*drop)
    if options.parallel:
        edges = raw.drop("ord", "part")
    else:
        edges = _merged(raw, options, options.directed)
    return Graph(nodes, edges, raw, appearances, options, options.result_directed)


def raw_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids as bytes."""
    return df.withColumns({c: F.col(c).cast("binary") for c in columns})


def non_ascii_ids(graph: Graph) -> DataFrame:
    """Nodes whose ids aren't ASCII, which graphs with text ids don't allow."""
    return graph.nodes.where(~F.col("node").rlike(r"^[\x00-\x7F]*$"))


def warn_directed_bidirected(graph: Graph) -> None:
    """RuntimeWarning where distances follow directed edges of a graph with oriented nodes. Runs a job."""
    if graph.directed and graph.nodes.where(F.col("node").rlike(":[+-]$")).limit(1).count():
        warnings.warn("distances on a directed graph with oriented nodes; use to_undirected() for either direction", RuntimeWarning, stacklevel=2)


def stored_tag_megabytes(graph: Graph) -> float:
    """About how much the stored tags of nodes and edges take, as JSON. Runs a job."""
    total = 0
    for df in (graph.nodes, graph.edges):
        if "tags" in df.columns:
            total += df.agg(F.sum(F.length(F.to_json("tags")))).collect()[0][0] or 0
    return total / 1e6


def warn_tag_memory(graph: Graph, max_tag_mb: float = 100.0) -> None:
    size = stored_tag_megabytes(graph)
    if size > max_tag_mb:
        warnings.warn(f"stored tags take {size:.1f} MB", RuntimeWarning, stacklevel=2)
