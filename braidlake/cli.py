"""Command line: convert, export, stats, distance, distance-matrix."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake import __version__
from braidlake.operators import distance, matrix, stats
from braidlake.operators.graph import build_graph, warn_tag_memory
from braidlake.operators.paths import load_paths
from braidlake.operators.split import warn_growth, warn_skipped
from braidlake.schema import DTYPES, GraphOptions
from braidlake.session import checkpointed, local_session
from braidlake.sinks import graphs, matrices
from braidlake.sources.gfa import read_records


class Progress:
    """The share of finished tasks of running stages, on standard error, every few seconds."""

    def __init__(self, spark: SparkSession, what: str, seconds: float = 2.0):
        self.tracker, self.what, self.seconds, self.ended = spark.sparkContext.statusTracker(), what, seconds, threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        while not self.ended.wait(self.seconds):
            stages = [s for s in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if s]
            if stages:
                print(f"\r[{self.what}] {sum(s.numCompletedTasks for s in stages)} of {sum(s.numTasks for s in stages)} tasks", end="", file=sys.stderr, flush=True)

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.ended.set()
        self.thread.join()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="braidlake")
    top.add_argument("--version", action="version", version=f"braidlake {__version__}")
    top.add_argument("--raw-bytes-id", action="store_true", help="ids as bytes")
    top.add_argument("--max-dense-gb", type=float, default=5.0, help="largest full matrix that is written, in GB")
    top.add_argument("--max-tag-mb", type=float, default=100.0, help="warn if stored tags take more MB")
    sub = top.add_subparsers(dest="cmd", required=True)

    def command(name: str, what: str, **more: object) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=what, **more)  # type: ignore[arg-type]
        p.add_argument("gfa", help="GFA file, plain or .gz, or - for standard input")
        return p

    def direction(p: argparse.ArgumentParser) -> None:
        one = p.add_mutually_exclusive_group()
        one.add_argument("--directed", dest="directed", action="store_true", default=True)
        one.add_argument("--undirected", dest="directed", action="store_false")

    def backend(p: argparse.ArgumentParser) -> None:
        p.add_argument("--backend", choices=["networkx", "igraph"], default="networkx", help="igraph keeps parallel edges")
        p.add_argument("--verbose", action="store_true")

    p = command("convert", "graph or matrix of a file")
    backend(p)
    direction(p)
    p.add_argument("--graph", action="store_true")
    p.add_argument("--matrix", "--save-matrix", metavar="PATH")
    p.add_argument("--matrix-tables", metavar="FOLDER", help="the matrix as tables, of any size")
    p.add_argument("--matrix-format", default="csr")
    p.add_argument("--dtype", choices=list(DTYPES), default="float64")
    for flag in ("asymmetric", "no-node-map", "store-seq", "store-tags", "split-on-alignment", "strip-orientation", "bidirected", "keep-directed-bidir"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--weight-tag")
    p.add_argument("-o", "--output", help="folder for the graph's tables")

    p = command("export", "graph in another format")
    p.add_argument("--format", choices=["edge-list", "graphml", "gexf", "json"], default="edge-list")
    p.add_argument("--bidirected", action="store_true")
    p.add_argument("--keep-directed-bidir", action="store_true")
    p.add_argument("--output", "-o", default="-")

    p = command("stats", "counts, components, degree and density", aliases=["stat"])
    direction(p)
    p.add_argument("--strip-orientation", action="store_true")

    p = command("distance", "least distance between two sequences or two paths")
    ends = p.add_mutually_exclusive_group(required=True)
    ends.add_argument("--seq", nargs=2, metavar=("A", "B"))
    ends.add_argument("--path", nargs=2, metavar=("A", "B"))
    direction(p)
    backend(p)

    p = command("distance-matrix", "distances between all paths")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--method", choices=["min", "mean"], default="min")
    backend(p)
    return top


def _convert(args: argparse.Namespace, records: DataFrame) -> None:
    print(f"Using backend: {args.backend}")
    options = GraphOptions(
        directed=args.directed, bidirected=args.bidirected, keep_directed_bidir=args.keep_directed_bidir, weight_tag=args.weight_tag, store_seq=args.store_seq and args.graph,
        store_tags=args.store_tags and args.graph, strip_orientation=args.strip_orientation, multigraph=args.backend == "igraph", split_on_alignment=args.split_on_alignment, raw_bytes_id=args.raw_bytes_id,
    )
    if args.split_on_alignment:
        warn_skipped(records)
        warn_growth(records)
    graph = build_graph(records, options)
    if options.store_tags:
        warn_tag_memory(graph, args.max_tag_mb)
    if args.matrix or args.matrix_tables:
        index = matrix.node_index(graph)
        # the multigraph backend's matrix is never made symmetric; written once, as it is counted and saved
        coo = checkpointed(matrix.coo_matrix(graph, index, args.dtype, args.asymmetric or args.backend == "igraph"))
        n = index.count()
        if args.matrix_tables:
            matrices.save_matrix_tables(coo, n, args.matrix_tables, "col" if args.matrix_format.lower() == "csc" else "row")
            index.write.mode("overwrite").parquet(f"{args.matrix_tables}/nodes")
    if args.matrix:
        try:
            matrices.save_matrix(coo, n, args.matrix, args.matrix_format, args.max_dense_gb)
        except MemoryError as error:
            raise SystemExit(str(error)) from error
        if not args.no_node_map:
            matrices.save_node_map(index, f"{args.matrix}.nodes.tsv")
    if args.graph and args.output:
        graphs.save_graph(graph, args.output)


def _export(args: argparse.Namespace, records: DataFrame) -> None:
    if args.format == "edge-list":
        graphs.write_edge_list(records, args.output, args.bidirected)
        return
    graph = build_graph(records, GraphOptions(bidirected=args.bidirected, keep_directed_bidir=args.keep_directed_bidir, raw_bytes_id=args.raw_bytes_id))
    if args.format == "json":
        graphs.write_json(graph, args.output)
    else:
        {"graphml": graphs.write_graphml, "gexf": graphs.write_gexf}[args.format](graph, args.output, args.raw_bytes_id)


def shown(value: float) -> str:
    """A distance as printed: whole ones without a fraction."""
    return str(int(value)) if float(value).is_integer() else str(value)


def _distance(args: argparse.Namespace, records: DataFrame) -> None:
    graph = build_graph(records, GraphOptions(directed=args.directed, store_seq=bool(args.seq), multigraph=args.backend == "igraph"))
    if args.seq:
        print(shown(distance.sequence_distance(graph, *args.seq)))
        return
    steps = load_paths(records)
    ends = [steps.where(F.col("name") == name).select("node") for name in args.path]
    for name, nodes in zip(args.path, ends, strict=True):
        if not nodes.limit(1).count():
            raise SystemExit(f"unknown path: {name}")
    print(shown(distance.genome_distance(graph, *ends)))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = _parser()
    args = top.parse_args(argv)
    if args.cmd == "convert" and not (args.graph or args.matrix or args.matrix_tables):
        top.error("convert requires --graph or --matrix")
    spark = spark or local_session(os.environ.get("BRAIDLAKE_CPUS", "*"), os.environ.get("BRAIDLAKE_MEMORY", "4g"))
    records = read_records(spark, args.gfa).cache()
    verbose = getattr(args, "verbose", False)
    if verbose:
        print(f"[read] {records.count():,} records", file=sys.stderr)
    with Progress(spark, args.cmd) if verbose else contextlib.nullcontext():
        _run(args, spark, records)
    records.unpersist()
    if verbose:
        print(f"[{args.cmd}] done")
    sys.stdout.flush()


def _run(args: argparse.Namespace, spark: SparkSession, records: DataFrame) -> None:
    if args.cmd == "convert":
        _convert(args, records)
    elif args.cmd == "export":
        _export(args, records)
    elif args.cmd in ("stats", "stat"):
        row = stats.stats(records, args.directed, args.strip_orientation).collect()[0]
        for name in ("nodes", "edges", "paths", "components", "max_degree"):
            print(f"{name}\t {row[name]}")
        print(f"density\t {row['density']:.6g}")
    elif args.cmd == "distance":
        _distance(args, records)
    else:
        if args.backend != "networkx":
            print("[distance-matrix] --backend changes nothing here: parallel edges don't shorten a path", file=sys.stderr)
        names, found = distance.labelled(distance.genome_distance_matrix(records, args.method))
        matrices.save_array(found, args.output)
        matrices.save_names(names, f"{args.output}.paths.tsv")
