"""Graphs to files. Single-file formats are streamed partition by partition; tables are written by the executors."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import IO
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from braidlake.operators.graph import Graph, edge_rows, raw_ids
from braidlake.schema import GraphOptions


@contextmanager
def _opened(path: str) -> Iterator[IO[str]]:
    if path == "-":
        yield sys.stdout
    else:
        with open(path, "w") as f:
            yield f


def edge_list(records: DataFrame, bidirected: bool = False) -> DataFrame:
    """(line, ord): `u TAB v` for every link-like record, none merged or reversed."""
    rows = edge_rows(records, GraphOptions(bidirected=bidirected, keep_directed_bidir=True))
    return rows.select(F.concat_ws("\t", "src", "dst").alias("line"), "ord")


def write_edge_list(records: DataFrame, path: str = "-", bidirected: bool = False) -> None:
    """The edge list in file order, into one file or to standard output."""
    with _opened(path) as f:
        for row in edge_list(records, bidirected).orderBy("ord").select("line").toLocalIterator(prefetchPartitions=True):
            f.write(row[0] + "\n")


def write_edge_list_parts(records: DataFrame, folder: str, bidirected: bool = False) -> None:
    """The edge list as one file per task, for graphs of any size."""
    edge_list(records, bidirected).select("line").write.mode("overwrite").text(folder)


def _shown(name: str, raw_bytes: bool) -> str:
    return f"b'{name}'" if raw_bytes else name


def _attributes(row: Row, names: Iterable[str]) -> dict[str, object]:
    out = {}
    for name in names:
        value = row[name]
        if value is not None:
            out[name] = json.dumps({k: tag_value(v) for k, v in value.items()}) if isinstance(value, dict) else value
    return out


def tag_value(value: Row) -> object:
    """A tag's value as Python would have it."""
    return next((value[k] for k in ("i", "f", "b", "bs", "s") if value[k] is not None), None)


def _columns(df: DataFrame, skip: Iterable[str]) -> list[tuple[str, str]]:
    kinds = {"bigint": "long", "double": "double"}
    return [(c, kinds.get(t, "string")) for c, t in df.dtypes if c not in skip]


def write_graphml(graph: Graph, path: str = "-", raw_bytes: bool = False) -> None:
    nodes, edges = _columns(graph.nodes, ["node"]), _columns(graph.edges, ["src", "dst"])
    with _opened(path) as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for kind, columns in (("node", nodes), ("edge", edges)):
            for name, t in columns:
                f.write(f'  <key id="{kind[0]}_{name}" for="{kind}" attr.name="{name}" attr.type="{t}"/>\n')
        f.write(f'  <graph edgedefault="{"directed" if graph.directed else "undirected"}">\n')
        data = lambda k, row, columns: "".join(f'<data key="{k}_{n}">{escape(str(v))}</data>' for n, v in _attributes(row, [c for c, _ in columns]).items())
        for row in graph.nodes.toLocalIterator(prefetchPartitions=True):
            f.write(f"    <node id={quoteattr(_shown(row['node'], raw_bytes))}>{data('n', row, nodes)}</node>\n")
        for row in graph.edges.toLocalIterator(prefetchPartitions=True):
            f.write(f"    <edge source={quoteattr(_shown(row['src'], raw_bytes))} target={quoteattr(_shown(row['dst'], raw_bytes))}>{data('e', row, edges)}</edge>\n")
        f.write("  </graph>\n</graphml>\n")


def write_gexf(graph: Graph, path: str = "-", raw_bytes: bool = False) -> None:
    nodes, edges = _columns(graph.nodes, ["node"]), _columns(graph.edges, ["src", "dst", "weight"])
    with _opened(path) as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n')
        f.write(f'  <graph defaultedgetype="{"directed" if graph.directed else "undirected"}" mode="static">\n')
        for kind, columns in (("node", nodes), ("edge", edges)):
            f.write(f'    <attributes class="{kind}" mode="static">\n')
            for name, t in columns:
                f.write(f'      <attribute id="{kind[0]}_{name}" title="{name}" type="{t}"/>\n')
            f.write("    </attributes>\n")

        def values(k: str, row: Row, columns: list[tuple[str, str]]) -> str:
            found = _attributes(row, [c for c, _ in columns])
            return "<attvalues>" + "".join(f'<attvalue for="{k}_{n}" value={quoteattr(str(v))}/>' for n, v in found.items()) + "</attvalues>" if found else ""

        f.write("    <nodes>\n")
        for row in graph.nodes.toLocalIterator(prefetchPartitions=True):
            name = quoteattr(_shown(row["node"], raw_bytes))
            f.write(f"      <node id={name} label={name}>{values('n', row, nodes)}</node>\n")
        f.write("    </nodes>\n    <edges>\n")
        for i, row in enumerate(graph.edges.toLocalIterator(prefetchPartitions=True)):
            weight = f' weight="{row["weight"]}"' if row["weight"] is not None else ""
            f.write(f"      <edge id=\"{i}\" source={quoteattr(_shown(row['src'], raw_bytes))} target={quoteattr(_shown(row['dst'], raw_bytes))}{weight}>{values('e', row, edges)}</edge>\n")
        f.write("    </edges>\n  </graph>\n</gexf>\n")


def write_json(graph: Graph, path: str = "-") -> None:
    """Node-link form: directed, multigraph, nodes with id, edges with source and target (also under the older name, links)."""
    plain = lambda row, skip: {k: {t: tag_value(x) for t, x in v.items()} if isinstance(v, dict) else v for k, v in row.asDict().items() if k not in skip and v is not None}
    with _opened(path) as f:
        f.write(f'{{"directed": {json.dumps(graph.directed)}, "multigraph": {json.dumps(graph.options.parallel)}, "graph": {{}}, "nodes": [')
        for i, row in enumerate(graph.nodes.toLocalIterator(prefetchPartitions=True)):
            f.write((", " if i else "") + json.dumps({**plain(row, ("node",)), "id": row["node"]}))
        f.write('], "links": [')
        for i, row in enumerate(graph.edges.toLocalIterator(prefetchPartitions=True)):
            f.write((", " if i else "") + json.dumps({**plain(row, ("src", "dst")), "source": row["src"], "target": row["dst"]}))
        f.write("]}")


def save_graph(graph: Graph, folder: str) -> None:
    """nodes and edges as tables in `folder`, written by the executors; ids as bytes if the graph's options ask for it."""
    for name, df, ids in (("nodes", graph.nodes, ["node"]), ("edges", graph.edges, ["src", "dst"])):
        (raw_ids(df, ids) if graph.options.raw_bytes_id else df).write.mode("overwrite").parquet(str(Path(folder) / name))
