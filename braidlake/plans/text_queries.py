"""Queries through files: tables written as text and read as any GFA file, and results written by a sink and read back."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake import cli
from braidlake.functions.ids import segment_id
from braidlake.functions.records import parse_lines
from braidlake.operators import distance, matrix
from braidlake.operators.graph import Graph, build_graph, raw_ids
from braidlake.operators.numbering import densely_numbered
from braidlake.plans.data_queries import id_sql
from braidlake.plans.gfa_text import edge_lines, graph_records, link_lines, order_lines, path_lines, segment_lines
from braidlake.plans.graph_queries import _BOTH, _E, _EC, _IDX, _L, _S, ORACLE as GRAPH_ORACLE, _brand_matrix, _sign
from braidlake.schema import GraphOptions
from braidlake.session import shared_folder, table
from braidlake.sinks import graphs, matrices
from braidlake.sources.gfa import from_lines, read_lines, read_records


def _place(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


def _file(spark: SparkSession) -> str:
    """The same as a path that the driver's single-file sinks can open."""
    url = urlparse(_place(spark))
    if url.scheme not in ("", "file"):
        raise RuntimeError("single files need a shared folder that is mounted on the driver")
    os.makedirs(os.path.dirname(url.path), exist_ok=True)
    return url.path


def written(spark: SparkSession, lines: DataFrame, compression: str = "none") -> str:
    """The folder of text files, in the order of `ord`, to which lines are written."""
    path = _place(spark)
    lines.orderBy("ord").select("value").write.option("compression", compression).text(path)
    return path


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with the record's number as a last tag, so that it is known after reading."""
    return lines.select(F.concat("value", F.lit("\tid:i:"), F.col("ord.rec_id").cast("string")).alias("value"), "ord")


def _rec_id() -> Column:
    return F.col("tags")["id"]["i"].alias("rec_id")


# --- sources and record kinds -------------------------------------------------------------------------------------


def text_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links out of plain text files."""
    records = read_records(spark, written(spark, _numbered(link_lines(spark, folder))), warn=False)
    return records.select(_rec_id(), "src", "orientation_from", "dst", "orientation_to", "overlap")


def gzip_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Alignments out of gzipped files."""
    records = read_records(spark, written(spark, _numbered(edge_lines(spark, folder)), "gzip"), warn=False)
    return records.select(_rec_id(), "src", "orientation_from", "from_start", "from_end", "dst", "orientation_to", "to_start", "to_end", "cigar")


def stdin_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path and walk records from standard input, which is read in parts of bounded size."""
    path = _file(spark)
    with open(path, "w") as f:
        for row in _numbered(path_lines(spark, folder)).select("value").toLocalIterator():
            f.write(row[0] + "\n")
    before, sys.stdin = sys.stdin, open(path, newline="\n")  # noqa: SIM115
    try:
        lines = read_lines(spark, "-")
    finally:
        sys.stdin.close()
        sys.stdin = before
    return parse_lines(lines).select(_rec_id(), "rec_type", "name", F.size("steps").cast("bigint").alias("n_steps"))


def text_order(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered lines numbered in the order of the files that they were written to."""
    raw = table(spark, folder, "raw_lines").where("value is not null").select("value", F.struct("file_name", "line_no", "rec_id", "loaded_at").alias("ord"))
    return densely_numbered(read_lines(spark, written(spark, raw)), ["ord"], "n").select("n", "value")


def _ends(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, list[Column]]:
    rows = table(spark, folder, name)
    u, v = segment_id(F.col("from_segment")), segment_id(F.col("to_segment"))
    sign = [F.when(F.col(f"orientation_{x}") == "-", F.lit("-")).otherwise(F.lit("+")) for x in ("from", "to")]
    return rows.where((u != "") & (v != "")), [u, v, *sign]


def _as_lines(rows: DataFrame, *fields: Column | str) -> DataFrame:
    line = F.concat_ws("\t", *[F.lit(f) if isinstance(f, str) else f for f in fields], F.concat(F.lit("id:i:"), F.col("rec_id").cast("string")))
    return rows.select(line.alias("value"), F.struct("loaded_at", "rec_id").alias("ord"))


def suffix_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose orientation is written at the end of the id."""
    rows, (u, v, a, b) = _ends(spark, folder, "links")
    lines = _as_lines(rows, "L", F.concat(u, a), F.concat(v, b), F.coalesce("overlap", F.lit("*")), F.col("tags"))
    return read_records(spark, written(spark, lines), warn=False).select(_rec_id(), "src", "orientation_from", "dst", "orientation_to", "overlap")


def containments(spark: SparkSession, folder: str) -> DataFrame:
    """Containments in both spellings, among lines with too few fields."""
    rows, (u, v, a, b) = _ends(spark, folder, "edges")
    at = [F.col(c).cast("string") for c in ("from_start", "from_end", "to_start", "to_end")]
    placed = rows.where("from_start is not null and from_end is not null and to_start is not null and to_end is not null")
    lines = _as_lines(placed, "C", "*", F.concat(u, a), *at[:2], F.concat(v, b), *at[2:], F.coalesce("cigar", F.lit("*")))
    plain = _as_lines(rows, "C", u, a, v, b, "0", "*")
    short = rows.select(F.concat_ws("\t", F.lit("C"), u, a).alias("value"), F.struct("loaded_at", "rec_id").alias("ord"))
    records = read_records(spark, written(spark, lines.unionByName(plain).unionByName(short)), "DROPMALFORMED", warn=False)
    return records.select(_rec_id(), "rec_type", "src", "orientation_from", "from_start", "from_end", "dst", "orientation_to", "to_start", "to_end", "cigar")


def tag_values(spark: SparkSession, folder: str) -> DataFrame:
    """All readable tags of segments with their typed values; lists as their items between commas."""
    rows = table(spark, folder, "segments").where("id is not null and tags is not null")
    records = read_records(spark, written(spark, _as_lines(rows, "S", segment_id(F.col("id")), "*", F.col("tags"))), warn=False)
    tags = records.select(_rec_id(), F.explode("tags").alias("tag", "v")).where("tag <> 'id'")
    text = F.coalesce(F.array_join(F.transform("v.b", lambda x: x.cast("string")), ","), F.array_join("v.bs", ","), "v.s")
    return tags.select("rec_id", "tag", F.col("v.typ").alias("typ"), F.col("v.i").alias("whole"), F.col("v.f").alias("real"), F.col("v.b").isNotNull().alias("is_numbers"), text.alias("text"))


def graph_strip_orientation(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between ids as delivered, signs at their ends and all, from which stripping takes the signs."""
    rows = table(spark, folder, "links").where("from_segment is not null and to_segment is not null")
    lines = _as_lines(rows, "L", F.col("from_segment"), "+", F.col("to_segment"), "+", "*")
    return build_graph(read_records(spark, written(spark, lines), warn=False), GraphOptions(strip_orientation=True)).edges.select("src", "dst")


# --- nodes and attributes -----------------------------------------------------------------------------------------


def _graph(spark: SparkSession, folder: str, **options: object) -> Graph:
    return build_graph(graph_records(spark, folder), GraphOptions(**options))  # type: ignore[arg-type]


def bidirected_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder, bidirected=True).nodes


def nodes_with_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with the last sequence of their segments."""
    return _graph(spark, folder, store_seq=True).nodes


def nodes_with_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with their last length, and the names of the last readable tags."""
    nodes = _graph(spark, folder, store_tags=True).nodes
    return nodes.select("node", "length", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tag_names"))


def edges_with_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with the names of the last readable tags."""
    edges = _graph(spark, folder, store_tags=True).edges
    return edges.select("src", "dst", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tag_names"))


def multigraph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the multigraph, with the length that the first appearance brings: none, if that is an edge."""
    return _graph(spark, folder, store_tags=True, multigraph=True).nodes.select("node", "length")


def raw_id_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by bytes."""
    return raw_ids(_graph(spark, folder).nodes, ["node"]).select(F.hex("node").alias("node"))


# --- distances ----------------------------------------------------------------------------------------------------


def multigraph_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Steps from the nearest anchor, over parallel edges."""
    anchors = table(spark, folder, "anchor_segments").select(F.lit("anchors").alias("source"), F.col("id").alias("node"))
    return distance.search(_graph(spark, folder, directed=False, multigraph=True), anchors).select("node", "dist")


def sequence_distances(spark: SparkSession, folder: str) -> DataFrame:
    """The least distance between the first and the last anchor's sequence, either direction counting."""
    a, b = table(spark, folder, "anchor_segments").agg(F.min("sequence"), F.max("sequence")).collect()[0]
    graph = _graph(spark, folder, directed=False, store_seq=True)
    return spark.createDataFrame([(a, b, float(distance.sequence_distance(graph, a, b)))], "seq_a string, seq_b string, dist double")


def genome_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of the anchors from the nodes of all walks, the least and the mean."""
    graph = _graph(spark, folder, directed=False)
    anchors = table(spark, folder, "anchor_segments").select(F.col("id").alias("node"))
    walks = parse_lines(path_lines(spark, folder)).where("rec_type = 'O'").select(F.explode("steps").alias("s")).select(F.col("s.seg").alias("node"))
    rows = [(m, float(d)) for m, d in distance.genome_distances(graph, anchors, walks, ("min", "mean")).items()]
    return spark.createDataFrame(rows, "method string, dist double").select("method", F.round("dist", 9).alias("dist"))


# --- sinks --------------------------------------------------------------------------------------------------------


def graph_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted edges saved as tables and read again."""
    path = _place(spark)
    graphs.save_graph(_graph(spark, folder, weight_tag="RC"), path)
    return spark.read.parquet(f"{path}/edges").select("src", "dst", "weight")


def _unescaped(c: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def _edges_of(lines: DataFrame, mark: str) -> DataFrame:
    end = lambda name: _unescaped(F.regexp_extract("value", rf'{name}="([^"]*)"', 1)).alias("src" if name == "source" else "dst")
    return lines.where(F.trim("value").startswith(mark)).select(end("source"), end("target"))


def _exported(write: Callable[[Graph, str], None]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = _file(spark)
        write(_graph(spark, folder), path)
        with open(path, newline="\n") as f:
            return _edges_of(from_lines(spark, f), "<edge ")

    return query


def export_json(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the node-link form."""
    path = _file(spark)
    graphs.write_json(_graph(spark, folder), path)
    with open(path, newline="\n") as f:
        links = json.load(f)["links"]
    return from_lines(spark, (f"{x['source']}\t{x['target']}" for x in links)).select(F.split("value", "\t")[0].alias("src"), F.split("value", "\t")[1].alias("dst"))


def _entries(spark: SparkSession, arrays: Iterable[np.ndarray]) -> DataFrame:
    row, col, value = arrays
    lines = (f"{r} {c} {v!r}" for r, c, v in zip(row.tolist(), col.tolist(), value.tolist(), strict=True))
    f = F.split("value", " ")
    return from_lines(spark, lines).select(f[0].cast("bigint").alias("row"), f[1].cast("bigint").alias("col"), f[2].cast("double").alias("value"))


def matrix_npz(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the matrix saved as rows of a .npz file."""
    graph = _graph(spark, folder)
    index = matrix.node_index(graph)
    path = _file(spark) + ".npz"
    matrices.save_matrix(matrix.coo_matrix(graph, index, asymmetric=True), index.count(), path)
    m = np.load(path)
    return _entries(spark, (np.repeat(np.arange(len(m["indptr"]) - 1), np.diff(m["indptr"])), m["indices"], m["data"]))


def matrix_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the matrix saved as tables, which may be of any size."""
    graph = _graph(spark, folder)
    index = matrix.node_index(graph)
    path = _place(spark)
    matrices.save_matrix_tables(matrix.coo_matrix(graph, index, asymmetric=True), index.count(), path)
    rows = spark.read.parquet(f"{path}/entries")
    return rows.select(F.col("k").alias("row"), F.col("index").alias("col"), "value")


def node_map(spark: SparkSession, folder: str) -> DataFrame:
    """Node numbers out of the map that goes with a matrix file."""
    path = _file(spark)
    matrices.save_node_map(matrix.node_index(_graph(spark, folder)), path)
    f = F.split("value", "\t")
    with open(path, newline="\n") as lines:
        return from_lines(spark, lines).select(f[0].cast("bigint").alias("idx"), f[1].alias("node"))


def _saved_distances(suffix: str, read: Callable[[str], np.ndarray]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = _file(spark) + suffix
        names, array = distance.labelled(distance.genome_distance_matrix(parse_lines(order_lines(spark, folder))))
        matrices.save_array(array, path)
        back = read(path)
        rows = [(names[i], names[j], float(back[i, j])) for i in range(len(names)) for j in range(len(names))]
        return spark.createDataFrame(rows, "path_a string, path_b string, dist double")

    return query


# --- command line -------------------------------------------------------------------------------------------------


def _gfa(spark: SparkSession, folder: str) -> str:
    """All records as one GFA text."""
    lines = [f(spark, folder) for f in (segment_lines, link_lines, edge_lines, path_lines)]
    return written(spark, lines[0].unionByName(lines[1]).unionByName(lines[2]).unionByName(lines[3]))


def _printed(spark: SparkSession, *arguments: str) -> list[str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.main(list(arguments), spark)
    return out.getvalue().splitlines()


def cli_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What the command stats prints."""
    return spark.createDataFrame([tuple(x.split("\t ")) for x in _printed(spark, "stats", _gfa(spark, folder))], "name string, value string")


def cli_edge_list(spark: SparkSession, folder: str) -> DataFrame:
    """What the command export writes."""
    path = _file(spark)
    cli.main(["export", _gfa(spark, folder), "--output", path], spark)
    with open(path, newline="\n") as f:
        return from_lines(spark, f).select(F.col("value").alias("line"))


def cli_convert(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that the command convert saves, parallel ones kept."""
    path = _place(spark)
    _printed(spark, "convert", _gfa(spark, folder), "--graph", "--backend", "igraph", "-o", path)
    return spark.read.parquet(f"{path}/edges").select("src", "dst")


def cli_distance(spark: SparkSession, folder: str) -> DataFrame:
    """What the command distance prints for the first and the last anchor's sequence."""
    a, b = table(spark, folder, "anchor_segments").agg(F.min("sequence"), F.max("sequence")).collect()[0]
    return spark.createDataFrame([(a, b, float(x)) for x in _printed(spark, "distance", _gfa(spark, folder), "--seq", a, b, "--undirected")], "seq_a string, seq_b string, dist double")


QUERIES = {
    f.__name__: f
    for f in (
        text_links, gzip_edges, stdin_paths, text_order, suffix_links, containments, tag_values, graph_strip_orientation, bidirected_nodes, nodes_with_sequence, nodes_with_tags, edges_with_tags,
        multigraph_nodes, raw_id_nodes, multigraph_distances, sequence_distances, genome_distances, graph_tables, export_json, matrix_npz, matrix_tables, node_map, cli_stats, cli_edge_list, cli_convert, cli_distance,
    )
} | {
    "export_graphml": _exported(graphs.write_graphml), "export_gexf": _exported(graphs.write_gexf),
    "distances_npy": _saved_distances(".npy", np.load), "distances_csv": _saved_distances(".csv", lambda p: np.loadtxt(p, delimiter=",", ndmin=2)), "distances_npz": _saved_distances(".npz", lambda p: np.load(p)["array"]),
}

# --- SQL ----------------------------------------------------------------------------------------------------------

_LINK_ROWS = f"""
SELECT l.rec_id, src, a AS orientation_from, dst, b AS orientation_to, o AS overlap
FROM (SELECT *, coalesce(overlap, '*') AS o, {id_sql('from_segment')} AS src, {id_sql('to_segment')} AS dst, {_sign('orientation_from')} AS a, {_sign('orientation_to')} AS b FROM links) AS l WHERE src <> '' AND dst <> ''"""


def _tags_sql(rows: str, key: str) -> str:
    """Readable tags of `rows` (key, loaded_at, rec_id, tags), of equal names in a record the last."""
    return f"""
SELECT {key}, loaded_at, rec_id, r, arg_max(x, k) AS x FROM (
  SELECT {key}, loaded_at, rec_id, r, k, x, string_split(x, ':') AS f, string_split(x, ':')[1] AS tag,
    regexp_replace(x, '^[^:]*:[^:]*:', '') AS v
  FROM (SELECT {key}, loaded_at, rec_id, r, unnest(range(len(string_split(tags, chr(9))))) AS k, unnest(string_split(tags, chr(9))) AS x
    FROM (SELECT *, row_number() OVER () AS r FROM ({rows})))
  WHERE len(f) >= 3)
WHERE NOT (f[2] = 'i' AND (NOT regexp_full_match(v, '\\s*[+-]?[0-9]+\\s*') OR try_cast(trim(v) AS BIGINT) IS NULL))
  AND NOT (f[2] = 'f' AND NOT regexp_full_match(v, '\\s*([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:[+-]?(inf|infinity|nan)))\\s*'))
GROUP BY {key}, loaded_at, rec_id, r, tag"""


def _tag_names(rows: str, key: str) -> str:
    """The names of the tags of each key's last record with any."""
    per_record = f"SELECT {key}, loaded_at, rec_id, r, string_agg(string_split(x, ':')[1], ',' ORDER BY string_split(x, ':')[1]) AS names FROM ({_tags_sql(rows, key)}) GROUP BY ALL"
    return f"SELECT {key}, arg_max(names, (loaded_at, rec_id)) AS tag_names FROM ({per_record}) GROUP BY ALL"


_S_TAGS = "SELECT id AS node, loaded_at, rec_id, tags FROM (" + " UNION ALL ".join(f"SELECT {id_sql('id')} AS id, loaded_at, rec_id, tags FROM {t} WHERE id IS NOT NULL" for t in ("segments", "anchor_segments")) + ")"
_E_TAGS = " UNION ALL ".join(f"SELECT {id_sql('from_segment')} AS src, {id_sql('to_segment')} AS dst, loaded_at, rec_id, tags FROM {t} WHERE {id_sql('from_segment')} <> '' AND {id_sql('to_segment')} <> ''" for t in ("links", "edges"))
_ALL_NODES = f"SELECT id AS node FROM ({_S}) UNION SELECT src FROM {_BOTH} UNION SELECT dst FROM {_BOTH}"
_BFS = f"""
WITH RECURSIVE e AS {_BOTH}, arcs AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
own AS (SELECT id AS node, arg_max(sequence, (loaded_at, rec_id)) AS sequence FROM ({_S}) GROUP BY id),
ends AS (SELECT min(sequence) AS seq_a, max(sequence) AS seq_b FROM anchor_segments),
reach(node, dist) USING KEY (node) AS (
  SELECT node, CAST(0 AS DOUBLE) AS dist FROM own, ends WHERE sequence = seq_a
  UNION
  SELECT arcs.b, r.dist + 1 FROM reach AS r JOIN arcs ON arcs.a = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.reach AS x WHERE x.node = arcs.b))
SELECT seq_a, seq_b, min(dist) AS dist FROM ends JOIN own ON own.sequence = seq_b JOIN reach USING (node) GROUP BY ALL"""

ORACLE = {
    "text_links": _LINK_ROWS,
    "suffix_links": _LINK_ROWS,
    "gzip_edges": GRAPH_ORACLE["parse_edges"],
    "stdin_paths": "SELECT rec_id, 'P' AS rec_type, name, len(segments) AS n_steps FROM paths WHERE name IS NOT NULL AND len(segments) > 0 UNION ALL SELECT rec_id, 'O', name, len(segments) FROM walks WHERE name IS NOT NULL AND len(segments) > 0",
    "text_order": "SELECT row_number() OVER (ORDER BY file_name NULLS FIRST, line_no NULLS FIRST, rec_id NULLS FIRST, loaded_at NULLS FIRST) - 1 AS n, value FROM raw_lines WHERE value IS NOT NULL",
    "containments": f"""
SELECT rec_id, 'C' AS rec_type, src, a AS orientation_from, from_start, from_end, dst, b AS orientation_to, to_start, to_end, cigar FROM ({_EC}) WHERE from_start IS NOT NULL
UNION ALL SELECT rec_id, 'C', src, a, NULL, NULL, dst, b, NULL, NULL, NULL FROM ({_E})""",
    "tag_values": f"""
SELECT rec_id, f[1] AS tag, f[2] AS typ, CASE WHEN f[2] = 'i' THEN CAST(trim(v) AS BIGINT) END AS whole, CASE WHEN f[2] = 'f' THEN CAST(trim(v) AS DOUBLE) END AS real,
  f[2] = 'B' AND is_numbers AS is_numbers, CASE WHEN f[2] = 'B' AND is_numbers THEN array_to_string(list_transform(items, lambda y: CAST(CAST(trim(y) AS BIGINT) AS VARCHAR)), ',') WHEN f[2] NOT IN ('i', 'f') THEN v END AS text
FROM (SELECT *, string_split(x, ':') AS f, regexp_replace(x, '^[^:]*:[^:]*:', '') AS v, list_filter(string_split(v, ','), lambda y: y <> '') AS items,
    len(list_filter(items, lambda y: NOT regexp_full_match(y, '\\s*[+-]?[0-9]+\\s*'))) = 0 AS is_numbers
  FROM ({_tags_sql("SELECT rec_id AS key, rec_id, loaded_at, tags FROM segments WHERE id IS NOT NULL AND tags IS NOT NULL", "key")}))""",
    "graph_strip_orientation": "SELECT DISTINCT rtrim(from_segment, '+-') AS src, rtrim(to_segment, '+-') AS dst FROM links WHERE from_segment IS NOT NULL AND to_segment IS NOT NULL",
    "bidirected_nodes": f"""
SELECT id || o AS node FROM ({_S}), (SELECT unnest([':+', ':-']) AS o) UNION SELECT src || ':' || a FROM {_BOTH} UNION SELECT dst || ':' || b FROM {_BOTH}
UNION SELECT src || ':' || translate(a, '+-', '-+') FROM {_BOTH} UNION SELECT dst || ':' || translate(b, '+-', '-+') FROM {_BOTH}""",
    "nodes_with_sequence": f"SELECT node, s.sequence FROM ({_ALL_NODES}) LEFT JOIN (SELECT id AS node, arg_max(sequence, (loaded_at, rec_id)) AS sequence FROM ({_S}) GROUP BY id) AS s USING (node)",
    "nodes_with_tags": f"""
SELECT node, s.length, t.tag_names FROM ({_ALL_NODES}) LEFT JOIN (SELECT id AS node, arg_max(length, (loaded_at, rec_id)) FILTER (WHERE length IS NOT NULL) AS length FROM ({_S}) GROUP BY id) AS s USING (node)
LEFT JOIN ({_tag_names(_S_TAGS, 'node')}) AS t USING (node)""",
    "edges_with_tags": f"SELECT src, dst, t.tag_names FROM (SELECT DISTINCT src, dst FROM {_BOTH}) LEFT JOIN ({_tag_names(_E_TAGS, 'src, dst')}) AS t USING (src, dst)",
    "multigraph_nodes": f"""
SELECT node, CASE WHEN any_value(length) >= 0 THEN any_value(length) END AS length FROM (
  SELECT node, length, rank() OVER (PARTITION BY node ORDER BY loaded_at, rec_id) AS nth FROM (
    SELECT id AS node, loaded_at, rec_id, coalesce(length, -1) AS length FROM ({_S}) UNION ALL SELECT src, loaded_at, rec_id, -1 FROM {_BOTH} UNION ALL SELECT dst, loaded_at, rec_id, -1 FROM {_BOTH}))
WHERE nth = 1 GROUP BY node""",
    "raw_id_nodes": f"SELECT hex(node) AS node FROM ({_ALL_NODES})",
    "multigraph_distances": GRAPH_ORACLE["anchor_distances"],
    "sequence_distances": _BFS,
    "cli_distance": _BFS,
    "genome_distances": f"""
WITH RECURSIVE e AS {_BOTH}, arcs AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(source, node, dist) USING KEY (source, node) AS (
  SELECT id AS source, id AS node, 0 AS dist FROM anchor_segments
  UNION
  SELECT r.source, arcs.b, r.dist + 1 FROM reach AS r JOIN arcs ON arcs.a = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.reach AS x WHERE x.source = r.source AND x.node = arcs.b)),
steps AS (SELECT {id_sql('u.seg')} AS node, count(*) AS n FROM (SELECT unnest(segments) AS u FROM walks WHERE name IS NOT NULL) GROUP BY ALL),
met AS (SELECT dist, n FROM reach JOIN steps USING (node))
SELECT 'min' AS method, CAST(min(dist) AS DOUBLE) AS dist FROM met UNION ALL SELECT 'mean', round(sum(dist * n) / CAST(sum(n) AS DOUBLE), 9) FROM met""",
    "graph_tables": GRAPH_ORACLE["graph_weighted"],
    "export_json": f"SELECT DISTINCT src, dst FROM {_BOTH}",
    "export_graphml": f"SELECT DISTINCT src, dst FROM {_BOTH}",
    "export_gexf": f"SELECT DISTINCT src, dst FROM {_BOTH}",
    "matrix_npz": _IDX + "\nSELECT row, col, value FROM c",
    "matrix_tables": _IDX + "\nSELECT row, col, value FROM c",
    "node_map": _IDX + "\nSELECT idx, node FROM idx",
    "cli_edge_list": f"SELECT src || chr(9) || dst AS line FROM {_BOTH}",
    "cli_convert": f"SELECT src, dst FROM {_BOTH}",
    "cli_stats": f"""
WITH s AS ({GRAPH_ORACLE['graph_stats'].replace('round(edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 12)', 'edges / (CAST(nodes AS DOUBLE) * (nodes - 1))')})
SELECT name, value FROM (SELECT unnest(['nodes', 'edges', 'paths', 'components', 'max_degree', 'density']) AS name,
  unnest([CAST(nodes AS VARCHAR), CAST(edges AS VARCHAR), CAST(paths AS VARCHAR), CAST(components AS VARCHAR), CAST(max_degree AS VARCHAR), format('{{:.6g}}', density)]) AS value FROM s)""",
} | dict.fromkeys(("distances_npy", "distances_csv", "distances_npz"), _brand_matrix("min(dist)", "WHERE rank_a < rank_b"))
