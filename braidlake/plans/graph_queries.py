"""Graph queries over whole tables, through text and parser, with their SQL straight from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions.records import parse_lines, unsupported_lines
from braidlake.operators import distance, matrix
from braidlake.operators.components import connected_components
from braidlake.operators.graph import build_graph, edge_rows
from braidlake.operators.paths import load_paths
from braidlake.operators.split import chain_links, intervals, rewired
from braidlake.operators.stats import degrees, stats
from braidlake.plans.data_queries import id_sql
from braidlake.plans.gfa_text import edge_lines, graph_records, link_lines, order_lines, path_lines, segment_lines
from braidlake.schema import GraphOptions
from braidlake.session import table

WEIGHT = "RC"


def parse_segments(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(segment_lines(spark, folder)).select("ord.rec_id", "id", "length", "sequence")


def parse_links(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(link_lines(spark, folder)).select("ord.rec_id", "src", "orientation_from", "dst", "orientation_to", "overlap")


def parse_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric tag values by name, of links with such a tag."""
    records = parse_lines(link_lines(spark, folder))
    tags = records.select("ord.rec_id", F.explode("tags").alias("tag", "v")).where("v.i is not null")
    return tags.select("rec_id", "tag", F.col("v.i").alias("value"))


def parse_edges(spark: SparkSession, folder: str) -> DataFrame:
    return parse_lines(edge_lines(spark, folder)).select("ord.rec_id", "src", "orientation_from", "from_start", "from_end", "dst", "orientation_to", "to_start", "to_end", "cigar")


def parse_path_steps(spark: SparkSession, folder: str) -> DataFrame:
    records = parse_lines(path_lines(spark, folder))
    steps = records.select("ord.rec_id", "ord.loaded_at", "rec_type", F.posexplode("steps").alias("pos", "s"))
    return steps.select("rec_id", "loaded_at", "rec_type", F.col("pos").cast("bigint").alias("pos"), "s.seg", "s.orient")


def load_paths_last(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and walks by name, the last record of a name counting."""
    return load_paths(parse_lines(path_lines(spark, folder))).select("name", F.col("pos").cast("bigint").alias("pos"), "node")


def raw_record_types(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered lines by record type, those without enough fields left out."""
    lines = table(spark, folder, "raw_lines").select("value", F.struct("file_name", "line_no", "rec_id", "loaded_at").alias("ord"))
    return parse_lines(lines, "DROPMALFORMED").groupBy("rec_type").agg(F.count("*").alias("n"))


def raw_unsupported(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered lines of kinds that are skipped with a warning, by first letter."""
    lines = table(spark, folder, "raw_lines").select("value", F.col("rec_id").alias("ord"))
    return unsupported_lines(lines).groupBy(F.left("value", F.lit(1)).alias("letter")).agg(F.count("*").alias("n"))


def _edges(options: GraphOptions, *columns: str):
    return lambda spark, folder: build_graph(graph_records(spark, folder), options).edges.select("src", "dst", *columns)


def node_index(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.node_index(build_graph(graph_records(spark, folder)))


def _matrix(asymmetric: bool = False, **options):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = build_graph(graph_records(spark, folder), GraphOptions(**{k: v for k, v in options.items() if k != "dtype"}))
        index = matrix.node_index(graph)
        return matrix.coo_matrix(graph, index, options.get("dtype", "float64"), asymmetric)

    return query


def matrix_csr_indptr(spark: SparkSession, folder: str) -> DataFrame:
    graph = build_graph(graph_records(spark, folder))
    index = matrix.node_index(graph)
    return matrix.compressed(matrix.coo_matrix(graph, index, asymmetric=True), index.count())[0]


def _converted(fmt: str, part: int | None = None):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = build_graph(graph_records(spark, folder))
        index = matrix.node_index(graph)
        out = matrix.convert_format(matrix.coo_matrix(graph, index, asymmetric=True), fmt, index.count())
        return out.select("key.row", "key.col", "value") if part is None else out[part]

    return query


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    records = graph_records(spark, folder).unionByName(parse_lines(path_lines(spark, folder)))
    return stats(records).withColumn("density", F.round("density", 12))


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return degrees(build_graph(graph_records(spark, folder)))


def component_sizes(spark: SparkSession, folder: str) -> DataFrame:
    graph = build_graph(graph_records(spark, folder))
    return connected_components(graph.nodes, graph.edges).groupBy("component").agg(F.count("*").alias("n_nodes"))


def split_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return intervals(_splittable(spark, folder)).select("seg", "a", "b")


def split_chain(spark: SparkSession, folder: str) -> DataFrame:
    return chain_links(intervals(_splittable(spark, folder))).select("src", "dst")


def split_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Rewired alignments and links; an end without interval is null, and splitting leaves such an edge out."""
    return rewired(_splittable(spark, folder)).select("ord.rec_id", "from_node", "to_node")


def _splittable(spark: SparkSession, folder: str) -> DataFrame:
    return graph_records(spark, folder)


def _split_graph(spark: SparkSession, folder: str):
    return build_graph(_splittable(spark, folder), GraphOptions(split_on_alignment=True))


def split_graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _split_graph(spark, folder).nodes


def split_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the split graph: chains, then alignments, then links, of parallel ones the last attributes."""
    return _split_graph(spark, folder).edges.select("src", "dst", "orientation_from", "orientation_to")


def export_edge_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = edge_rows(graph_records(spark, folder), GraphOptions(bidirected=True, keep_directed_bidir=True))
    return rows.select("ord.rec_id", F.concat_ws("\t", "src", "dst").alias("line"))


def anchor_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Steps from the nearest anchor segment to every node, either direction counting."""
    graph = build_graph(graph_records(spark, folder), GraphOptions(directed=False))
    anchors = table(spark, folder, "anchor_segments").select(F.lit("anchors").alias("source"), F.col("id").alias("node"))
    return distance.search(graph, anchors).select("node", "dist")


def _path_matrix(method: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = distance.genome_distance_matrix(parse_lines(order_lines(spark, folder)), method)
        return found.select("path_a", "path_b", F.round("dist", 6).alias("dist"))

    return query


def frontier_distances(spark: SparkSession, folder: str) -> DataFrame:
    """As anchor_distances, with nothing broadcast: by contraction and rounds of joins, as for graphs of any size."""
    graph = build_graph(graph_records(spark, folder), GraphOptions(directed=False))
    anchors = table(spark, folder, "anchor_segments").select(F.lit("anchors").alias("source"), F.col("id").alias("node"))
    return distance.search(graph, anchors, broadcast_edges=0).select("node", "dist")


def weighted_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted distance from the first part to every part, over links of orders; of parallel links the last weight counts."""
    graph = build_graph(parse_lines(order_lines(spark, folder)), GraphOptions(weight_tag=WEIGHT))
    first = graph.nodes.agg(F.min("node").alias("node")).select(F.lit("first").alias("source"), "node")
    return distance.search(graph, first).select("node", "dist")


QUERIES = {f.__name__: f for f in (parse_segments, parse_links, parse_tags, parse_edges, parse_path_steps, load_paths_last, raw_record_types, raw_unsupported, node_index)} | {
    "graph_directed_edges": _edges(GraphOptions(), "orientation_from", "orientation_to"),
    "graph_undirected_edges": _edges(GraphOptions(directed=False), "orientation_from", "orientation_to"),
    "graph_weighted": _edges(GraphOptions(weight_tag=WEIGHT), "weight"),
    "graph_bidirected_edges": _edges(GraphOptions(bidirected=True)),
    "graph_bidirected_kept": _edges(GraphOptions(bidirected=True, keep_directed_bidir=True)),
    "multigraph_edges": _edges(GraphOptions(multigraph=True), "orientation_from", "orientation_to"),
    "matrix_coo_sum": _matrix(asymmetric=True),
    "matrix_weighted": _matrix(asymmetric=True, weight_tag=WEIGHT),
    "matrix_symmetric_max": _matrix(),
    "matrix_undirected": _matrix(directed=False),
    "matrix_bool": _matrix(dtype="bool"),
    "matrix_int8": _matrix(dtype="int8"),
    "matrix_int32": _matrix(dtype="int32"),
    "matrix_float32": _matrix(dtype="float32"),
    "matrix_multigraph": _matrix(asymmetric=True, multigraph=True),
} | {
    f.__name__: f for f in (matrix_csr_indptr, graph_stats, graph_degrees, component_sizes, split_nodes, split_chain, split_edges, split_graph_nodes, split_graph_edges, export_edge_list, anchor_distances, frontier_distances, weighted_distance)
} | {"matrix_csc_indptr": _converted("csc", 0), "matrix_csr_entries": _converted("csr", 1), "matrix_dok": _converted("dok"), "distance_matrix_min": _path_matrix("min"), "distance_matrix_mean": _path_matrix("mean")}

# --- SQL ----------------------------------------------------------------------------------------------------------


def _sign(c: str) -> str:
    return f"CASE WHEN {c} = '-' THEN '-' ELSE '+' END"


_TAG_VALUE = f"""
list_last(list_filter(string_split(tags, chr(9)), lambda x: regexp_full_match(x, '{WEIGHT}:[^:]*:(.|\\n)*')
  AND NOT (x LIKE '{WEIGHT}:i:%' AND NOT regexp_full_match(x, '{WEIGHT}:i:\\s*[+-]?[0-9]+\\s*'))
  AND NOT (x LIKE '{WEIGHT}:f:%' AND try_cast(substr(x, 6) AS DOUBLE) IS NULL)))"""
_WEIGHT = f"CASE WHEN {_TAG_VALUE} LIKE '{WEIGHT}:i:%' OR {_TAG_VALUE} LIKE '{WEIGHT}:f:%' THEN CAST(substr({_TAG_VALUE}, 6) AS DOUBLE) END"
_S = f"""
SELECT rec_id, loaded_at, {id_sql('id')} AS id, length, coalesce(sequence, '*') AS sequence FROM segments WHERE id IS NOT NULL
UNION ALL SELECT rec_id, loaded_at, {id_sql('id')}, length, coalesce(sequence, '*') FROM anchor_segments"""


def _links_sql(name: str, extra: str) -> str:
    return f"""
SELECT rec_id, loaded_at, {id_sql('from_segment')} AS src, {id_sql('to_segment')} AS dst, {_sign('orientation_from')} AS a, {_sign('orientation_to')} AS b, {_WEIGHT} AS weight{extra}
FROM {name} WHERE {id_sql('from_segment')} <> '' AND {id_sql('to_segment')} <> ''"""


_L, _E = _links_sql("links", ""), _links_sql("edges", "")
_PLACED = "from_start IS NOT NULL AND from_end IS NOT NULL AND to_start IS NOT NULL AND to_end IS NOT NULL"
_EC = _links_sql("edges", "".join(f", CASE WHEN {_PLACED} THEN {c} END AS {c}" for c in ("from_start", "from_end", "to_start", "to_end")) + f", CASE WHEN {_PLACED} THEN coalesce(cigar, '*') END AS cigar")
# Node numbers and matrix entries from every appearance in order.
_IDX = f"""
WITH s AS ({_S}), e AS ({_L} UNION ALL {_E}),
seen AS (
  SELECT id AS node, loaded_at, rec_id, 0 AS part FROM s UNION ALL SELECT src, loaded_at, rec_id, 0 FROM e UNION ALL SELECT dst, loaded_at, rec_id, 1 FROM e),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY loaded_at, rec_id, part) AS nth FROM seen) WHERE nth = 1),
idx AS (SELECT node, row_number() OVER (ORDER BY loaded_at, rec_id, part) - 1 AS idx FROM firsts),
m AS (SELECT i.idx AS row, j.idx AS col, coalesce(weight, 1.0) AS w FROM e JOIN idx AS i ON i.node = src JOIN idx AS j ON j.node = dst),
c AS (SELECT row, col, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY ALL),
c2 AS (SELECT row, col, value FROM c UNION ALL SELECT col, row, value FROM c)"""
_STEPS = "".join(
    f"{'' if k == 'P' else ' UNION ALL '}SELECT rec_id, loaded_at, '{k}' AS rec_type, name, unnest(range(len(segments))) AS pos, unnest(segments) AS u FROM {t} WHERE name IS NOT NULL AND len(segments) > 0"
    for t, k in (("paths", "P"), ("walks", "O"))
)
_PATH_ROWS = "SELECT rec_id, loaded_at, 'P' AS rec_type, row_number() OVER () AS k FROM paths WHERE name IS NOT NULL AND len(segments) > 0 UNION ALL SELECT rec_id, loaded_at, 'O', row_number() OVER () FROM walks WHERE name IS NOT NULL AND len(segments) > 0"
_ORIENT = "coalesce(u.orient, CASE WHEN u.seg ~ '.*-\\s*' THEN '-' ELSE '+' END)"


def _last_sql(pairs: str, keys: str, *values: str) -> str:
    """Merged edges: of each value the last one that is not null."""
    picks = ", ".join(f"arg_max({v}, o) FILTER (WHERE {v} IS NOT NULL) AS {n}" for v, n in (x.split("=") for x in values))
    return f"SELECT {keys}{', ' + picks if picks else ''} FROM (SELECT *, row_number() OVER (ORDER BY loaded_at, rec_id) AS o FROM ({pairs})) GROUP BY ALL"


_SPLIT = f"""
WITH s AS (SELECT id AS seg, arg_max(coalesce(length, -1), o) AS len0 FROM (SELECT *, row_number() OVER (ORDER BY loaded_at, rec_id) AS o FROM ({_S})) GROUP BY id),
seg AS (SELECT seg, CASE WHEN len0 >= 0 THEN len0 END AS length FROM s),
e AS ({_EC}),
points AS (
  SELECT seg, 0 AS pt FROM seg WHERE length IS NOT NULL UNION SELECT seg, length FROM seg WHERE length IS NOT NULL
  UNION SELECT src, from_start FROM e WHERE from_start IS NOT NULL UNION SELECT src, from_end FROM e WHERE from_end IS NOT NULL
  UNION SELECT dst, to_start FROM e WHERE to_start IS NOT NULL UNION SELECT dst, to_end FROM e WHERE to_end IS NOT NULL),
p AS (SELECT seg.seg, length, pt, lead(pt) OVER (PARTITION BY seg.seg ORDER BY pt) AS nxt, count(pt) OVER (PARTITION BY seg.seg) AS n FROM seg LEFT JOIN points ON points.seg = seg.seg),
cut AS (
  SELECT seg, length, coalesce(pt, 0) AS a, CASE WHEN n <= 1 THEN coalesce(length, pt, 0) ELSE nxt END AS b FROM p WHERE n <= 1 OR nxt IS NOT NULL),
named AS (SELECT *, seg || ':' || a || '-' || b AS node, row_number() OVER (PARTITION BY seg ORDER BY a) AS k FROM cut)"""


_LOCATED = f"""
all_edges AS (
  SELECT rec_id, loaded_at, src, dst, a, b, from_start, from_end, to_start, to_end, 1 AS phase FROM e
  UNION ALL SELECT rec_id, loaded_at, src, dst, a, b, NULL, NULL, NULL, NULL, 2 FROM ({_L})),
whole AS (SELECT seg, length, node FROM named WHERE k = 1),
located AS (
  SELECT e.*, coalesce(fn.node, fw.node) AS from_node, coalesce(tn.node, tw.node) AS to_node FROM all_edges AS e
  LEFT JOIN named AS fn ON fn.seg = e.src AND fn.a = e.from_start AND fn.b = e.from_end
  LEFT JOIN whole AS fw ON fw.seg = e.src AND ((e.from_start IS NULL AND e.from_end IS NULL) OR (e.from_start = 0 AND e.from_end = fw.length))
  LEFT JOIN named AS tn ON tn.seg = e.dst AND tn.a = e.to_start AND tn.b = e.to_end
  LEFT JOIN whole AS tw ON tw.seg = e.dst AND ((e.to_start IS NULL AND e.to_end IS NULL) OR (e.to_start = 0 AND e.to_end = tw.length)))"""
_COMPONENTS = f"""
WITH RECURSIVE e AS ({_L} UNION ALL {_E}), arcs AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
nodes AS (SELECT id AS node FROM ({_S}) UNION SELECT a FROM arcs),
label(node, component) USING KEY (node) AS (
  SELECT node, node AS component FROM nodes
  UNION
  SELECT b, min(c) FROM (SELECT arcs.b, l.component AS c FROM label AS l JOIN arcs ON arcs.a = l.node) AS o
  WHERE NOT EXISTS (SELECT 1 FROM recurring.label AS x WHERE x.node = o.b AND x.component <= o.c) GROUP BY b)"""
_ORDER_LINKS = """
SELECT a, b, q, o FROM (
  SELECT 'p' || l_partkey AS a, 'p' || lead(l_partkey) OVER w AS b, CAST(l_quantity AS BIGINT) AS q, (l_orderkey, row_number() OVER w) AS o FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
WHERE b IS NOT NULL"""
_BRAND_SEARCH = f"""
WITH RECURSIVE arcs AS (SELECT DISTINCT a, b FROM ({_ORDER_LINKS})),
steps AS (SELECT p_brand AS path, 'p' || p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand) AS rank FROM part),
reach(path, node, dist) USING KEY (path, node) AS (
  SELECT path, node, 0 AS dist FROM steps
  UNION
  SELECT r.path, arcs.b, r.dist + 1 FROM reach AS r JOIN arcs ON arcs.a = r.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach AS x WHERE x.path = r.path AND x.node = arcs.b)),
met AS (
  SELECT r.path AS a, s.path AS b, ra.rank AS rank_a, s.rank AS rank_b, r.dist FROM reach AS r JOIN steps AS s ON s.node = r.node AND s.path <> r.path
  JOIN (SELECT DISTINCT path, rank FROM steps) AS ra ON ra.path = r.path),
paths AS (SELECT DISTINCT path FROM steps)"""


def _brand_matrix(agg: str, where: str) -> str:
    return _BRAND_SEARCH + f""",
near AS (SELECT least(a, b) AS x, greatest(a, b) AS y, {agg} AS dist FROM met {where} GROUP BY ALL)
SELECT p.path AS path_a, q.path AS path_b, CASE WHEN p.path = q.path THEN 0.0 ELSE coalesce(round(near.dist, 6), CAST('inf' AS DOUBLE)) END AS dist
FROM paths AS p JOIN paths AS q ON true LEFT JOIN near ON near.x = least(p.path, q.path) AND near.y = greatest(p.path, q.path)"""


_BOTH = f"({_L} UNION ALL {_E})"
ORACLE = {
    "parse_segments": f"SELECT rec_id, id, length, sequence FROM ({_S})",
    "parse_links": f"SELECT l.rec_id, src, a AS orientation_from, dst, b AS orientation_to, o AS overlap FROM (SELECT *, coalesce(overlap, '*') AS o, {id_sql('from_segment')} AS src, {id_sql('to_segment')} AS dst, {_sign('orientation_from')} AS a, {_sign('orientation_to')} AS b FROM links) AS l WHERE src <> '' AND dst <> ''",
    "parse_tags": f"""
WITH t AS (SELECT rec_id, row_number() OVER () AS r, string_split(tags, chr(9)) AS t FROM links WHERE {id_sql('from_segment')} <> '' AND {id_sql('to_segment')} <> ''),
x AS (SELECT rec_id, r, unnest(range(len(t))) AS k, unnest(t) AS x FROM t),
y AS (
  SELECT rec_id, r, k, string_split(x, ':')[1] AS tag, string_split(x, ':')[2] AS kind,
    CASE WHEN regexp_full_match(x, '[^:]*:i:[+-]?[0-9]+') THEN CAST(string_split(x, ':')[3] AS BIGINT) END AS value,
    regexp_full_match(x, '[^:]*:f:[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AS real
  FROM x WHERE len(string_split(x, ':')) >= 3)
SELECT rec_id, tag, value FROM (SELECT rec_id, r, tag, arg_max(coalesce(CAST(value AS VARCHAR), 'none'), k) AS v, try_cast(v AS BIGINT) AS value
  FROM y WHERE NOT (kind = 'i' AND value IS NULL) AND NOT (kind = 'f' AND NOT real) GROUP BY rec_id, r, tag) WHERE value IS NOT NULL""",
    "parse_edges": f"SELECT rec_id, src, a AS orientation_from, from_start, from_end, dst, b AS orientation_to, to_start, to_end, cigar FROM ({_EC})",
    "parse_path_steps": f"SELECT rec_id, loaded_at, rec_type, pos, {id_sql('u.seg')} AS seg, {_ORIENT} AS orient FROM ({_STEPS})",
    "load_paths_last": f"""
SELECT name, pos, {id_sql('u.seg')} AS node FROM (SELECT *, dense_rank() OVER (PARTITION BY name ORDER BY loaded_at DESC, rec_id DESC) AS nth FROM (SELECT DISTINCT * FROM ({_STEPS}))) WHERE nth = 1""",
    "raw_record_types": """
SELECT f[1] AS rec_type, count(*) AS n FROM (SELECT string_split(value, chr(9)) AS f FROM raw_lines)
WHERE len(f) >= CASE f[1] WHEN 'S' THEN 2 WHEN 'L' THEN 5 WHEN 'P' THEN 3 WHEN 'O' THEN 3 WHEN 'E' THEN 6 WHEN 'C' THEN 5 END GROUP BY ALL""",
    "raw_unsupported": "SELECT left(value, 1) AS letter, count(*) AS n FROM raw_lines WHERE left(value, 1) NOT IN ('S', 'L', 'P', 'E', 'C', 'O', 'H', 'F') GROUP BY ALL",
    "node_index": _IDX + "\nSELECT idx, node FROM idx",
    "graph_directed_edges": _last_sql(_BOTH, "src, dst", "a=orientation_from", "b=orientation_to"),
    "graph_undirected_edges": _last_sql(f"(SELECT least(src, dst) AS src, greatest(src, dst) AS dst, a, b, loaded_at, rec_id FROM {_BOTH})", "src, dst", "a=orientation_from", "b=orientation_to"),
    "graph_weighted": _last_sql(_BOTH, "src, dst", "weight=weight"),
    "graph_bidirected_edges": f"""
SELECT src || ':' || a AS src, dst || ':' || b AS dst FROM {_BOTH} UNION ALL
SELECT dst || ':' || translate(b, '+-', '-+'), src || ':' || translate(a, '+-', '-+') FROM {_BOTH}""",
    "graph_bidirected_kept": f"SELECT src || ':' || a AS src, dst || ':' || b AS dst FROM {_BOTH}",
    "multigraph_edges": f"SELECT src, dst, a AS orientation_from, b AS orientation_to FROM {_BOTH}",
    "matrix_coo_sum": _IDX + "\nSELECT row, col, value FROM c",
    "matrix_weighted": _IDX + "\nSELECT row, col, sum(w) AS value FROM m GROUP BY ALL",
    "matrix_symmetric_max": _IDX + "\nSELECT row, col, max(value) AS value FROM c2 GROUP BY ALL",
    "matrix_undirected": _IDX + "\nSELECT row, col, sum(value) AS value FROM c2 GROUP BY ALL",
    "matrix_bool": _IDX + "\nSELECT DISTINCT row, col, true AS value FROM c2",
    "matrix_int8": _IDX + "\nSELECT row, col, CAST(max(value) AS TINYINT) AS value FROM c2 GROUP BY ALL",
    "matrix_int32": _IDX + "\nSELECT row, col, CAST(max(value) AS INTEGER) AS value FROM c2 GROUP BY ALL",
    "matrix_float32": _IDX + "\nSELECT row, col, CAST(max(value) AS FLOAT) AS value FROM c2 GROUP BY ALL",
    "matrix_multigraph": _IDX + "\nSELECT row, col, value FROM c",
    "matrix_csc_indptr": _IDX + """
SELECT k, (SELECT count(*) FROM c WHERE col < k) AS start FROM (SELECT unnest(range((SELECT count(*) + 1 FROM idx))) AS k)""",
    "matrix_csr_entries": _IDX + """
SELECT row_number() OVER (ORDER BY row, col) - 1 AS pos, row AS k, col AS "index", value FROM c""",
    "matrix_dok": _IDX + "\nSELECT row, col, value FROM c",
    "matrix_csr_indptr": _IDX + """
SELECT k, (SELECT count(*) FROM c WHERE row < k) AS start FROM (SELECT unnest(range((SELECT count(*) + 1 FROM idx))) AS k)""",
    "component_sizes": _COMPONENTS + "\nSELECT component, count(*) AS n_nodes FROM label GROUP BY ALL",
    "graph_stats": _COMPONENTS + f""",
d AS (SELECT DISTINCT src, dst FROM e), n AS (SELECT count(*) AS nodes FROM nodes), m AS (SELECT count(*) AS edges FROM d)
SELECT nodes, edges, (SELECT count(*) FROM (SELECT DISTINCT rec_id, rec_type, loaded_at, k FROM ({_PATH_ROWS}))) AS paths, (SELECT count(DISTINCT component) FROM label) AS components,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest([src, dst]) AS node FROM d) GROUP BY node)) AS max_degree, round(edges / (CAST(nodes AS DOUBLE) * (nodes - 1)), 12) AS density
FROM n, m""",
    "graph_degrees": f"SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM (SELECT DISTINCT src, dst FROM {_BOTH})) GROUP BY ALL",
    "split_nodes": _SPLIT + "\nSELECT seg, a, b FROM cut",
    "split_chain": _SPLIT + "\nSELECT n.node AS src, m.node AS dst FROM named AS n JOIN named AS m ON m.seg = n.seg AND m.k = n.k + 1",
    "split_edges": _SPLIT + f",{_LOCATED}\nSELECT rec_id, from_node, to_node FROM located",
    "split_graph_nodes": _SPLIT + "\nSELECT node FROM named",
    "split_graph_edges": _SPLIT + f""",{_LOCATED},
steps AS (
  SELECT n.node AS src, m.node AS dst, '+' AS a, '+' AS b, 0 AS phase, NULL AS loaded_at, 0 AS rec_id FROM named AS n JOIN named AS m ON m.seg = n.seg AND m.k = n.k + 1
  UNION ALL SELECT from_node, to_node, a, b, phase, loaded_at, rec_id FROM located WHERE from_node IS NOT NULL AND to_node IS NOT NULL)
SELECT src, dst, arg_max(a, o) AS orientation_from, arg_max(b, o) AS orientation_to FROM (SELECT *, row_number() OVER (ORDER BY phase, loaded_at, rec_id) AS o FROM steps) GROUP BY ALL""",
    "export_edge_list": f"SELECT rec_id, src || ':' || a || chr(9) || dst || ':' || b AS line FROM {_BOTH}",
    "anchor_distances": f"""
WITH RECURSIVE e AS {_BOTH}, arcs AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(node, dist) USING KEY (node) AS (
  SELECT id AS node, CAST(0 AS DOUBLE) AS dist FROM anchor_segments
  UNION
  SELECT arcs.b, r.dist + 1 FROM reach AS r JOIN arcs ON arcs.a = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.reach AS x WHERE x.node = arcs.b))
SELECT node, dist FROM reach""",
    "weighted_distance": f"""
WITH RECURSIVE arcs AS (SELECT a, b, arg_max(q, o) AS q FROM ({_ORDER_LINKS}) GROUP BY ALL),
reach(node, dist) USING KEY (node) AS (
  SELECT min('p' || p_partkey) AS node, CAST(0 AS DOUBLE) AS dist FROM part
  UNION
  SELECT b, min(d) FROM (SELECT arcs.b, r.dist + arcs.q AS d FROM reach AS r JOIN arcs ON arcs.a = r.node) AS o
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach AS x WHERE x.node = o.b AND x.dist <= o.d) GROUP BY b)
SELECT node, dist FROM reach""",
    "distance_matrix_min": _brand_matrix("min(dist)", "WHERE rank_a < rank_b"),
    "distance_matrix_mean": _brand_matrix("avg(dist)", ""),
}
ORACLE["frontier_distances"] = ORACLE["anchor_distances"]
