import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidlake.functions.records import parse_lines
from braidlake.operators import components, split
from braidlake.operators import distance as D
from braidlake.operators import matrix as M
from braidlake.operators import pairs as pairs_module
from braidlake.operators.components import connected_components
from braidlake.operators.graph import Graph, build_graph, raw_ids, warn_directed_bidirected, warn_tag_memory
from braidlake.operators.paths import load_paths, path_count
from braidlake.operators.split import intervals, split_on_alignment, warn_growth, warn_skipped
from braidlake.operators.stats import stats
from braidlake.schema import GraphOptions
from braidlake.sources.gfa import from_lines

F1 = ("S\ts1\t4", "S\ts2\t4", "L\ts1\t+\ts2\t-\t0M")
F2 = ("S\ts1\tACGT", "S\ts2\tTTTT", "L\ts1\t+\ts2\t-\t0M", "P\tp1\ts1+,s2-\t*")
F9 = ("S\ts1\t*", "S\ts2\t*", "S\ts3\t*", "L\ts1\t+\ts2\t+\t0M", "L\ts2\t+\ts3\t+\t0M", "P\tp1\ts1+,s2+\t*", "P\tp2\ts3+,s2+\t*")
F10 = ("S\ts1\tAAAA", "S\ts2\tTTTT", "S\ts3\tAAAA", "L\ts1\t+\ts2\t+\t0M", "L\ts3\t+\ts1\t+\t0M")
F11 = ("S\ts1\t6", "S\ts2\t10", "E\t*\ts1+\t0\t6\ts2+\t0\t6\t6M")


def records(spark, lines):
    return parse_lines(from_lines(spark, lines)).cache()


def graph(spark, lines, **options):
    return build_graph(records(spark, lines), GraphOptions(**options))


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def entries(coo):
    return {(r.row, r.col): r.value for r in coo.collect()}


def matrix_of(g, **kw):
    return entries(M.coo_matrix(g, **kw))


def test_simple_and_bidirected(spark):
    g = graph(spark, F1)
    assert g.nodes.count() == 2 and pairs(g.edges) == [("s1", "s2")] and g.directed
    b = graph(spark, F1, bidirected=True)
    assert not b.directed and b.nodes.count() == 4
    assert pairs(b.edges) == [("s1:+", "s2:-"), ("s2:+", "s1:-")]
    assert D.genome_distance(b, ["s1:+"], ["s2:-"]) == 1 and D.genome_distance(b, ["s1:-"], ["s2:+"]) == 1
    k = graph(spark, F1, bidirected=True, keep_directed_bidir=True)
    assert k.directed and pairs(k.edges) == [("s1:+", "s2:-")]


def test_matrices(spark):
    g = graph(spark, F1)
    assert {r.node: r.idx for r in M.node_index(g).collect()} == {"s1": 0, "s2": 1}
    assert matrix_of(g, asymmetric=True) == {(0, 1): 1.0}
    assert matrix_of(g) == {(0, 1): 1.0, (1, 0): 1.0}
    assert matrix_of(g, dtype="bool") == {(0, 1): True, (1, 0): True}
    assert matrix_of(g, dtype="int8", asymmetric=True) == {(0, 1): 1}
    with pytest.raises(ValueError):
        M.coo_matrix(g, dtype="int64")


def test_last_record_wins_attribute_by_attribute(spark):
    n1 = ("L\ta\t+\tb\t+\t0M\tRC:i:2", "L\ta\t+\tb\t-\t0M")
    (e,) = graph(spark, n1, weight_tag="RC").edges.collect()
    assert (e.weight, e.orientation_from, e.orientation_to) == (2.0, "+", "-")
    assert matrix_of(graph(spark, n1, weight_tag="RC"), asymmetric=True) == {(0, 1): 3.0}
    n2 = (*n1, "L\tb\t+\ta\t+\t0M\tRC:i:7")
    (e,) = graph(spark, n2, weight_tag="RC", directed=False).edges.collect()
    assert (e.weight, e.orientation_from, e.orientation_to) == (7.0, "+", "+")
    assert matrix_of(graph(spark, n2, weight_tag="RC", directed=False)) == {(0, 1): 10.0, (1, 0): 10.0}


def test_weight_of_other_types(spark):
    lines = ("L\ta\t+\tb\t+\t0M\tRC:Z:5", "L\tb\t+\tc\t+\t0M\tRC:f:2.5", "L\tc\t+\td\t+\t0M\tRC:i:1\tRC:Z:x")
    got = {(r.src, r.dst): r.weight for r in graph(spark, lines, weight_tag="RC").edges.collect()}
    assert got == {("a", "b"): None, ("b", "c"): 2.5, ("c", "d"): None}


def test_loops(spark):
    n3 = graph(spark, ("L\ta\t+\ta\t+\t0M",), directed=False)
    assert matrix_of(n3) == {(0, 0): 2.0}
    assert stats(records(spark, ("L\ta\t+\ta\t+\t0M",)), directed=False).collect()[0].max_degree == 2
    n4 = graph(spark, ("L\tu\t+\tu\t-\t0M",), bidirected=True)
    assert pairs(n4.edges) == [("u:+", "u:-"), ("u:+", "u:-")]
    assert matrix_of(n4) == {(0, 1): 2.0, (1, 0): 2.0}


def test_one_sided_negatives_vanish(spark):
    g = graph(spark, ("L\ta\t+\tb\t+\t0M\tRC:i:-1", "L\tb\t+\tc\t+\t0M\tRC:i:-3", "L\tc\t+\tb\t+\t0M\tRC:i:-2"), weight_tag="RC")
    assert matrix_of(g) == {(1, 2): -2.0, (2, 1): -2.0}


def test_keep_directed_without_bidirected(spark):
    g = graph(spark, ("L\ta\t+\tb\t+\t0M",), directed=False, keep_directed_bidir=True)
    assert not g.directed and matrix_of(g, asymmetric=True) == {(0, 1): 1.0} and matrix_of(g) == {(0, 1): 1.0, (1, 0): 1.0}


def test_strip_orientation(spark):
    g = graph(spark, ("S\ts1+\t*", "L\ts1+\t+\ts2-\t+\t0M"), strip_orientation=True)
    assert sorted(r.node for r in g.nodes.collect()) == ["s1", "s1+", "s2"]
    assert pairs(g.edges) == [("s1", "s2")] and "orientation_from" not in g.edges.columns


def test_attributes(spark):
    lines = ("L\ts1\t+\ts2\t-\t0M\tRC:i:3", "S\ts1\t4\tRC:i:5", "S\ts2\t4\tACGT", "S\ts1\t9")
    g = graph(spark, lines, store_tags=True, store_seq=True, weight_tag="RC")
    got = {r.node: r for r in g.nodes.collect()}
    assert got["s1"].length == 9 and got["s1"].tags["RC"].i == 5 and got["s2"].sequence == "ACGT"
    (e,) = g.edges.collect()
    assert e.weight == 3.0 and e.tags["RC"].i == 3
    plain = graph(spark, lines)
    assert plain.nodes.columns == ["node"] and "tags" not in plain.edges.columns
    first = {r.node: r for r in graph(spark, lines, store_tags=True, multigraph=True).nodes.collect()}
    assert first["s1"].length is None
    with pytest.warns(RuntimeWarning):
        warn_tag_memory(g, 1e-6)


def test_multigraph_keeps_edges(spark):
    lines = ("L\ta\t+\tb\t+\t0M", "L\ta\t+\tb\t-\t0M")
    assert graph(spark, lines, multigraph=True).edges.count() == 2
    assert graph(spark, lines).edges.count() == 1


def test_raw_ids(spark):
    assert {bytes(r.node) for r in raw_ids(graph(spark, F1).nodes, ["node"]).collect()} == {b"s1", b"s2"}


def test_stats(spark):
    row = stats(records(spark, F2)).collect()[0]
    assert tuple(row) == (2, 1, 1, 1, 1, 0.5)
    row = stats(records(spark, ("S\ts1\t*", "S\ts2\t*", "O\tw1\ts1+,s2+"))).collect()[0]
    assert (row.nodes, row.edges, row.paths, row.components, row.max_degree, row.density) == (2, 0, 1, 2, 0, 0.0)
    row = stats(records(spark, ("H\tx",))).collect()[0]
    assert tuple(row) == (0, 0, 0, 0, 0, 0.0)


@pytest.mark.parametrize("least", [1_000_000, 0])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(components, "LEAST_SKEWED", least)
    n = 300
    chain = [(f"{i:04}", f"{i + 1:04}") for i in range(n) if i % 100 != 99]
    edges = spark.createDataFrame([*chain, (None, "0001"), ("0005", "0005")], "src string, dst string")
    nodes = spark.createDataFrame([(f"{i:04}",) for i in range(n + 1)], "node string")
    got = {r.node: r.component for r in connected_components(nodes, edges).collect()}
    assert len(got) == n + 1 and got["0099"] == "0000" and got["0150"] == "0100" and got["0250"] == "0200" and got["0300"] == "0300" and len(set(got.values())) == 4


def test_paths(spark):
    recs = records(spark, ("P\tp1\ts1+,s2-\t*", "O\tw1\ts3+", "P\tp1\ts9+\t*"))
    assert path_count(recs).collect()[0][0] == 3
    assert [(r.name, r.pos, r.node) for r in load_paths(recs).orderBy("path_rank", "pos").collect()] == [("p1", 0, "s9"), ("w1", 0, "s3")]


def test_distances(spark):
    g = graph(spark, F10, store_seq=True)
    assert D.sequence_distance(g, "AAAA", "TTTT") == 1
    with pytest.raises(D.NoPath):
        D.sequence_distance(g, "TTTT", "AAAA")
    with pytest.raises(KeyError):
        D.sequence_distance(g, "AAAA", "C")
    with pytest.raises(ValueError):
        D.sequence_distance(graph(spark, F10), "AAAA", "TTTT")
    f9 = graph(spark, F9)
    assert D.genome_distance(f9, ["s1", "s2"], ["s3", "s2"]) == 0
    assert D.genome_distance(f9, ["s1", "s2"], ["s3", "s2"], "mean") == 1.0
    with pytest.raises(ValueError):
        D.genome_distance(f9, ["s1"], ["s2"], "max")
    with pytest.raises(KeyError):
        D.genome_distance(f9, ["nowhere"], ["s2"])


@pytest.mark.parametrize("limit", [1000, 0])
def test_search_both_ways(spark, limit):
    lines = ("L\ta\t+\tb\t+\t0M\tRC:i:5", "L\ta\t+\tc\t+\t0M\tRC:i:1", "L\tc\t+\tb\t+\t0M\tRC:i:1", "L\tb\t+\td\t+\t0M", "S\te\t*")
    sources = spark.createDataFrame([("x", "a"), ("y", "c"), ("y", "e")], "source string, node string")
    for tag, want in (("RC", {("x", "a"): 0, ("x", "b"): 2, ("x", "c"): 1, ("x", "d"): 3, ("y", "c"): 0, ("y", "b"): 1, ("y", "d"): 2, ("y", "e"): 0}), (None, {("x", "a"): 0, ("x", "b"): 1, ("x", "c"): 1, ("x", "d"): 2, ("y", "c"): 0, ("y", "b"): 1, ("y", "d"): 2, ("y", "e"): 0})):
        got = D.search(graph(spark, lines, weight_tag=tag), sources, broadcast_edges=limit)
        assert {(r.source, r.node): r.dist for r in got.collect()} == want
    with pytest.raises(ValueError, match="negative"):
        D.search(graph(spark, ("L\ta\t+\tb\t+\t0M\tRC:i:-1",), weight_tag="RC"), spark.createDataFrame([("x", "a")], "source string, node string"))


def test_distance_matrix(spark):
    recs = records(spark, (*F9, "S\tlone\t*", "P\tp3\tlone+\t*"))
    inf = float("inf")
    assert D.pivoted(D.genome_distance_matrix(recs)).tolist() == [[0, 0, inf], [0, 0, inf], [inf, inf, 0]]
    mean = D.pivoted(D.genome_distance_matrix(recs, "mean"))
    assert mean[0, 1] == mean[1, 0] == pytest.approx(1 / 3) and mean[0, 2] == inf


def test_matrix_of_a_ring(spark):
    # a ring of thirteen nodes, run one way round, and three paths of unequal length on it
    ring = [f"r{k}" for k in range(13)]
    links = [f"L\t{u}\t+\t{v}\t+\t0M" for u, v in zip(ring, ring[1:] + ring[:1], strict=True)]
    paths = {"one": ["r2"], "two": ["r5", "r6"], "far": ["r12", "r1"]}
    recs = records(spark, [*links, *[f"P\t{name}\t{','.join(x + '+' for x in nodes)}\t*" for name, nodes in paths.items()]])
    hops = lambda u, v: (int(v[1:]) - int(u[1:])) % 13
    names, least = D.labelled(D.genome_distance_matrix(recs))
    mean = D.pivoted(D.genome_distance_matrix(recs, "mean"))
    assert names == ["one", "two", "far"]
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i < j:
                assert least[i, j] == least[j, i] == min(hops(u, v) for u in paths[a] for v in paths[b])
                near = [min(hops(u, v) for u in paths[a]) for v in paths[b]] + [min(hops(u, v) for u in paths[b]) for v in paths[a]]
                assert mean[i, j] == mean[j, i] == pytest.approx(sum(near) / len(near))


def test_a_deep_chain(spark):
    # 20,000 hops, contracted until what is left can be broadcast
    n = 20_000
    edges = spark.range(n).select(F.format_string("n%d", "id").alias("src"), F.format_string("n%d", F.col("id") + 1).alias("dst"), F.lit(None).cast("double").alias("weight"))
    nodes = spark.range(n + 1).select(F.format_string("n%d", "id").alias("node"))
    sources = spark.createDataFrame([("x", "n0"), ("y", f"n{n // 4}")], "source string, node string")
    g = Graph(nodes, edges, edges, nodes, GraphOptions(), True)
    got = D.search(g, sources, broadcast_edges=n // 2).groupBy("source").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()
    assert {r.source: (r.n, r.far) for r in got} == {"x": (n + 1, n), "y": (n - n // 4 + 1, n - n // 4)}


def test_contraction_of_any_graph(spark):
    # chains, bubbles, trees, loops and hubs, weighted, searched both ways, with sources and asked nodes anywhere
    rng = random.Random(3)
    arcs = {}
    for k in range(60):
        arcs[f"c{k}", f"c{k + 1}"] = rng.randrange(1, 9)
        if k % 5 == 0:
            arcs[f"c{k}", f"b{k}"], arcs[f"b{k}", f"c{k + 1}"] = rng.randrange(1, 9), rng.randrange(9)
        if k % 7 == 0:
            arcs[f"c{k}", f"t{k}"], arcs[f"t{k}", f"c{k}"] = 1, 2
        arcs["c30", f"h{k}"] = rng.randrange(1, 50)
    arcs["c9", "c9"], arcs["q0", "q1"], arcs["q1", "q0"] = 1, 1, 1
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in arcs.items()], "src string, dst string, weight double")
    names = sorted({x for e in arcs for x in e})
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    starts = {"x": ["c3", "b20"], "y": ["t14"], "z": ["q1", "h7"]}
    sources = spark.createDataFrame([(s, x) for s, xs in starts.items() for x in xs], "source string, node string")
    asked = ["c3", "c4", "b25", "t42", "h9", "q0", "c60"]

    def brute(directed, source):
        best = dict.fromkeys(starts[source], 0.0)
        for _ in names:
            for (a, b), w in arcs.items():
                for u, v in ((a, b),) if directed else ((a, b), (b, a)):
                    if u in best and best[u] + w < best.get(v, float("inf")):
                        best[v] = best[u] + w
        return best

    for directed, limit in ((True, 60), (False, 60)):
        g = Graph(nodes, edges, edges, nodes, GraphOptions(directed=directed, weight_tag="RC"), directed)
        want = {(s, x): d for s in starts for x, d in brute(directed, s).items()}
        assert {(r.source, r.node): r.dist for r in D.search(g, sources, broadcast_edges=limit).collect()} == want
    some = D.search(g, sources, spark.createDataFrame([(x,) for x in asked], "node string"), broadcast_edges=60)
    assert {(r.source, r.node): r.dist for r in some.collect()} == {k: d for k, d in want.items() if k[1] in asked}


def test_warnings(spark, monkeypatch):
    star = [f"L\thub\t+\ta{i}\t+\t0M" for i in range(50)] + [f"L\thub\t+\tb{i}\t+\t0M" for i in range(21)]
    g = graph(spark, star, directed=False)
    with pytest.warns(RuntimeWarning, match="1050 pairs"):
        assert D.genome_distance(g, [f"a{i}" for i in range(50)], [f"b{i}" for i in range(21)], "mean") == 2.0
    k = graph(spark, F1, bidirected=True, keep_directed_bidir=True)
    with pytest.warns(RuntimeWarning, match="oriented"):
        warn_directed_bidirected(k)
    assert D.genome_distance(k.to_undirected(), ["s2:-"], ["s1:+"]) == 1


def test_split(spark):
    recs = records(spark, F11)
    g = build_graph(recs, GraphOptions(split_on_alignment=True))
    assert sorted(r.node for r in g.nodes.collect()) == ["s1:0-6", "s2:0-6", "s2:6-10"]
    assert g.edges.count() == 2 and D.genome_distance(g, ["s1:0-6"], ["s2:6-10"]) == 2
    f12 = build_graph(records(spark, ("S\ts1\t6", "S\ts2\t10", "E\t*\ts1\t+\ts2\t+")), GraphOptions(split_on_alignment=True))
    assert sorted(r.node for r in f12.nodes.collect()) == ["s1:0-6", "s2:0-10"] and f12.edges.count() == 1


def test_split_last_link_wins(spark):
    lines = ("S\ts1\t6", "S\ts2\t10", "L\ts1\t+\ts2\t-\t0M", "E\t*\ts1+\t0\t3\ts2+\t0\t3\t3M")
    g = build_graph(records(spark, lines), GraphOptions(split_on_alignment=True))
    assert sorted(r.node for r in g.nodes.collect()) == ["s1:0-3", "s1:3-6", "s2:0-3", "s2:3-10"]
    got = {(r.src, r.dst): (r.orientation_from, r.orientation_to) for r in g.edges.collect()}
    assert len(got) == 3 and got["s1:0-3", "s2:0-3"] == ("+", "-")


def test_split_skips_edges_over_several_intervals(spark):
    recs = records(spark, ("S\ts1\t6", "S\ts2\t10", "E\t*\ts1+\t0\t6\ts2+\t0\t3\t*", "E\t*\ts1+\t0\t6\ts2+\t0\t7\t*"))
    assert sorted(r.id for r in split_on_alignment(recs).where("rec_type = 'S'").collect()) == ["s1:0-6", "s2:0-3", "s2:3-7", "s2:7-10"]
    assert pairs(split_on_alignment(recs).where("rec_type = 'E'")) == [("s1:0-6", "s2:0-3")]
    with pytest.warns(RuntimeWarning, match="s1 -> s2") as found:
        warn_skipped(recs)
    assert sum("s1 -> s2" in str(w.message) for w in found) == 1
    lines = ["S\ts1\t6", *[f"E\t*\ts1+\t0\t{i}\ts9+\t0\t3\t*" for i in range(25)]]
    with pytest.warns(RuntimeWarning) as found:
        warn_skipped(records(spark, lines))
    assert len([w for w in found if "s1 -> s9" in str(w.message)]) == 20 and any("5 more" in str(w.message) for w in found)
    many = records(spark, ("S\ts1\t50", *[f"E\t*\ts1+\t{i}\t{i + 1}\ts1+\t0\t1\t*" for i in range(20)]))
    with pytest.warns(RuntimeWarning, match="intervals"):
        warn_growth(many)


def test_split_of_a_hot_segment(spark, monkeypatch):
    # every second edge is at one segment, whose breakpoints are numbered over all tasks
    monkeypatch.setattr(split, "frequent_candidates", lambda df, key: ["hot"])
    lines = ["S\thot\t500", "S\tb\t9", *[f"E\t*\thot+\t{5 * i}\t{5 * i + 5}\tb+\t0\t9\t*" for i in range(80)], "L\thot\t+\tb\t-\t0M", "L\tb\t+\tlost\t-\t0M"]
    recs = records(spark, lines)
    got = sorted((r.a, r.b) for r in intervals(recs).where("seg = 'hot'").collect())
    assert got == [(5 * i, 5 * i + 5) for i in range(80)] + [(400, 500)]
    edges = {(r.from_node, r.to_node) for r in split.rewired(recs).collect()}
    assert ("hot:395-400", "b:0-9") in edges and ("hot:0-5", "b:0-9") in edges and ("b:0-9", None) in edges and len(edges) == 81
    chain = {(r.src, r.dst) for r in split.chain_links(intervals(recs)).collect()}
    assert len(chain) == 80 and ("hot:395-400", "hot:400-500") in chain


def test_split_without_length(spark):
    recs = records(spark, ("S\ts1\tACGT",))
    assert [(r.node, r.b - r.a) for r in intervals(recs).collect()] == [("s1:0-0", 0)]


def test_compressed(spark):
    coo = spark.createDataFrame([(0, 2, 1.0), (0, 1, 2.0), (3, 0, 4.0)], "row bigint, col bigint, value double")
    indptr, rows = M.compressed(coo, 5)
    assert [r.start for r in indptr.orderBy("k").collect()] == [0, 2, 2, 2, 3, 3]
    assert [(r["index"], r.value) for r in rows.orderBy("pos").collect()] == [(1, 2.0), (2, 1.0), (0, 4.0)]
    indptr, cols = M.convert_format(coo, "CSC", 5)
    assert [r.start for r in indptr.orderBy("k").collect()] == [0, 1, 2, 3, 3, 3]
    assert M.convert_format(coo, "coo", 5) is coo and M.convert_format(coo, "dok", 5).count() == 3
    with pytest.raises(ValueError):
        M.convert_format(coo, "bsr", 5)
    empty, none = M.compressed(coo.where(F.lit(False)), 2)
    assert [r.start for r in empty.orderBy("k").collect()] == [0, 0, 0] and none.count() == 0


def test_dense_guard():
    with pytest.raises(MemoryError):
        M.check_dense(400, 798, "float64", 0.001)
    M.check_dense(400, 798, "float64", 0.001, by_nnz=True)
    M.check_dense(400, 798, "float32", 1.0)


def test_chain_entries(spark):
    lines = [f"S\ts{i}\t*" for i in range(400)] + [f"L\ts{i}\t+\ts{i + 1}\t+\t0M" for i in range(399)]
    g = graph(spark, lines)
    index = M.node_index(g)
    assert M.coo_matrix(g, index).count() == 798 and M.coo_matrix(g, index, asymmetric=True).count() == 399


def _hops(edges, a):
    near, front, ways = {a: 0}, [a], {}
    for u, v in edges:
        ways.setdefault(u, []).append(v)
        ways.setdefault(v, []).append(u)
    while front:
        front = [v for u in front for v in ways.get(u, []) if near.setdefault(v, near[u] + 1) == near[u] + 1 and v not in front]
        front = list(dict.fromkeys(front))
    return near


def test_pairs_are_counted_without_a_row_each(spark, monkeypatch):
    """More edges than are broadcast with their names: pairs aren't searched one by one, however many sources there are."""
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(160)} | {("hub", f"n{i}") for i in range(60)} | {(f"c{i}", f"c{i + 1}") for i in range(40)}
    g = graph(spark, [f"S\t{n}\t*" for n in ("lone", "alone")] + [f"L\t{u}\t+\t{v}\t+\t*" for u, v in sorted(edges)], directed=False)
    names = sorted({n for e in edges for n in e})
    a = [*rng.sample(names, 90), "hub", "hub", "c0", "lone", "lone", "alone"]
    b = [*rng.choices(names, k=120), "c40", "lone", "absent"]
    near = {x: _hops(edges, x) for x in set(a)}
    found = [near[x][y] for x in a for y in b if y in near[x]]
    monkeypatch.setattr(D.search, "__defaults__", (None, 3))
    monkeypatch.setattr(D, "_contracted_search", None)
    monkeypatch.setattr(pairs_module, "_hashed", lambda name, seed: F.xxhash64(F.lit(seed), name) if seed else F.length(name).cast("bigint"))
    monkeypatch.setenv("BRAIDLAKE_DISABLE_WARNINGS", "1")
    assert max(found) == 40 and D.genome_distances(g, a, b) == {"min": 0, "mean": pytest.approx(sum(found) / len(found), abs=1e-12)}
    assert D.genome_distance(g, ["c3", "c1"], ["c9", "c30"]) == 6
    with pytest.raises(D.NoPath):
        D.genome_distance(g, ["c3"], ["lone"], "mean")
    with pytest.raises(KeyError, match="absent"):
        D.genome_distance(g, ["c3", "absent"], ["c4"], "mean")


def test_pairs_beyond_the_numbered_edges(spark, monkeypatch):
    g = graph(spark, [*F9, "L\ts1\t+\ts3\t+\t0M"])
    few = D.genome_distances(g, ["s1", "s2", "s2"], ["s3", "s2"])
    monkeypatch.setattr(D, "NUMBERED_EDGES", 2)
    assert D.genome_distances(g, ["s1", "s2", "s2"], ["s3", "s2"]) == few == {"min": 0, "mean": 4 / 6}


def test_arcs_are_followed_in_parts(monkeypatch):
    """Whatever part of a node's arcs is followed at once, each source's bit arrives when it should."""
    rng = random.Random(6)
    edges = {(rng.randrange(80), rng.randrange(100)) for _ in range(90)} | {(7, i) for i in range(40)}
    arrays = [np.array(x, np.int32) for x in zip(*sorted(edges), strict=True)]
    for most in (1, 7, 1 << 21):
        monkeypatch.setattr(pairs_module, "ARCS_AT_ONCE", most)
        levels = pairs_module.Numbered(120, *arrays, False).levels(np.array([7, 99, 119, 3]), np.array([1, 2, 4, 1], np.uint64))
        got = {(int(v), bit): step for step, (nodes, words) in enumerate(levels) for v, w in zip(nodes, words, strict=True) for bit in (1, 2, 4) if int(w) & bit}
        near = {(v, bit): d for bit, x in ((1, 7), (2, 99), (4, 119)) for v, d in _hops(edges, x).items()}
        for v, d in _hops(edges, 3).items():
            near[v, 1] = min(d, near.get((v, 1), d))
        assert got == near
