"""Registered queries against their SQL on the smallest test data, and sinks, command line and stream."""

import json
import numbers
import xml.etree.ElementTree as ET
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from braidlake import api
from braidlake.cli import main
from braidlake.functions.records import parse_lines
from braidlake.operators import matrix as M
from braidlake.operators.graph import build_graph
from braidlake.plans import data_queries, graph_queries, text_queries
from braidlake.schema import GraphOptions
from braidlake.sinks import graphs, matrices
from braidlake.sources.gfa import from_lines
from braidlake.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
CORE = [(m, name) for m in (graph_queries, text_queries, data_queries) for name in m.ORACLE]


def plain(df):
    cell = lambda x: x if isinstance(x, str) else None if pd.isna(x) else round(float(x), 6) if isinstance(x, numbers.Number) else str(x)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize(("module", "name"), CORE, ids=[n for _, n in CORE])
def test_query_equals_sql(spark, sql, module, name):
    got, want = module.QUERIES[name](spark, FOLDER).toPandas(), sql.execute(module.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


F2 = "S\ts1\tACGT\tRC:i:5\nS\ts2\tTTTT\nL\ts1\t+\ts2\t-\t0M\tRC:i:3\nP\tp1\ts1+,s2-\t*\n"


@pytest.fixture
def gfa(tmp_path):
    (tmp_path / "a.gfa").write_text(F2)
    return str(tmp_path / "a.gfa")


def run(spark, capsys, *args):
    main(list(args), spark)
    return capsys.readouterr().out


def test_cli_prints(spark, capsys, gfa):
    assert run(spark, capsys, "stats", gfa) == "nodes\t 2\nedges\t 1\npaths\t 1\ncomponents\t 1\nmax_degree\t 1\ndensity\t 0.5\n"
    assert run(spark, capsys, "stat", gfa, "--undirected").startswith("nodes\t 2")
    assert run(spark, capsys, "export", gfa) == "s1\ts2\n"
    assert run(spark, capsys, "export", gfa, "--bidirected") == "s1:+\ts2:-\n"
    assert run(spark, capsys, "distance", gfa, "--seq", "ACGT", "TTTT") == "1\n"
    assert run(spark, capsys, "distance", gfa, "--path", "p1", "p1") == "0\n"
    with pytest.raises(SystemExit, match="unknown path: p9"):
        main(["distance", gfa, "--path", "p1", "p9"], spark)
    with pytest.raises(SystemExit):
        main(["convert", gfa], spark)
    with pytest.raises(SystemExit):
        main(["distance", gfa], spark)


def test_cli_files(spark, capsys, gfa, tmp_path):
    out = str(tmp_path / "m.npz")
    assert "Using backend: igraph" in run(spark, capsys, "convert", gfa, "--graph", "--matrix", out, "--backend", "igraph", "--weight-tag", "RC", "-o", str(tmp_path / "g"))
    m = np.load(out)
    assert m["data"].tolist() == [3.0] and m["indptr"].tolist() == [0, 1, 1] and m["indices"].tolist() == [1]
    assert Path(out + ".nodes.tsv").read_text() == "0\ts1\n1\ts2\n"
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 1
    run(spark, capsys, "convert", gfa, "--matrix", str(tmp_path / "m.csv"), "--no-node-map", "--asymmetric")
    assert (tmp_path / "m.csv").read_text() == "0,1\n0,0\n" and not (tmp_path / "m.csv.nodes.tsv").exists()
    with pytest.raises(SystemExit, match="GB"):
        main(["--max-dense-gb", "1e-9", "convert", gfa, "--matrix", str(tmp_path / "x.npy")], spark)
    for name in ("d.csv", "d.npy", "d.npz"):
        run(spark, capsys, "distance-matrix", gfa, "-o", str(tmp_path / name), "--method", "mean")
    assert np.load(tmp_path / "d.npy").tolist() == [[0.0]] and (tmp_path / "d.npy.paths.tsv").read_text() == "0\tp1\n"
    run(spark, capsys, "convert", gfa, "--matrix-tables", str(tmp_path / "t"), "--asymmetric")
    assert [(r.k, r["index"], r.value) for r in spark.read.parquet(str(tmp_path / "t" / "entries")).collect()] == [(0, 1, 1.0)]
    assert spark.read.parquet(str(tmp_path / "t" / "indptr")).count() == 3 and spark.read.parquet(str(tmp_path / "t" / "nodes")).count() == 2


def test_graph_files(spark, capsys, gfa, tmp_path):
    run(spark, capsys, "export", gfa, "--format", "graphml", "--output", str(tmp_path / "g.graphml"))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.parse(tmp_path / "g.graphml").getroot()
    assert sorted(n.get("id") for n in root.iter(f"{ns}node")) == ["s1", "s2"]
    assert [(e.get("source"), e.get("target")) for e in root.iter(f"{ns}edge")] == [("s1", "s2")]
    run(spark, capsys, "--raw-bytes-id", "export", gfa, "--format", "gexf", "--output", str(tmp_path / "g.gexf"))
    assert "b's1'" in (tmp_path / "g.gexf").read_text()
    ET.parse(tmp_path / "g.gexf")
    data = json.loads(run(spark, capsys, "export", gfa, "--format", "json", "--bidirected"))
    assert data["multigraph"] and not data["directed"] and len(data["nodes"]) == 4 and len(data["links"]) == 2


def test_one_call_per_task(spark, gfa, capsys, tmp_path):
    assert api.load_graph(spark, gfa, bidirected=True).edges.count() == 2
    assert api.load_multigraph(spark, gfa).edges.count() == 1
    entries, index = api.load_matrix(spark, gfa, asymmetric=True)
    assert entries.count() == 1 and index.count() == 2
    assert api.load_paths(spark, gfa).count() == 2
    assert api.compute_stats(spark, gfa) == {"nodes": 2, "edges": 1, "paths": 1, "components": 1, "max_degree": 1, "density": 0.5}
    assert api.path_distances(spark, gfa).count() == 1
    main(["--raw-bytes-id", "convert", gfa, "--graph", "--verbose", "-o", str(tmp_path / "raw")], spark)
    printed = capsys.readouterr()
    assert "[convert] done" in printed.out and "records" in printed.err
    assert spark.read.parquet(str(tmp_path / "raw" / "nodes")).schema["node"].dataType.simpleString() == "binary"


def test_stored_attributes_are_written(spark, tmp_path):
    graph = build_graph(parse_lines(from_lines(spark, F2.splitlines())), GraphOptions(store_seq=True, store_tags=True, weight_tag="RC"))
    graphs.write_graphml(graph, str(tmp_path / "g.graphml"))
    text = (tmp_path / "g.graphml").read_text()
    assert "ACGT" in text and '{"RC": 5}' in text and ">3.0<" in text
    graphs.write_json(graph, str(tmp_path / "g.json"))
    data = json.loads((tmp_path / "g.json").read_text())
    assert data["links"][0]["tags"] == {"RC": 3} and data["links"][0]["weight"] == 3.0
    graphs.write_edge_list_parts(parse_lines(from_lines(spark, F2.splitlines())), str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).collect()[0][0] == "s1\ts2"


def test_matrix_files(spark, tmp_path):
    graph = build_graph(parse_lines(from_lines(spark, ["L\ta\t+\tb\t+\t0M", "L\tb\t+\tc\t+\t0M"])))
    coo = M.coo_matrix(graph, asymmetric=True)
    for fmt, keys in (("csr", "indptr"), ("CSC", "indptr"), ("coo", "row"), ("dok", "col")):
        matrices.save_matrix(coo, 3, tmp_path / f"{fmt}.npz", fmt)
        assert keys in np.load(tmp_path / f"{fmt}.npz")
    matrices.save_matrix(coo, 3, tmp_path / "m.npy")
    assert np.load(tmp_path / "m.npy").tolist() == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]
    matrices.save_matrix(M.coo_matrix(graph, dtype="bool"), 3, tmp_path / "b.npy")
    assert np.load(tmp_path / "b.npy").dtype == bool
    with pytest.raises(ValueError):
        matrices.save_matrix(coo, 3, tmp_path / "m.txt")
    with pytest.raises(ValueError):
        matrices.save_matrix(coo, 3, tmp_path / "m.npz", "bsr")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gfa").write_text("L\ta\t+\tb\t+\t0M\nL\ta\nS\ts\t*\n")
    query = ingest.merged_edges(ingest.stream_records(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("merged").start()
    try:
        query.processAllAvailable()
        (tmp_path / "in" / "b.gfa").write_text("L\ta\t+\tb\t-\t0M\n")
        query.processAllAvailable()
        assert [(r.src, r.dst, r.orientation_to, r.n_records) for r in spark.table("merged").collect()] == [("a", "b", "-", 2)]
    finally:
        query.stop()


def test_stream_of_links(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/links.parquet")
    rows.write.parquet(str(tmp_path / "links"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "links"))
    once = ingest.links_per_period(stream, late="400 days")
    query = once.writeStream.outputMode("complete").format("memory").queryName("periods").start()
    try:
        query.processAllAvailable()
        assert spark.table("periods").agg({"n_links": "sum"}).collect()[0][0] == rows.count()
    finally:
        query.stop()
    query = ingest.deduplicated(stream, late="400 days").writeStream.outputMode("append").format("memory").queryName("unique").start()
    try:
        query.processAllAvailable()
        assert spark.table("unique").count() == rows.select("rec_id").distinct().count()
    finally:
        query.stop()
