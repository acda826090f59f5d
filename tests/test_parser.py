import gzip
import io

import pytest
from pyspark.sql import functions as F

from braidlake.functions.records import parse_lines
from braidlake.sinks.graphs import tag_value
from braidlake.sources.gfa import from_lines, read_lines, read_records, warn_unsupported


def parsed(spark, *lines, **kw):
    return parse_lines(from_lines(spark, lines), **kw).orderBy("ord").collect()


def tags(row):
    return None if row.tags is None else {k: tag_value(v) for k, v in row.tags.items()}


def test_segment_forms(spark):
    a, b, c, d, e, f = parsed(spark, "S\ts1\t4\tRC:i:5", "S\ts2\t4\t", "S\ts3\t10", "S\ts4\tACGT\tLN:i:4", "S\ts5\t*", "S\ts6\t5\r")
    assert (a.id, a.length, a.sequence, tags(a)) == ("s1", 4, None, {"RC": 5})
    assert (b.length, b.sequence, b.tags) == (4, "", None)
    assert (c.length, c.sequence) == (10, None)
    assert (d.length, d.sequence, tags(d)) == (None, "ACGT", {"LN": 4})
    assert (e.length, e.sequence) == (None, "*")
    assert f.length == 5


def test_segment_with_id_only(spark):
    (a,) = parsed(spark, "S\ts1")
    assert (a.id, a.length, a.sequence, a.tags) == ("s1", None, None, None)


def test_link_forms(spark):
    a, b = parsed(spark, "L\ts1\t+\ts2\t-\t0M\tRC:i:2", "L\ta+\tb-\t4M\tx\tRC:i:1")
    assert (a.src, a.orientation_from, a.dst, a.orientation_to, a.overlap, tags(a)) == ("s1", "+", "s2", "-", "0M", {"RC": 2})
    assert (b.src, b.orientation_from, b.dst, b.orientation_to, b.overlap, tags(b)) == ("a", "+", "b", "-", "4M", {"RC": 1})


def test_edge_forms(spark):
    a, b, c = parsed(spark, "E\t*\ts1+\t0\t6\ts2-\t0\t6\t6M\tRC:i:1", "E\te1\ta+\t0\t6$\tb+\t0\t6\t*", "E\t*\ts1\t+\ts2\t-")
    assert (a.src, a.orientation_from, a.dst, a.orientation_to, a.from_start, a.from_end, a.to_start, a.to_end, a.cigar) == ("s1", "+", "s2", "-", 0, 6, 0, 6, "6M")
    assert (b.src, b.orientation_from, b.dst, b.orientation_to, b.from_start) == ("a+", "0", "6$", "b+", None)
    assert (c.src, c.orientation_from, c.dst, c.orientation_to) == ("s1", "+", "s2", "-")
    (d,) = parsed(spark, "E\te1\ta+\t0\t6$\tb+\t0\t6\t*", strict_gfa2=True)
    assert (d.src, d.dst, d.from_end, d.to_end) == ("a", "b", 6, 6)


def test_containment_forms(spark):
    a, b = parsed(spark, "C\ta\t+\tb\t-\t5\t4M\tRC:i:9", "C\t*\ta+\t0\t6\tb-\t1\t7\t6M")
    assert (a.src, a.orientation_from, a.dst, a.orientation_to, a.from_start, tags(a)) == ("a", "+", "b", "-", None, {"RC": 9})
    assert (b.src, b.dst, b.orientation_to, b.to_start, b.to_end) == ("a", "b", "-", 1, 7)


def test_paths_and_walks(spark):
    a, b = parsed(spark, "P\tp1\ts1+,s2-,s3\t*\tRC:i:1", "O\tw1\ts1++,s2-")
    assert [tuple(s) for s in a.steps] == [("s1", "+"), ("s2", "-"), ("s3", "+")] and tags(a) == {"RC": 1}
    assert [tuple(s) for s in b.steps] == [("s1+", "+"), ("s2", "-")]


def test_tags(spark):
    (a,) = parsed(spark, "L\ta\t+\tb\t+\t0M\tZB:B:i,1,2\tZC:B:1,,2\tF1:f:1e3\tF2:f:5d\tI1:i:x\tI2:i:+5\tS1:Z:a:b\tRC:i:1\tRC:i:2\tbad\tB0:B:")
    assert tags(a) == {"ZB": ["i", "1", "2"], "ZC": [1, 2], "F1": 1000.0, "I2": 5, "S1": "a:b", "RC": 2, "B0": []}


@pytest.mark.parametrize("line", ["S", "L\ta+\tb-\t4M", "P\tp1", "O\tw1", "E\te\ta\t+\tb", "C\ta\t+\tb"])
def test_malformed(spark, line):
    with pytest.raises(Exception, match=f"Malformed {line[0]} record"):
        parsed(spark, line)
    assert parsed(spark, line, mode="DROPMALFORMED") == []
    (row,) = parsed(spark, line, mode="PERMISSIVE")
    assert row.malformed == f"Malformed {line[0]} record"


def test_malformed_is_seen_whatever_is_asked(spark):
    with pytest.raises(Exception, match="Malformed L record"):
        parse_lines(from_lines(spark, ["S\ts1\t*", "L\ta"])).count()


def test_unsupported_lines_warn_once(spark):
    lines = from_lines(spark, ["H\tVN:Z:1.0", "SX\tq", "", "#c", "W\tx", "X\tfoo"])
    assert parse_lines(lines).count() == 0
    with pytest.warns(RuntimeWarning, match="Skipping unsupported record") as found:
        warn_unsupported(lines)
    assert sum("unsupported" in str(w.message) for w in found) == 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        parsed(spark, "S\ta\t*", mode="x")


def test_sources(spark, tmp_path, monkeypatch):
    text = "S\ts1\tACGT\nS\ts2\tTTTT\nL\ts1\t+\ts2\t-\t0M\nP\tp1\ts1+,s2-\t*\r\n"
    plain, packed = tmp_path / "a.gfa", tmp_path / "a.gfa.gz"
    plain.write_bytes(text.encode())
    packed.write_bytes(gzip.compress(text.encode()))
    assert [r.rec_type for r in read_records(spark, str(plain)).orderBy("ord").collect()] == ["S", "S", "L", "P"]
    assert read_records(spark, str(packed)).where("rec_type = 'P'").count() == 1
    assert read_lines(spark, str(plain)).where(F.col("value").endswith("\r")).count() == 1
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    assert read_records(spark, "-").count() == 4
    assert from_lines(spark, io.BytesIO(text.encode())).count() == 4


def test_order_over_many_splits(spark, tmp_path):
    (tmp_path / "a.gfa").write_text("".join(f"S\ts{i}\t{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_records(spark, str(tmp_path / "a.gfa"), warn=False)
        assert rows.rdd.getNumPartitions() > 3
        assert [r.id for r in rows.orderBy("ord").select("id").collect()] == [f"s{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_left_out_by_the_caller_raise_nothing(spark, tmp_path):
    rows = [("O", "w1", "s1+"), ("O", None, None), ("O", "w2", None), ("P", "p1", "s1+")]
    spark.createDataFrame(rows, "k string, name string, steps string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).where("name is not null and length(steps) > 0")
    lines = table.select(F.concat_ws("\t", "k", "name", "steps").alias("value"), F.col("name").alias("ord"))
    assert sorted(r.name for r in parse_lines(lines).where("rec_type in ('O', 'P')").collect()) == ["p1", "w1"]


def test_a_long_stream_is_read_in_parts(spark):
    lines = (f"S\ts{i}\t*\r\n".encode() for i in range(25))
    got = from_lines(spark, lines, part=10).orderBy("ord").collect()
    assert [r.value for r in got] == [f"S\ts{i}\t*\r" for i in range(25)] and [r.ord for r in got] == list(range(25))
    assert from_lines(spark, [], part=10).count() == 0
