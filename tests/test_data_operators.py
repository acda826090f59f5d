"""Skewed keys, failing rows and orphan references against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidlake.functions.ids import segment_id, step_key
from braidlake.operators import orphans, skew
from braidlake.operators.orphans import first_delivery_only, merged_periods, orphan_counts, orphan_references, presence
from braidlake.operators.skew import count_distinct_pairs, frequent_candidates, heavy_keys, per_key, skewed_join
from braidlake.plans import data_queries
from braidlake.session import fair_share
from braidlake.sources import rejects as R


# --- ids ----------------------------------------------------------------------------------------------------------


def test_ids(spark):
    raw = ["s1", " s1 ", "s1\r", "s1+", "s1-+ ", " s1 ", "S1", "", " ", "+", None, "s+1"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    assert [r[0] for r in df.select(segment_id(F.col("x"))).collect()] == ["s1"] * 6 + ["S1", "", "", "", None, "s+1"]


def test_steps(spark):
    rows = [("s1", "-"), ("s1-", None), ("s1 ", None), ("s1-", "+"), ("s1+\r", None), (None, None)]
    df = spark.createDataFrame([(rows,)], "s array<struct<seg:string,orient:string>>")
    assert df.select(F.transform("s", step_key)).collect()[0][0] == ["s1\t-", "s1\t-", "s1\t+", "s1\t+", "s1\t+", "\t+"]


# --- skew ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    keys = ["hot"] * 3000 + ["warm"] * 300 + [f"k{rng.randrange(2000)}" for _ in range(5600)] + [None] * 100
    rng.shuffle(keys)
    return keys, spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v bigint").repartition(7).cache()


def test_heavy_keys_are_exact(skewed):
    keys, df = skewed
    for share in (0.3, 1 / 3, 0.02, 0.01):
        want = {k: n for k, n in Counter(keys).items() if k is not None and n >= share * len(keys)}
        assert {r.k: r.n_rows for r in heavy_keys(df, "k", share).collect()} == want
    assert heavy_keys(df.where("false"), "k", 0.02).count() == 0
    assert heavy_keys(df.where("k is null"), "k", 0.02).count() == 0
    assert frequent_candidates(df.where("false"), "k", 0.02) == []


def test_threshold_counts(spark):
    df = spark.createDataFrame([("a",)] * 2 + [(f"b{i}",) for i in range(98)], "k string")
    assert [r.k for r in heavy_keys(df, "k", 0.02).collect()] == ["a"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_skewed_join(spark, skewed, how, limit):
    _, df = skewed
    small = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("k1", "z"), ("warm", None), (None, "n")], "k string, w string")
    got = skewed_join(df, small, ["k"], how, broadcast_rows=limit)
    want = df.join(small, ["k"], how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_skewed_join_on_empty_tables(spark, skewed):
    _, df = skewed
    small = spark.createDataFrame([], "k string, w string")
    assert skewed_join(df, small, ["k"]).count() == 0 and skewed_join(df.where("false"), small, ["k"], "left").count() == 0


def test_count_distinct_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", None), (None, "z")], "k string, v string")
    assert sorted(map(tuple, count_distinct_pairs(df, "k", "v", "n", "d").collect()), key=repr) == [("a", 3, 2), ("b", 1, 0), (None, 1, 1)]


@pytest.mark.parametrize("most_values", [256, 0])
def test_per_key(spark, skewed, monkeypatch, most_values):
    monkeypatch.setattr(skew, "MOST_VALUES", most_values)
    keys, df = skewed
    df = df.withColumn("u", F.col("v") % 7)
    side = spark.createDataFrame([("hot", 1), ("k1", 2), ("absent", 3)], "k string, length int")
    got = {r.k: (r.n, r.d, r.length) for r in per_key(df, side, "k", "u", "n", "d").collect()}
    of = {}
    for i, k in enumerate(keys):
        of.setdefault(k, []).append(i % 7)
    of.pop(None)
    assert got == {k: (len(x), len(set(x)), {"hot": 1, "k1": 2}.get(k)) for k, x in of.items()}
    assert per_key(df.where("false"), side, "k", "u", "n", "d").count() == 0


def test_heavy_keys_meet_a_union(spark):
    # the plan of the problem's own query: a broadcast join for the heavy keys beside the shuffled one
    plan = data_queries.p2_neighbours(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan and "bb00" in plan


def test_fair_share(spark):
    assert fair_share(spark) == 0.01 and fair_share(spark, most=0.5) >= 1 / 64 and fair_share(spark, least=0.02, most=0.02) == 0.02


# --- failing rows -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["*", "0M", "12M3I4X5=", "1M2I3D4N5S6H7P8X9="])
def test_cigars(text):
    assert R.cigar_error(text) is None


@pytest.mark.parametrize("text", ["", "M", "12", "12M ", " 12M", "12m", "**", "-1M", "1.5M", "８M", "12M\n", "*M", "null"])
def test_broken_cigars(text):
    assert R.cigar_error(text)


@pytest.mark.parametrize("text", ["XA:A:a", "XA:A::", "LN:i:-5", "DP:f:.5", "DP:f:1.5e-3", "DP:f:5", "CO:Z:a b:c", "SH:H:0A1F", "ZB:B:i,1,2", "ZB:B:f,1.5,-2e3", "JT:J:[1, 2]", 'JT:J:{"a": "\\u00e9"}', "a1:Z:x", "JT:J:null\tXA:A:b"])
def test_tags(text):
    assert R.tags_error(text) is None


@pytest.mark.parametrize(
    "text",
    ["", "XA", "XA:A", "XA:A:ab", "XA:A: ", "XA:A:é", "1A:i:5", "X:i:5", "XAB:i:5", "LN:i:", "LN:i:5.0", "LN:i:٣", "DP:f:1.", "DP:f:inf", "DP:f:1e", "DP:f:772,5", "CO:Z:", "CO:Z:a\x07", "CO:Z:é", "SH:H:0a", "SH:H:ABC", "SH:H:", "ZB:B:i", "ZB:B:x,1", "ZB:B:i;1", "ZB:B:i,", "JT:J:[1,]", "JT:J:{'a': 1}", "JT:J:NaN", "JT:J:", "LN:q:5", "LN:I:5", "LN:i:5\t", "LN:i:5\r"],
)
def test_broken_tags(text):
    assert R.tags_error(text)


GOOD = [
    "S\ts1\tACGT", "S\ts1\t*", "S\ts1\t4", "S\ts1\t4\tacgt", "S\ts1\t4\tACGT\tLN:i:4", "S\ts1\tACGT\t\t", "S\ts1\tACGT\r", '"S"x', "X\tanything", "#", "", "H\tVN", 'S\t"s 1"\tACGT', 'S\ts1\tACGT\t"CO:Z:a ""b"" c"',
    "L\ta\t+\tb\t-\t*", "L\ta\t+\tb\t-\t5M\tRC:i:1", "L\ta b\t+\tb\t-\t5M", "E\t*\ta+\t0\t5\tb-\t1$\t1\t5M", "E\te\ta+\t5\t10$\tb-\t00\t0$\t*", "P\tp\ta+,b-\t*", "P\tp\ta+\t5M,*", "O\tw\ta+,b-", "O\tw\ta+\tRC:i:5", 'O\t"w\t1"\ta+', "C\ta", "W\tx",
]
BAD = [
    "S", "S\ts1", "S\t\tACGT", "SX\ts1\tACGT", "S \ts1\tACGT", "S\ts1\tAC1", "S\ts1\t", "S\ts1\t-4", "S\ts1\t4\t\tLN:i:4", "S\ts1\t4\tLN:i:4", "S\ts1\tACGT\tLN:i:x", "S\ts1\tACGT\t\tLN:i:4", "S\ts1\tACGT\r\r", 'S\t"s1\tACGT', 'S\t"s1"x\tACGT', 'S\ts1\tACGT\t"CO:Z:a "b""',
    "L\ta\t+\tb\t-", "L\ta\t+\tb\t-\t", "L\t\t+\tb\t-\t*", "L\ta\t+\t\t-\t*", "L\ta\t++\tb\t-\t*", "L\ta\t\tb\t-\t*", "L,a,+,b,-,*", "E\t\ta+\t0\t5\tb-\t1\t1\t5M", "E\t*\ta\t0\t5\tb-\t1\t1\t5M", "E\t*\t+\t0\t5\tb-\t1\t1\t5M", "E\t*\ta+\t6\t5\tb-\t1\t1\t5M", "E\t*\ta+\t0\t5$$\tb-\t1\t1\t5M", "E\t*\ta+\t0\t5\tb-\t1\t1\tx",
    "P\tp\ta+,b\t*", "P\tp\ta+;b-\t*", "P\tp\ta+, b-\t*", "P\tp\ta+,b-", "P\tp\ta+\t5M,,*", "P\t\ta+\t*", "O\tw\t", "O\tw\ta+,", "O\tw\ta+ b+", "O\tw",
]


@pytest.mark.parametrize("line", GOOD)
def test_lines(line):
    assert R.line_error(line) is None


@pytest.mark.parametrize("line", BAD)
def test_broken_lines(line):
    assert R.line_error(line)


def test_bulk_agrees_with_strict():
    rng = random.Random(3)
    lines = [x for x in GOOD + BAD] * 40 + ["L\ta\t+\tb\t-\t*"] * 6000 + [None, "a\nb", "S\ts1\tAC\nGT", "X\n"]
    rng.shuffle(lines)
    got = R.reasons(lines, "line")
    assert got == [R.line_error(x) for x in lines]
    assert R.reasons([], "line") == [] and R.reasons([None], "cigar") == [None]


def test_bulk_agrees_on_mutated_lines():
    rng = random.Random(11)
    letters = "\t\"+-*,:;$ \r019AMZiS.e{}[]"
    lines = []
    for line in GOOD + BAD:
        for _ in range(60):
            x = list(line)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(x) + 1)
                if rng.random() < 0.5:
                    x.insert(i, rng.choice(letters))
                elif i < len(x):
                    del x[i]
            lines.append("".join(x))
    assert R.reasons(lines, "line") == [R.line_error(x) for x in lines]
    tags = [x.split("\t", 3)[-1] for x in lines]
    assert R.reasons(tags, "tags") == [R.tags_error(x) for x in tags]
    assert R.reasons(tags, "cigar") == [R.cigar_error(x) for x in tags]


def test_numbers_of_any_length():
    n = "9" * 6000
    lines = [f"E\t*\ta+\t{n}\t1{n}\tb-\t0\t{n}\t*", f"E\t*\ta+\t1{n}\t{n}\tb-\t0\t1\t*", f"S\ta\t{n}\tA\tJT:J:[{n}]\tLN:i:{n}"]
    assert [x is None for x in R.reasons(lines, "line")] == [True, False, True] == [R.line_error(x) is None for x in lines]


def test_load_checked(spark):
    rows = [(1, "5M", "x"), (2, "5", "y"), (2, "5", "y"), (3, None, "z"), (4, "", None)]
    df = spark.createDataFrame(rows, "rec_id bigint, overlap string, value string")
    valid, broken = R.load_checked(df, "overlap", "cigar")
    assert valid.columns == df.columns and sorted(r.rec_id for r in valid.collect()) == [1, 3]
    assert sorted((r.rec_id, r.reason is not None) for r in broken.collect()) == [(2, True), (2, True), (4, True)]
    assert sorted(r.rec_id for r in R.failing(df, "t", "overlap", "cigar").collect()) == [2, 4]
    assert R.failing(df.where("false"), "t", "overlap", "cigar").count() == 0
    valid, broken = R.load_checked(df.withColumn("reason", F.lit(1)), "overlap", "cigar")
    assert valid.columns == [*df.columns, "reason"] and broken.columns == [*df.columns, "reason", "_reason"] and broken.count() == 3


def test_load_lines(spark):
    lines = ['S\t"s\t1"\tACGT\t"CO:Z:a ""b"""', "S\ts2\t4\t\t", "S\ts3\t4\r", "E\t*\ta+\t0\t5\tb-\t1$\t2$\t5M", "L\ta\t+\tb\t-\tx", None, "#", "C\ta", "P\tp\ta+\t*\tRC:i:1"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, ord int")
    records, broken = R.load_lines(df)
    a, b, c, d, e = records.orderBy("ord").collect()
    assert (a.id, a.sequence, a.tags["CO"].s) == ("s\t1", "ACGT", 'a "b"')
    assert (b.length, b.sequence, c.length) == (4, None, 4)
    assert (d.src, d.dst, d.orientation_to, d.to_start, d.to_end) == ("a", "b", "-", 1, 2)
    assert e.name == "p" and e.tags["RC"].i == 1
    assert [(r.ord, r.reason) for r in broken.collect()] == [(4, "cigar not of number-operation pairs")]


# --- orphans ------------------------------------------------------------------------------------------------------


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(refs, rows):
    out = []
    for table, rec, key, t in refs:
        if key and not any(k == key and a is not None and t is not None and a <= t and (b is None or b > t) for k, a, b in rows):
            out.append((table, rec, key))
    return sorted(out)


@pytest.mark.parametrize(("share", "most_keys", "fits"), [(0.005, 500_000, True), (0.9, 500_000, True), (0.005, 0, True), (0.005, 0, False)])
def test_orphans(spark, monkeypatch, share, most_keys, fits):
    monkeypatch.setattr(orphans, "MOST_KEYS", most_keys)
    if not fits:  # heavy keys with too many periods are met by month
        monkeypatch.setattr(orphans, "fits_broadcast", lambda *_: False)
    rng = random.Random(2)
    keys = [f"k{i}" for i in range(60)]
    pick = lambda: rng.choice(["hot", "hot", *keys, "gone", "", None])
    rows = [(k, rng.randrange(40), rng.choice([None, 60])) for k in [*keys, "hot", "hot", "late", None, ""]] + [("re", 0, 10), ("re", 20, 30), ("re", 5, 12), ("none", 7, 3), ("nil", None, None)]
    refs = [("links", i, pick(), rng.randrange(80)) for i in range(900)] + [("paths", 2000 + i, "re", i) for i in range(40)] + [("paths", 3000 + i, k, 50) for i, k in enumerate(("none", "nil", "late"))]
    segments = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in rows], "seg_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    df = spark.createDataFrame([(t, r, k, day(n)) for t, r, k, n in refs], "table_name string, rec_id bigint, seg_id string, t timestamp_ntz").repartition(5)
    got = orphan_references(df, presence(segments), share)
    want = brute(refs, rows)
    assert sorted((r.table_name, r.rec_id, r.seg_id) for r in got.collect()) == want
    counted = {r.table_name: (r.n_orphans, r.n_records, r.n_keys) for r in orphan_counts(got.withColumn("t", F.lit(day(0)))).collect()}
    for name in ("links", "paths"):
        own = [w for w in want if w[0] == name]
        assert counted[name] == (len(own), len({w[1] for w in own}), len({w[2] for w in own}))


@pytest.mark.parametrize("share", [0.005, 0.9])
def test_orphans_with_clashing_columns(spark, share):
    own = ["kind", "stop", "until", "key", "start", "first", "_kind"]
    refs = spark.createDataFrame([("a", day(1), 1), ("b", day(9), 2)], "seg_id string, t timestamp_ntz, rec_id bigint").withColumns({c: F.lit("x") for c in own})
    periods = presence(spark.createDataFrame([("a", day(0), None)], "seg_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"))
    found = first_delivery_only(orphan_references(refs, periods, share), refs.select("rec_id", "t"))
    assert [r.seg_id for r in found.collect()] == ["b"] and set(found.columns) == set(refs.columns)


def test_skewed_join_with_clashing_columns(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)], "k string, salt int")
    small = spark.createDataFrame([("hot", 7)], "k string, n int")
    got = skewed_join(big, small, ["k"], broadcast_rows=0)
    assert sorted(r.salt for r in got.collect()) == list(range(50)) and got.columns == ["k", "salt", "n"]


def test_orphans_on_empty_tables(spark):
    none = spark.createDataFrame([], "seg_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    refs = spark.createDataFrame([("a", day(1)), ("b", None)], "seg_id string, t timestamp_ntz")
    assert orphan_references(refs, presence(none)).count() == 2
    assert orphan_references(refs.where("false"), presence(none)).count() == 0


def test_merged_periods(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 5, 6), ("a", 8, 9), ("b", 0, 1)], "k string, start int, stop int")
    assert sorted(map(tuple, merged_periods(df, ["k"]).collect())) == [("a", 1, 6), ("a", 8, 9), ("b", 0, 1)]


def test_first_delivery(spark):
    deliveries = spark.createDataFrame([(1, day(1)), (1, day(5)), (2, day(3))], "rec_id bigint, t timestamp_ntz")
    found = spark.createDataFrame([(1, day(5), "x"), (2, day(3), "y")], "rec_id bigint, t timestamp_ntz, seg_id string")
    assert [r.rec_id for r in first_delivery_only(found, deliveries).collect()] == [2]


# --- the registered queries ---------------------------------------------------------------------------------------


def test_rejected_covers_all_tables(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = {(r.table_name, r.rec_id) for r in data_queries.p4_found(spark, folder).collect()}
    want = set()
    for name, (column, kind) in data_queries.CHECKED.items():
        strict = {"tags": R.tags_error, "cigar": R.cigar_error, "line": R.line_error}[kind]
        want |= {(name, rec) for rec, x in duckdb.sql(f"SELECT rec_id, {column} FROM '{folder}/{name}.parquet'").fetchall() if strict(x)}
    assert got == want and len(want) > 10
