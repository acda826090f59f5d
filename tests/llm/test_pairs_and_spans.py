"""Set similarity and shared spans against brute force."""

import itertools
import random

import numpy as np
import pytest

from braidlake.llm import setjoin as J
from braidlake.llm import spans as S


def brute_pairs(sets, threshold):
    one = {}
    for r, s in sets:
        items = frozenset(x for x in s or () if x is not None)
        if items:
            one[r] = items
    return sorted((a, b) for (a, x), (b, y) in itertools.combinations(sorted(one.items()), 2) if len(x & y) / len(x | y) >= threshold)


def frame(spark, sets):
    return spark.createDataFrame(sets, "rec_id bigint, items array<string>").repartition(3)


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


def some_sets(seed, n, common):
    """Families of variants, each set also with items that most sets have."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [f"x{rng.randrange(4000)}" for _ in range(rng.randrange(2, 14))]
        for _ in range(rng.randrange(1, 5)):
            s = set(base) | set(rng.sample(common, rng.randrange(len(common) + 1)))
            if rng.random() < 0.5:
                s.discard(rng.choice(base))
            if rng.random() < 0.5:
                s.add(f"y{rng.randrange(100)}")
            out.append((len(out), list(s)))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.7, 0.5])
def test_pairs(spark, threshold):
    sets = some_sets(1, 90, ["a", "b", "c", "d"])
    sets += [(5000 + i, ["a", "b", "c"]) for i in range(50)] + [(6000, None), (6001, []), (6002, [None]), (6003, ["a", None, "b", "c", "c"])]
    sets += [sets[3], sets[3], sets[-1]]
    assert found(J.similar_records(frame(spark, sets), threshold)) == brute_pairs(sets, threshold)


def test_pairs_when_a_third_is_alike(spark):
    # near copies that all share buckets, so they go through the prefix filter and the salted parts
    rng = random.Random(4)
    sets = [(i, [f"h{k}" for k in range(20)] + [f"v{rng.randrange(200)}" for _ in range(rng.randrange(4))]) for i in range(150)] + some_sets(2, 60, ["a", "b"])[:300]
    sets = [(i, s) for i, (_, s) in enumerate(sets)]
    assert found(J.similar_records(frame(spark, sets), 0.8)) == brute_pairs(sets, 0.8)


def test_ties_on_the_threshold(spark):
    sets = [(1, list("abcde")), (2, list("abcd")), (3, list("abcdefghij")), (4, list("abcdefg"))]
    assert found(J.similar_records(frame(spark, sets), 0.8)) == [(1, 2)]
    assert found(J.similar_records(frame(spark, sets), 0.7)) == brute_pairs(sets, 0.7)
    assert (3, 4) in brute_pairs(sets, 0.7)


def test_no_records_and_other_columns(spark):
    assert found(J.similar_records(frame(spark, []), 0.8)) == []
    assert found(J.similar_records(frame(spark, [(1, None)]), 0.8)) == []
    df = spark.createDataFrame([(1, ["a"], "x", 0), (2, ["a"], "y", 0)], "rec_id bigint, items array<string>, class string, n int")
    assert found(J.similar_records(df, 0.8)) == [(1, 2)]


def test_a_very_large_set(spark):
    big = [f"i{k}" for k in range(30_000)]
    assert found(J.similar_records(frame(spark, [(1, big), (2, big[3000:]), (3, big[9000:])]), 0.8)) == [(1, 2)]


def test_prefix_mask():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 20))) for _ in range(200)]
    flat, lengths, common = np.concatenate(sets), np.array([len(s) for s in sets]), np.array([7, 3, 11])
    items, keep = J.prefix_mask(flat, lengths, common, 0.7)
    prefixes = [set(x) for x in np.split(items, np.cumsum(keep)[:-1])]
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = set(sets[i]), set(sets[j])
        if len(a & b) / len(a | b) >= 0.7:
            assert prefixes[i] & prefixes[j]
    # common items come only where there are no others left
    assert all(not p & {7, 3, 11} or len(set(s) - {7, 3, 11}) < k for p, s, k in zip(prefixes, sets, keep, strict=True))
    assert J.prefix_mask(flat, lengths, np.array([], dtype=np.int64), 0.7)[1].tolist() == keep.tolist()


def brute_spans(records, least):
    grams = {}
    for r, s in dict(records).items():
        for i in range(len(s or ()) - least + 1):
            grams.setdefault(tuple(s[i : i + least]), set()).add(r)
    out = []
    for r, s in dict(records).items():
        shared = set()
        for i in range(len(s or ()) - least + 1):
            if len(grams[tuple(s[i : i + least])]) > 1:
                shared |= set(range(i, i + least))
        runs = []
        for p in sorted(shared):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out += [(r, a, b) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("least", [3, 12])
def test_spans(spark, least):
    rng = random.Random(least)
    pool = [f"s{i}" for i in range(400)]
    records = []
    for i in range(120):
        steps = []
        for _ in range(rng.randrange(5)):
            at = rng.randrange(380)
            steps += pool[at : at + rng.randrange(1, 20)]
            steps += [f"n{rng.randrange(50)}"] * rng.randrange(3)
        records.append((i, steps))
    records += [(500, None), (501, []), (502, ["q"] * 40), (503, pool[:least]), (504, pool[: least - 1])]
    # two runs that touch, from different sources
    records += [(600, [f"a{k}" for k in range(least)] + [f"b{k}" for k in range(least)]), (601, [f"a{k}" for k in range(least)]), (602, [f"b{k}" for k in range(least)])]
    rows = records + [records[5], records[600 - 600 + 7], records[-1]]
    df = spark.createDataFrame(rows, "record bigint, steps array<string>").repartition(4)
    got = [tuple(r) for r in S.shared_spans(df, least).select("record", "start_pos", "end_pos").collect()]
    assert sorted(got) == brute_spans(records, least)
    assert (600, 0, 2 * least - 1) in got
    amounts = {r.record: (r.n_steps, r.n_shared) for r in S.shared_amounts(df, least).collect()}
    assert amounts == {r: (len(s or ()), sum(b - a + 1 for x, a, b in got if x == r)) for r, s in records}


@pytest.mark.parametrize("least_heavy", [100_000, 0])
def test_spans_of_many_copies(spark, monkeypatch, least_heavy):
    monkeypatch.setattr(S, "LEAST_HEAVY", least_heavy)
    steps = [f"s{i}" for i in range(30)]
    df = spark.createDataFrame([(i, steps) for i in range(200)], "record bigint, steps array<string>").repartition(4)
    assert {tuple(r)[1:] for r in S.shared_spans(df).collect()} == {(0, 29)} and S.shared_spans(df).count() == 200


def test_factors_name_a_real_place(spark):
    records = {1: [f"a{k}" for k in range(20)], 2: ["x"] + [f"a{k}" for k in range(20)], 3: [f"a{k}" for k in range(5, 20)]}
    df = spark.createDataFrame(list(records.items()), "record bigint, steps array<string>")
    rows = S.factors(S.located(df)).collect()
    assert rows
    for r in rows:
        n = r.end_pos - r.start_pos + 1
        assert r.source != r.record and records[r.record][r.start_pos : r.end_pos + 1] == records[r.source][r.source_pos : r.source_pos + n]


def test_no_spans_in_no_records(spark):
    df = spark.createDataFrame([], "record bigint, steps array<string>")
    assert S.shared_spans(df).count() == 0 and S.shared_amounts(df).count() == 0
