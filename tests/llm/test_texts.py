"""Reading of markup, leaked items, packing and reading levels."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidlake.llm import leaks, packing, reading
from braidlake.llm.typeset import plain_words, words

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""), ("", ""), ("Plain Words, 12!", "plain words 12"), ("a \\emph{b,} {\\it c} \\textbf{d}{}", "a b c d"), ("the bupl{ae}nd", "the buplaend"), ("tr\\-alaer", "tralaer"), ("enzy-\n   me well-known", "enzyme well known"),
        ("enzy- \r\n  % me", "enzyme"), ("a~\\cite{x3} b\\citep[see][2]{k,l} c", "a b c"), ("a \\label{x5} b\\index{q!r} c", "a b c"), ("gra\\index{q2}ms", "grams"), ("a\\\\b\\par c\\ d", "a b c d"), ("%% a\n  % b\nc", "a b c"),
        ("50\\% of\n%\nit", "50 of it"), ("foo%\n  bar", "foobar"), ("\\footnote{a note} \\todo{do} \\caption{c}", "a note do c"), ("\\newcommand{\\abc}{one two}x \\abc{} y", "x one two y"), ("\\def\\abc{z}\\abc{} \\abc", "z z"),
        ("\\newcommand{\\v}[1]{\\mathbf{#1}w}a \\v{k} \\v b", "a kw bw"), ("\\newcommand\\o[2][d]{#1 #2}\\o{x} \\o[y]{z}", "d x y z"), ("\\newcommand{\\r}{\\r a}\\r", "a"), ("\\newcommand{\\a}{b}\\ab", ""), ("\\iffalse draft\\fi end", "draft end"),
        ("\\begin{abstract}x\\end{abstract}", "x"), ("the ﬁlter", "the filter"), ("\\section*{A b}\\label{s}\nc", "a b c"), ("``a'' -- b", "a b"), ("\\newcommand{\\x}{unclosed", ""), ("{{{", ""), ("\\", ""), ("a{b", "ab"), ("\\frac{1}{2}", "1 2"), ("caf\u00e9 x", "caf x"),
    ],
)
def test_words(text, want):
    assert " ".join(words(text)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\{}%[]#-\n ab1$~newcommandef", max_size=80))
def test_any_text_can_be_read(text):
    assert all(w.isascii() for w in words(text))


ITEMS = [(1, "In the zeist dialect, 168 vowels merge before kusa nasals, leaving 499 contrasts in glaer stems."), (2, "A krod lattice of 318 cells is joined to the gor frame at angle 663, and the stu gauge reads 958 units."), (3, "too short to show"), (4, ITEM4 := "one two three four five six seven eight nine ten eleven twelve"), (4, ITEM4), (5, ""), (6, None)]


def brute_leaks(docs, items, least=12):
    out = set()
    for d, text in docs:
        w = words(text)
        runs = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for i, t in items:
            v = plain_words(t)
            if any(tuple(v[k : k + least]) in runs for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def made_docs(seed=1):
    rng = random.Random(seed)
    pool = sorted({w for _, t in ITEMS for w in plain_words(t)}) + ["other", "words", "here"]
    docs = [(0, None), (1, ""), (2, "nothing"), (3, " ".join(pool * 50))]
    for d in range(4, 250):
        parts = []
        for _ in range(rng.randrange(4)):
            w = plain_words(rng.choice(ITEMS)[1])
            a = rng.randrange(6)
            parts.append(" ".join(w[a : a + rng.choice([11, 12, 13, 30])]))
            parts.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(30))))
        docs.append((d, "\n".join(parts)))
    return [*docs, docs[10], (4, docs[11][1])]


@pytest.mark.parametrize("index_words", [2_000_000, 20])
def test_leaks(spark, index_words):
    docs = made_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = leaks.leaked(df, items, index_words=index_words).collect()
    want = brute_leaks(docs, ITEMS)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 20
    assert all(r.n_runs > 0 for r in rows)


def test_leaks_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leaks.leaked(docs, items).count() == 0
    assert leaks.leaked(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), items.where("false")).count() == 0


def test_index_over_the_test_tables():
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/eval_items.parquet'").fetchall()
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    index = leaks.ItemIndex([(i, plain_words(t)) for i, t in items])
    got = {(d, i) for d, t in docs for i in index.search(words(t))}
    assert got == brute_leaks(docs, items) and len(got) > 20


def test_blocks_prune_without_loss():
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/eval_items.parquet'").fetchall()
    index = leaks.ItemIndex([(i, plain_words(t)) for i, t in items])
    for _, t in items[:60]:
        passage = np.array([index.number[w] for w in plain_words(t)[:40]])
        scores = {}
        for w in set(passage.tolist()):
            for k in range(index.start[w], index.start[w + 1]):
                scores[int(index.item[k])] = scores.get(int(index.item[k]), 0) + index.impact[k]
        assert set(index.scored(passage).tolist()) == {i for i, s in scores.items() if s >= index.threshold[i]}


def test_answers(spark):
    items = spark.createDataFrame([(1, ITEMS[0][1], "499 contrasts"), (2, ITEMS[1][1], "none of these"), (4, ITEM4, None)], "item_id bigint, text string, answer string")
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1] + " None of\n these."), (3, ITEMS[1][1] + " one of these"), (4, ITEM4)], "doc_id bigint, text string")
    found = leaks.leaked(docs, items)
    assert {(r.doc_id, r.item_id): r.answer_shown for r in found.collect()} == {(1, 1): True, (2, 2): True, (3, 2): False, (4, 4): None}
    assert {r.item_id: (r.n_documents, r.n_with_answer) for r in leaks.leaked_items(found).collect()} == {1: (1, 1), 2: (2, 1), 4: (1, 0)}


def test_an_index_of_many_items_is_small():
    import pickle

    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(30_000)]
    items = [(i, [vocabulary[k] for k in rng.integers(0, 30_000, 40)]) for i in range(50_000)]
    index = pickle.loads(sent := pickle.dumps(leaks.ItemIndex(items)))
    assert len(sent) < 100_000_000 and index.at[-1] == 2_000_000
    for i, w in items[::5000]:
        assert index.search(["zz", *w[3:20], "zz"]) == {i: (6, None)} and index.search(w[:11]) == {}


def test_macros_in_macros(spark):
    deep = "".join(f"\\newcommand{{\\m{'x' * i}}}{{\\m{'x' * (i + 1)} }}" for i in range(40)) + f"\\newcommand{{\\m{'x' * 40}}}{{end}}"
    assert words(deep + "\\m{} here") == ["end", "here"]
    doubling = "".join(f"\\def\\d{chr(97 + i)}{{\\d{chr(98 + i)}\\d{chr(98 + i)} a }}" for i in range(25))
    assert len(words(doubling + "\\da")) < 2_000_000
    assert words("\\newcommand{\\x}{open words\nmore\n\nafter \\x") == ["after", "open", "words", "more"]


# --- packing ------------------------------------------------------------------------------------------------------


def check_packing(items, rows, capacity, segments, loss_capacity):
    used, places = {}, {}
    for r in rows:
        if r.container is not None:
            used.setdefault(r.container, []).append(r)
        places.setdefault((r.item_id, r.copy), []).append(r)
    for rs in used.values():
        rs.sort(key=lambda r: r.place)
        assert [r.place for r in rs] == list(range(len(rs))) and len(rs) <= segments
        assert [r.start for r in rs] == [sum(x.tokens for x in rs[:i]) for i in range(len(rs))] and sum(r.tokens for r in rs) <= capacity
    whole = {}
    for (item, _), rs in places.items():
        assert sorted(r.piece for r in rs) == list(range(len(rs)))
        whole.setdefault(item, []).append(sum(r.tokens for r in rs))
    want = {}
    for i, n, *_ in items:
        want.setdefault(i, []).append(n or 0)
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}
    return used


def test_packing(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([rng.randrange(1, 300), rng.randrange(1, 2048), rng.randrange(1, 9000)])) for i in range(3000)] + [(5000, 2048), (5001, 4096), (5002, 0), (5003, None), (7, 10), (5000, 2048)]
    rows = packing.packed(spark.createDataFrame(items, "item_id bigint, tokens bigint").repartition(3)).collect()
    used = check_packing(items, rows, 2048, 256, 2048)
    assert len(used) <= 1.01 * -(-sum(n or 0 for _, n in items) // 2048)
    split = {r.item_id for r in rows if r.piece}
    assert split == {i for i, n in items if n and n > 2048}
    assert all(r.container is None and r.place is None for r in rows if r.tokens == 0)


def test_packing_under_all_limits(spark):
    rng = random.Random(2)
    items = [(i, n := rng.randrange(1, 100), rng.randrange(0, n + 1)) for i in range(500)] + [(900, 400, 400), (901, 5, 9)]
    rows = packing.packed(spark.createDataFrame(items, "item_id bigint, tokens bigint, loss_tokens bigint"), 500, 6, 150).collect()
    used = check_packing(items, rows, 500, 6, 150)
    loss = {i: min(l, n) for i, n, l in items}
    whole = {i for i in loss if loss[i] <= 150}
    assert all(sum(loss[r.item_id] for r in rs if r.item_id in whole) <= 150 for rs in used.values())
    # an item is split by its tokens alone; one with too much loss stands alone
    assert all(r.piece == 0 for r in rows) and [len(rs) for rs in used.values() if any(r.item_id == 900 for r in rs)] == [1]


def test_packing_of_many_copies(spark):
    df = spark.range(25_000).selectExpr("1L as item_id", "700L as tokens")
    rows = packing.packed(df).toPandas()
    assert len(rows) == 25_000 and sorted(rows["copy"]) == list(range(1, 25_001)) and rows.container.nunique() <= 12_502


def test_packing_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, tokens bigint")
    assert packing.packed(none).count() == 0
    assert packing.packed(spark.createDataFrame([(1, 0)], "item_id bigint, tokens bigint")).collect()[0].container is None


def test_full_pieces_have_containers_of_their_own(spark):
    rows = packing.packed(spark.range(5000).selectExpr("id as item_id", "cast(2048 * (1 + id % 2) as bigint) as tokens").repartition(7)).collect()
    full = [r.container for r in rows]
    assert len(full) == 7500 == len(set(full)) and all(r.place == 0 and r.tokens == 2048 for r in rows)


def test_loss_tokens(spark):
    docs = spark.createDataFrame([(1, "Prompt words here\n\\section{A}\nThe body follows."), (2, "First paragraph.\n\nSecond one."), (3, "only one"), (4, None), (5, "")], "doc_id bigint, text string")
    got = {r.item_id: (r.tokens, r.loss_tokens) for r in packing.token_counts(docs).collect()}
    assert 0 < got[1][1] < got[1][0] and 0 < got[2][1] < got[2][0] and got[3][0] == got[3][1] > 0 and got[4] == got[5] == (0, 0)


def test_loss_beyond_the_limit_is_not_split(spark):
    rows = packing.packed(spark.createDataFrame([(1, 400, 400), (2, 50, 50)], "item_id bigint, tokens bigint, loss_tokens bigint"), 500, 6, 150).collect()
    assert len(rows) == 2 and len({r.container for r in rows}) == 2


def test_audit(spark):
    (row,) = packing.audited(packing.packed(packing.token_counts(spark.read.parquet(f"{FOLDER}/documents.parquet")))).collect()
    assert (row.over_tokens, row.over_segments, row.over_loss, row.broken_places, row.broken_pieces) == (0, 0, 0, 0, 0)


def test_fill_takes_what_fits_best():
    container, place = packing.fill(np.array([[6, 1], [5, 1], [4, 1], [5, 1]]), np.array([10, 9]))
    assert container.tolist() == [0, 1, 0, 1] and place.tolist() == [0, 0, 1, 1]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> é\n" * 3)], "doc_id bigint, text string")
    got = {r.item_id: r.tokens for r in packing.token_counts(df).collect()}
    encode = packing._encoder(open(packing.TOKENIZER, "rb").read())
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(encode("<|endoftext|> é\n" * 3)) > 6


# --- reading levels -----------------------------------------------------------------------------------------------


def test_levels_on_held_out_grades(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/level_labels.parquet")
    x, y, w = reading.graded_features(reading.document_features(reading.read_words(docs)), labels)
    folds = np.array([hash(r.tobytes()) % 3 for r in x])
    errors, baseline = [], []
    for k in range(3):
        model = reading.OrdinalModel().fit(x[folds != k], y[folds != k], w[folds != k])
        errors += list(np.abs(model.expected(x[folds == k]) - y[folds == k]))
        baseline += list(np.abs(np.median(y[folds != k]) - y[folds == k]))
    assert np.mean(errors) < 0.5 and np.mean(errors) < 0.5 * np.mean(baseline)


def test_levels_of_every_document(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/level_labels.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\\R{} 12 %"), (-4, "Short words are in here. " * 20000)], "doc_id bigint, text string")
    rows = reading.reading_levels(docs.select("doc_id", "text").unionByName(extra), labels).collect()
    assert len(rows) == docs.count() + 4
    got = {r.doc_id: r.level for r in rows}
    assert got[-1] is None and got[-2] is None and 1 <= got[-4] <= 5
    assert all(x is None or 1 <= x <= 5 for x in got.values())


def test_grades(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", 3, t), (1, "a", 3, t), (1, "b", 5, t), (1, "b", 2, t + dt.timedelta(days=1)), (1, "c", 9, t), (2, "a", None, t), (3, "a", 0, t), (None, "a", 3, t), (4, None, 4, t), (5, "a", 1, t), (5, "a", 2, t)]
    df = spark.createDataFrame(rows, "doc_id bigint, rater string, grade int, graded_at timestamp_ntz")
    assert sorted(map(tuple, reading.grades(df).collect())) == [(1, 2, 0.5), (1, 3, 0.5), (4, 4, 1.0), (5, 2, 1.0)]
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="no valid grade"):
        reading.reading_levels(docs, df.where("doc_id = 2"))


def test_ordinal_model_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = 1 + (x[:, :1] * 2 - x[:, 1:2] + rng.logistic(size=(4000, 1)) > np.array([-3, -1, 1, 3])).sum(axis=1)
    model = reading.OrdinalModel().fit(x, y, np.ones(len(y)))
    assert np.allclose(model.b / model.scale, [2, -1, 0], atol=0.25) and np.allclose(np.diff(model.t), 2, atol=0.3)


def test_document_counts_cover_all(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "alpha") for i in range(100)] + [(200, None), (201, "")], "doc_id bigint, text string").repartition(5)
    read = reading.read_words(docs)
    counts, n = reading.document_counts(read)
    assert n == 100 and dict(counts) == {reading.word_hash("alpha"): 100, reading.word_hash("beta"): 50}


def test_words_beyond_any_table(spark):
    # each document brings words of its own; what the common ones count isn't touched by how many others there are
    docs = spark.createDataFrame([(i, f"alpha beta {' '.join(f'q{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}' for k in range(300))}") for i in range(600)], "doc_id bigint, text string")
    counts, n = reading.document_counts(reading.read_words(docs))
    assert n == 600 and {k: v for k, v in counts.items() if v > 1} == {reading.word_hash("alpha"): 600, reading.word_hash("beta"): 600}


def test_connectives_and_clauses():
    one = reading.text_features("In spite of rain, we left because it rained. As a result we came late.")
    assert one.base[reading.BASE.index("connectives")] == pytest.approx(3 / 15) and one.base[reading.BASE.index("clause_depth")] > 0
    flat = reading.text_features("We saw a, b, c, (d), e; f: g. It was so.")
    assert flat.base[reading.BASE.index("clause_depth")] == 0
    assert reading.text_features("We know that he said that she thought that it rained.").base[reading.BASE.index("clause_depth")] == pytest.approx(3)
