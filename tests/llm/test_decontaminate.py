from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clausework.llm import decontaminate as D
from tests.conftest import DATA
from tests.llm.helpers import awkward_texts, clashing, documents


def distance_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80), st.lists(st.integers(0, 4), max_size=90), st.integers(0, 20))
def test_distance(a, b, most):
    want = distance_by_hand(a, b)
    got = D.Pattern(np.array(a)).distance(b, most)
    assert got == want if want[0] <= most else got[0] > most


def test_embedding_of_equal_prefixes_is_equal():
    bits = D.walk_bits(50, 2)
    x = np.random.default_rng(0).integers(1, 48, 40)
    a, b = (D.embed(y, bits[0], 30, 49) for y in (x, np.append(x[:20], x[21:])))
    same = int((a == b).sum())
    assert (a[:20] == b[:20]).all() and same >= 20
    assert (D.embed(x[:2], bits[0], 30, 49)[-3:] == 49).all()


def edited(words, k, rng):
    w = list(words)
    for _ in range(k):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = "zzq"
        elif kind == 1:
            w.insert(at, "zzq")
        else:
            del w[at]
    return w


def test_recall_at_the_most_edits(spark):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.1/benchmark.parquet").collect())
    finder = D.Finder(D.build(items))
    rng, hit, n = random.Random(4), 0, 0
    texts, wanted = [], []
    for i, t in items:
        w = t.split()
        texts.append("Some other words here " + " ".join(edited(w, D.edits_allowed(len(D.words_of(t))), rng)) + " and after it")
        texts.append("Before " + t.upper().replace(" ", "  ") + " after")
        wanted += [i, i]
    got = {(k, i) for k, i, *_ in finder.leaks(texts)}
    n, hit = len(items), sum((2 * k, wanted[2 * k]) in got for k in range(len(items)))
    assert hit >= 0.9 * n
    assert all((2 * k + 1, wanted[2 * k + 1]) in got for k in range(n))  # exact but for case and blanks


def brute_force(items, text):
    """Items that some window of text is within the allowed edits of."""
    words, found = D.words_of(text), set()
    for i, t in items:
        w = D.words_of(t)
        if w and any(distance_by_hand(w, words[s : s + len(w) + D.edits_allowed(len(w))])[0] <= D.edits_allowed(len(w)) for s in range(len(words))):
            found.add(i)
    return found


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 20)))) for i in range(12)]
    texts = []
    for k in range(60):
        w = [rng.choice(vocabulary) for _ in range(40)]
        if k % 2:
            w[10:10] = edited(items[k % 12][1].split(), k % 3, rng)
        texts.append(" ".join(w))
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    want = {(k, i) for k, t in enumerate(texts) for i in brute_force(items, t)}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 30


def test_query_finds_every_exact_copy_and_nothing_else(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    got = D.op3_decontaminate(spark, f"{DATA}/sf0.01").collect()
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in got}
    texts = dict(docs)
    for r in got:
        w = D.words_of(texts[r["doc_id"]])[r["start_word"] : r["start_word"] + r["words"]]
        x = D.words_of(dict(items)[r["item_id"]])
        assert distance_by_hand(x, w)[0] == r["distance"] <= D.edits_allowed(len(x))


def test_awkward_rows(spark):
    item = "the quick brown fox jumps over a lazy dog and sleeps"
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (None, item), (5, "..."), (6, "a b")], "item_id long, text string")
    texts = [*awkward_texts(), f"x {item.upper()}! y {item}", item]
    docs = clashing(documents(spark, texts, [None, 1, 1, *range(3, len(texts))]))
    got = D.find_leaks(docs, bench)
    assert got.columns == ["doc_id", "item_id", "start_word", "words", "distance"]
    found = sorted((r["doc_id"], r["item_id"], r["start_word"], r["distance"]) for r in got.where("item_id < 6").collect())
    assert found == [(11, 1, 1, 0), (11, 1, 13, 0), (11, 2, 1, 0), (11, 2, 13, 0), (12, 1, 0, 0), (12, 2, 0, 0)]
    kept = D.drop_leaky(docs, bench.where("item_id < 3"))
    assert kept.schema == docs.schema and kept.count() == len(texts) - 2
    assert D.find_leaks(documents(spark, []), bench).count() == 0
    assert D.find_leaks(docs, bench.where("item_id > 99")).count() == 0
    assert D.drop_leaky(docs, bench.where("item_id > 99")).count() == len(texts)


def test_texts_beyond_one_part(monkeypatch):
    item = " ".join(f"k{i}" for i in range(14))
    monkeypatch.setattr(D, "PART", 16)
    text = " ".join(["x"] * 40 + [item] + ["y"] * 33 + [item])
    got = D.Finder(D.build([(7, item)])).leaks([None, text, ""])
    assert [(k, i, s, n, d) for k, i, s, n, d in got] == [(1, 7, 40, 14, 0), (1, 7, 87, 14, 0)]


def test_recall_of_edits_in_one_place(spark):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.1/benchmark.parquet").collect())
    finder = D.Finder(D.build(items))
    for place in range(3):
        for word in ([], ["zzq"]):
            texts = []
            for _, t in items:
                w = D.words_of(t)
                k = D.edits_allowed(len(w))
                at = (0, (len(w) - k) // 2, len(w) - k)[place]
                texts.append(" ".join(["Some other words here", *w[:at], *word * k, *w[at + k :], "and after it"]))
            got = {(k, i) for k, i, *_ in finder.leaks(texts)}
            assert sum((k, i) in got for k, (i, _) in enumerate(items)) >= 0.95 * len(items), (place, word)


def test_passage_without_its_head_at_the_head_of_a_text(spark):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.1/benchmark.parquet").collect())
    texts = [" ".join(D.words_of(t)[D.edits_allowed(len(D.words_of(t))) :]) for _, t in items]
    got = {(k, i) for k, i, *_ in D.Finder(D.build(items)).leaks(texts)}
    assert sum((k, i) in got for k, (i, _) in enumerate(items)) >= 0.95 * len(items)


def test_short_items_beside_long_ones(spark):
    items = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.1/benchmark.parquet").collect())
    short = [(1000, "kappa"), (1001, "lambda kappa"), (1002, "mu nu xi"), (1003, "mu nu xi kappa")]
    finder = D.Finder(D.build([*items, *short]))
    got = {(k, i) for k, i, *_ in finder.leaks([f"before {t} after" for _, t in short])}
    assert got == {(0, 1000), (1, 1000), (1, 1001), (2, 1002), (3, 1000), (3, 1002), (3, 1003)}


def test_items_that_hashes_do_not_reach_are_found_by_pieces(monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(f"k{rng.randrange(900)}" for _ in range(rng.randint(5, 60)))) for i in range(60)]
    monkeypatch.setattr(D, "MOST_TABLES", 1)
    finder = D.Finder(D.build(items))
    texts = [" ".join(["x y z", *edited(t.split(), D.edits_allowed(len(t.split())), rng), "x y z"]) for _, t in items]
    got = {(k, i) for k, i, *_ in finder.leaks(texts)}
    assert all((k, i) in got for k, (i, _) in enumerate(items))
