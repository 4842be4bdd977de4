from __future__ import annotations

import zlib

import numpy as np

from clausework.llm import toxicity
from tests.conftest import DATA
from tests.llm.helpers import awkward_texts, clashing, documents


def test_held_out_quality(spark):
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, f"{DATA}/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    unseen = [(labels[i], got[i]["predicted"]) for i in labels if got[i]["held_out"]]
    hit = sum(a and b for a, b in unseen)
    assert hit >= 0.8 * sum(a for a, _ in unseen) and hit >= 0.85 * sum(b for _, b in unseen)


def test_label_model_recovers_rates_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    rate = np.where(y[:, None], [0.8, 0.7, 0.6], [0.05, 0.1, 0.02])
    votes = (rng.random((4000, 3)) < rate).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of the first voter
    noisy = np.where(rng.random(4000) < 0.1, ~y, y).astype(float)
    posterior, rates, w = toxicity.label_model(votes, 0.2, noisy)
    assert np.abs(rates[1][:3] - [0.8, 0.7, 0.6]).max() < 0.2 and np.abs(rates[0][:3] - [0.05, 0.1, 0.02]).max() < 0.1
    assert w[0] < 0.7 and w[3] < 0.7 and w[1] > 0.9
    assert ((posterior > 0.5) == y).mean() > 0.88


def test_lexicon_needs_more_than_chance():
    rare = [("rare", 3, 0), ("common", 50, 400), ("sure", 40, 1), ("sure*1", 40, 1), ("sured*1", 30, 1)] + [(f"x{i}", 3, 0) for i in range(100)] + [(f"y{i}", 0, 3) for i in range(100_000)]
    assert toxicity.choose_lexicon(rare, 100, 900) == ["sure*1"]
    assert toxicity.choose_lexicon(rare, 0, 900) == []


def score_by_hand(model, text):
    """The score from whole signals of a text and patterns searched everywhere."""
    import math
    import re

    words = toxicity.words_of(text)
    named = toxicity.signals_of(set(words))
    on = [model.weights[i] for s, i in model.lexicon.items() if s in named]
    stems = {s[: s.index("*")] for s in model.lexicon if "*" in s}
    met = lambda w: w in model.lexicon or any(w[:n] in stems for n in toxicity.STEMS if len(w) >= n)
    hits = [w for w in words if met(w)]
    found = (re.findall(r"!{2,}", text or ""), re.findall(r"\b[A-Z]{4,}\b", text or ""), re.findall(r"\b\w+[*@#$]+\w+\b", text or ""), [w for w in words if w in toxicity.SECOND_PERSON])
    dense = [float(len(f) >= least) for f, (_, least) in zip(found, toxicity.PATTERNS)] + [math.log1p(len(set(hits))), len(hits) / (1 + len(words))]
    k = len(model.lexicon)
    logit = model.bias + sum(map(float, on)) + sum(float(w) * v for w, v in zip(model.weights[k:], dense))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))


def test_query_against_brute_force(spark):
    sf = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fitted(spark, docs, sf)
    got = {r["doc_id"]: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys() and len(model.lexicon) > 0
    for i, t in texts.items():
        want = score_by_hand(model, t)
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == (want >= 0.3), i
    some = "YOU idiot!!! SHOUT LOUD f*ck AAAA BBBB CCCC DDDD you du e@mail !! !!! x"
    assert abs(toxicity.score_of(model, *toxicity.Voters(model.lexicon).features(some)) - score_by_hand(model, some)) < 1e-9
    assert toxicity.has_capitals("éABCDz") and not toxicity.has_capitals("ABCé DEF") and not toxicity.has_capitals("")


def test_texts_that_share_a_labelled_id_are_one_row_of_the_sample(spark):
    texts = [f"you idiot {i} text of words" if i % 3 == 0 else f"nice text of words {i}" for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    many = documents(spark, texts + [f"another text {i} of one document" for i in range(500)], [*range(60), *[1] * 500])
    assert toxicity.fit(many, labels).lexicon.keys() == toxicity.fit(documents(spark, texts), labels).lexicon.keys()


def fitted(spark):
    texts = [f"you idiot {i} text of words" if i % 3 == 0 else f"nice text of words {i}" for i in range(150)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_awkward_rows(spark):
    model = fitted(spark)
    texts = [*awkward_texts(), "an idiot wrote it", "pleasant"]
    docs = clashing(documents(spark, texts, [None, 1, 1, *range(3, len(texts))]))
    got = toxicity.toxicity(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == len(texts)
    by_id = {r["doc_id"]: r["predicted"] for r in got.collect()}
    assert by_id[11] == 1 and by_id[12] == by_id[None] == by_id[1] == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(texts) - 1
    empty = documents(spark, [])
    assert toxicity.toxicity(empty, model).count() == toxicity.keep_clean(empty, model).count() == 0


def test_no_labels_or_one_class_reject_nothing(spark):
    docs = documents(spark, ["a b", "c d"])
    for labels in ([], [(0, 0), (1, 0)], [(0, 1), (1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.toxicity(docs, model).where("predicted = 1").count() == 0
