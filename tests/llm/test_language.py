from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from clausework.llm import language
from clausework.llm.common import held_out
from tests.conftest import DATA
from tests.llm.helpers import awkward_texts, clashing, documents


def test_held_out_accuracy(spark):
    got = language.op2_language(spark, f"{DATA}/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)


def test_backs_off_to_shorter_grams(spark):
    docs = documents(spark, ["the thing the thing the other the thing"] * 3 + ["der dieser der jener der dieser der jener"] * 3, langs=["en"] * 3 + ["de"] * 3)
    s = language.Scorer(language.fit(docs))
    assert s.predict("the")[0] == "en" and s.predict("der")[0] == "de"
    assert s.predict("thinger")[0] == "en" and s.predict("diesem")[0] == "de"
    a, b = s.predict("the"), s.predict("the the the the")
    assert a[0] == b[0] and a[1] < b[1] <= 1


def test_awkward_rows(spark):
    texts = [*awkward_texts(), "1234 ... 56", "²³ ½"]
    docs = clashing(documents(spark, texts, [None, 1, 1, *range(3, len(texts))], ["en", None] * 6 + ["fr"]))
    model = language.fit(docs)
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == len(texts)
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by_id[None] == by_id[1] == by_id[3] == by_id[11] == by_id[12] == ("und", 0.0)
    assert by_id[4][0] in model.langs
    empty = documents(spark, [])
    assert language.fit(empty).langs == [] and language.identify(empty, model).count() == 0
    assert language.identify(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def scored_by_hand(model, text):
    total = np.zeros(len(model.langs))
    words = language.words_of(text)
    for w in words:
        if w in model.words:
            total += model.word_logs[model.words[w]]
            continue
        weight = language.BACKOFF
        for n in language.ORDERS:
            hit = [model.grams[n][g] for g in language.grams_of(w, n) if g in model.grams[n]]
            if hit:
                total += model.gram_logs[n][hit].mean(axis=0) * weight
                break
            weight *= language.BACKOFF
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    p = np.exp(total - total.max())
    return model.langs[int(p.argmax())], float(p.max() / p.sum())


def test_query_against_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    model = language.fit(docs.where(~held_out(F.col("doc_id"), *language.HELD_OUT)))
    got = {r["doc_id"]: r for r in language.op2_language(spark, f"{DATA}/sf0.001").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        lang, score = scored_by_hand(model, t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-3, i
    s = language.Scorer(model)
    together = s.predict_all(list(texts.values()))
    monkeypatch.setattr(language, "TOKENS", 40)
    assert together == s.predict_all(list(texts.values())) == [s.predict(t) for t in texts.values()]  # whatever is scored with it


def test_words_without_known_grams_say_nothing_whatever_came_before(spark):
    model = language.fit(documents(spark, ["aa bb cc dd ee"] * 3 + ["xx yy zz ww vv"] * 3, langs=["a"] * 3 + ["x"] * 3))
    s = language.Scorer(model)
    fresh = language.Scorer(model).predict("漢字")
    assert (s.evidence(["漢字"])[0] == s.evidence(["aa", "漢字", "xx"])[1]).all()
    for text in ("aa bb", "cc dd ee", "xx yy zz", "ww vv"):
        s.predict(text)
        assert s.predict("漢字") == fresh
