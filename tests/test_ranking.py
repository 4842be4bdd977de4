"""Relevance, gate, ranks and reading, against hand-made figures and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.operators import bm25, quality, ranking, serve

TEXTS = ["the cat sat", "the dog sat on the cat", "the bird", "the the the", "zebra"]
ITEMS = [(1, "cat cat zebra"), (2, "the"), (3, "nothing")]


def by_hand(texts, query):
    import re

    docs = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    vocab = {w for d in docs for w in d}
    raw = {w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in vocab}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in re.findall("[a-z0-9]+", query.lower())) for d in docs], idf


@pytest.fixture(scope="module")
def parts(spark):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_ord long, text string").withColumn("chunk_id", F.col("chunk_ord"))
    t = bm25.corpus(chunks)
    return spark.createDataFrame(ITEMS, "item_id int, text string"), t, bm25.vocabulary(t)


def test_scores_weigh_repeated_terms_and_floor_negative_idf(spark, parts):
    items, t, vocab = parts
    got = {(r["item_id"], r["chunk_ord"]): r["score"] for r in bm25.keyword_scores(items, t, vocab, bm25.fixed_gate(spark)).collect()}
    assert len(got) == len(ITEMS) * len(TEXTS)
    for i, q in ITEMS:
        want, _ = by_hand(TEXTS, q)
        assert np.allclose([got[i, k] for k in range(len(TEXTS))], want)


@pytest.fixture(scope="module")
def many(spark):
    """Chunks of many words, of which some are in most chunks, so that their idf comes from the mean."""
    rng = np.random.default_rng(7)
    texts = [" ".join(["the", "of", *(f"w{int(k)}" for k in rng.zipf(1.2, 60) % 9973)]) for _ in range(300)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_ord long, text string").withColumn("chunk_id", F.col("chunk_ord"))
    t = bm25.corpus(chunks)
    return t, bm25.vocabulary(t)


def test_mean_idf_is_exact(spark, many):
    rows = many[1].withColumn("raw", bm25.raw_idf(F.col("df"), F.col("n_chunks"))).collect()
    want = 0.25 * (math.fsum(r["raw"] for r in rows) / len(rows))
    assert len(rows) > 1000 and {r["idf"] for r in rows if r["raw"] < 0} == {want}
    for n in (1, 7):
        dealt = bm25.vocabulary(many[0].repartition(n, "chunk_ord"))
        assert {r["idf"] for r in dealt.where("term in ('the', 'of')").collect()} == {want}


def test_scores_are_exact_sums(spark, many):
    t, vocab = many
    items = t.where("chunk_ord < 6").select(F.col("chunk_ord").alias("item_id"), F.array_join("tokens", " ").alias("text"))
    asked = bm25.query_terms(items).join(vocab, "term").join(bm25.postings(t), "term")
    parts = asked.select("item_id", "chunk_ord", (F.col("qf") * bm25.contribution(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"))).alias("p"))
    want = {(r["item_id"], r["chunk_ord"]): math.fsum(r["p"]) for r in parts.groupBy("item_id", "chunk_ord").agg(F.collect_list("p").alias("p")).collect()}
    for n in (1, 7):
        got = bm25.sparse_scores(items, t.repartition(n), vocab, bm25.fixed_gate(spark)).collect()
        assert {(r["item_id"], r["chunk_ord"]): r["score"] for r in got} == want


def test_vocabulary_of_nothing(spark, parts):
    assert bm25.vocabulary(parts[1].where("chunk_ord < 0")).collect() == []


def test_gate_matches_numpy(spark, parts):
    _, t, vocab = parts
    g = bm25.derive_gate(t, vocab).first()
    limit = bm25.idf_for_df(2, len(TEXTS))
    _, idf = by_hand(TEXTS, "")
    rare = [w for w, v in idf.items() if v >= limit]
    assert g["rare_vocab_size"] == len(rare) and g["high_idf_threshold"] == round(limit, 6)
    single = [by_hand(TEXTS, w)[0][k] for w in rare for k, d in enumerate(TEXTS) if w in d.split()]
    assert math.isclose(g["min_score"], round(float(np.percentile(single, 1)), 6)) and g["single_term_contribution_n"] == len(single)
    with pytest.raises(ValueError):
        bm25.idf_for_df(2, 1)


def test_g39_rounded_and_exact_threshold(spark):
    n = 501
    chunks = spark.createDataFrame([(i, f"common w{i} " + ("pair" if i < 2 else "")) for i in range(n)], "chunk_ord long, text string").withColumn("chunk_id", F.col("chunk_ord"))
    t = bm25.corpus(chunks)
    vocab, gate = bm25.vocabulary(t), bm25.derive_gate(t, bm25.vocabulary(t))
    limit = lambda g: bm25.rare_terms(vocab.crossJoin(g.select("high_idf_threshold")), F.col("high_idf_threshold")).where("term = 'pair'").count()
    assert limit(gate) == 0 and limit(bm25.exact_gate(gate)) == 1
    assert gate.first()["rare_vocab_size"] == n + 1


def test_g40_no_rare_terms(spark):
    chunks = spark.createDataFrame([(i, "a b c") for i in range(9)], "chunk_ord long, text string").withColumn("chunk_id", F.col("chunk_ord"))
    t = bm25.corpus(chunks)
    g = bm25.derive_gate(t, bm25.vocabulary(t)).first()
    assert g["min_score"] == 0.0 and g["single_term_contribution_min"] is None


def test_ranks_ties_and_parts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, c, c, float(rng.choice([0.0, 0.0, 0.1, 0.24, 1.5, 2.25, -0.3]))) for i in range(3) for c in range(200)]
    s = spark.createDataFrame(rows, "item_id int, chunk_ord long, chunk_id long, score double")
    a = {(r["item_id"], r["chunk_ord"]): r["rank"] for r in ranking.ranked(s).collect()}
    b = {(r["item_id"], r["chunk_ord"]): r["rank"] for r in ranking.ranked_in_parts(s).collect()}
    assert a == b
    for i in range(3):
        x = np.array([r[3] for r in rows if r[0] == i])
        assert [a[i, c] for c in np.argsort(-x, kind="stable")] == list(range(1, 201))


def test_g36_fusion(spark):
    r = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2)], "item_id int, chunk_ord long, chunk_id long, rank int")
    got = {x["chunk_ord"]: x["score"] for x in ranking.fuse(r, r).collect()}
    assert math.isclose(got[0], 2 / 61) and math.isclose(got[1], 2 / 62)


def test_serving(spark):
    e = spark.createDataFrame([("A", "i", "keyword", k, k, 5.0 - k // 2, k < 3) for k in range(1, 5)] + [("A", "i", "both", 1, 1, 0.1, None)], "checklist string, item_id string, view string, chunk_id int, rank int, score double, above_floor boolean")
    assert serve.eligible(e).count() == 3 and serve.eligible(e, below_floor=True).count() == 5
    pool = e.where("view = 'keyword'")
    assert serve.default_floor(pool, ["item_id"], 3).first()["floor"] == 4.0
    assert serve.default_floor(pool, ["item_id"], 99).first()["floor"] == 3.0
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 2, "c")], "chunk_id int, chunk_ord int, doc string")
    shown = {r["chunk_id"]: (r["doc"], r["join_missing"]) for r in serve.shown(pool, 4.0, chunks, ["chunk_id"]).collect()}
    assert shown == {1: ("b", False), 2: ("c", False), 3: (None, True)}
    b = serve.slider_bounds(pool, ["item_id"]).first()
    assert (b["low"], b["high"], b["disabled"]) == (3.0, 5.0, False)
    with pytest.raises(Exception, match="no chunk"):
        serve.hydrate(pool, chunks.where("chunk_ord > 0"), ("doc",)).collect()


def test_checks(spark):
    d = spark.createDataFrame([(1,), (1,), (2,)], "chunk_id int")
    with pytest.raises(ValueError, match="unique"):
        quality.assert_unique(d, "chunk_id")
    with pytest.raises(ValueError, match="differs"):
        quality.assert_same_keys(d, d.where("chunk_id = 1"), "chunk_id")
    good = [("A", "i", "keyword", k, k, True) for k in (1, 2)] + [("A", "i", "both", k, k, None) for k in (1, 2)]
    bad = [("A", "j", "keyword", 1, 1, True), ("A", "k", "both", 1, 1, False), ("A", "k", "both", 2, 2, None)]
    r = spark.createDataFrame(good + bad, "checklist string, item_id string, view string, chunk_id int, rank int, above_floor boolean")
    assert {x["item_id"] for x in quality.list_faults(r, 2).collect()} == {"j", "k"}


def test_cosine_of_odd_vectors(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.5, 0.5, 0.5])], "item_id string, embedding array<float>")
    chunks = spark.createDataFrame([(0, "x", [0.25, 1.0]), (1, "y", None), (2, "z", [1.0, None]), (3, "w", [1.0, 1.0, 0.0]), (4, "v", [])], "chunk_ord long, chunk_id string, embedding array<float>")
    got = {(r["item_id"], r["chunk_id"]): r["score"] for r in ranking.semantic_scores(items, chunks).collect()}
    assert len(got) == 15 and {k: v for k, v in got.items() if v is not None} == {("a", "x"): 0.25, ("c", "w"): 1.0}
    assert ranking.semantic_scores(items, chunks.where("chunk_ord > 9")).count() == ranking.semantic_scores(items.where("item_id = 'q'"), chunks).count() == 0


def test_percentiles_in_two_passes(spark):
    rng = np.random.default_rng(4)
    for x in (rng.random(1000) * 3, rng.integers(0, 5, 400) / 2, np.array([1.25]), np.array([0.0, 7.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "c double")
        fractions = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
        assert np.allclose(bm25.percentiles(df, "c", fractions), [np.percentile(x, 100 * f) for f in fractions])
    assert bm25.percentiles(df.where("c > 9"), "c", [0.5]) == [None]


def test_vector_faults_stop_an_index(spark):
    ok = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "k int, embedding array<float>")
    quality.assert_vectors(ok, "k")
    for bad in (None, [1.0], [float("nan"), 1.0], [None, 1.0]):
        with pytest.raises(ValueError, match="3"):
            quality.assert_vectors(ok.union(spark.createDataFrame([(3, bad)], ok.schema)), "k")
