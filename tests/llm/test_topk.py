from __future__ import annotations

import numpy as np
import pytest

from clausework.llm import registry, topk
from tests.conftest import DATA, assert_like_sql


def by_hand(ids, vecs, queries, k):
    q = np.floor(64 * vecs.astype(np.float64)).astype(np.int64)
    out = []
    for i, v in zip(ids, q):
        if i in queries:
            scored = sorted((-int(v @ w), j) for j, w in zip(ids, q) if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, block int, score string")


def vectors(spark, ids, vecs):
    return frame(spark, [(int(i), [float(x) for x in v], 1, 2, "x") for i, v in zip(ids, vecs)])


@pytest.mark.parametrize("n,dim,k", [(150, 7, 5), (300, 64, 20), (3, 4, 20)])
def test_random_with_ties(spark, n, dim, k, monkeypatch):
    rng = np.random.default_rng(n)
    vecs = rng.normal(size=(n, dim)).astype(np.float32)
    vecs[n // 3 :: 2] = vecs[0]
    ids = rng.permutation(n) * 3 - 7
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    df = vectors(spark, ids, vecs)
    queries = {int(i) for i in ids if i % 5 == 0} or {int(ids[0])}
    got = topk.top_k(df, df.where(df.vec_id.isin(*queries)), k)
    assert sorted(map(tuple, got.collect())) == by_hand(ids.tolist(), vecs, queries, k)


def test_slices_hold_the_values_and_sums():
    rng = np.random.default_rng(0)
    x = rng.integers(-70, 64, size=(130, 9))
    lows, bits = topk.slices(x)
    for q in (rng.integers(-64, 64, 9), np.zeros(9, np.int64), -np.ones(9, np.int64)):
        sums, base = topk.scores(q, lows, bits)
        assert (topk.values_at(sums, np.arange(130)) + base == x @ q).all()


def test_unusable_vectors_take_no_part(spark):
    rows = [(1, [0.5, 0.5], 0, 0, ""), (2, None, 0, 0, ""), (3, [0.1, None], 0, 0, ""), (4, [float("nan"), 0.1], 0, 0, ""), (5, [float("inf"), 0.1], 0, 0, ""), (6, [], 0, 0, ""), (None, [0.5, 0.5], 0, 0, ""), (7, [0.5, -0.5], 0, 0, ""), (8, [0.5], 0, 0, ""), (7, [0.5, -0.5], 0, 0, "")]
    df = frame(spark, rows)
    got = sorted(map(tuple, topk.top_k(df, df).collect()))
    assert got == [(1, 1, 7, 0), (1, 2, 7, 0), (7, 1, 1, 0)]
    assert topk.top_k(df.where("vec_id = 99"), df).count() == 0


def test_repeated_rows_ask_once_and_count_each(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8)).astype(np.float32)
    ids = [*range(40), *range(20)]
    vecs[40:] = vecs[:20]
    df = vectors(spark, ids, vecs)
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), 20).collect()))
    want = sorted(set(by_hand(ids, vecs, {0, 5, 10, 15, 20, 25, 30, 35}, 20)))
    assert got == want and len(got) == 8 * 20
    two = frame(spark, [(1, [0.5, 0.5], 0, 0, ""), (1, [0.9, 0.0], 0, 0, ""), (2, [1.0, 0.0], 0, 0, "")])
    assert [tuple(r) for r in topk.top_k(two, two.where("vec_id = 1")).collect()] == [(1, 1, 2, 32 * 64)]


def test_like_sql(spark):
    assert_like_sql(topk.op4_topk(spark, f"{DATA}/sf0.001"), registry.oracle_sql()["op4_topk"], "sf0.001")
