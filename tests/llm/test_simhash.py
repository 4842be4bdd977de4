from __future__ import annotations

import re

import numpy as np
import xxhash

from clausework.llm import simhash
from clausework.llm.graph import components
from tests.conftest import DATA
from tests.llm.helpers import awkward_texts, clashing, documents, rows


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(fps):
    """Smallest position reachable over links of three bits or fewer."""
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints(spark):
    texts = ["Ab c D e f ab C d", "X y", "ÀB c d", *awkward_texts()]
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == [by_hand(t) for t in texts]


def test_words_beyond_one_block(monkeypatch):
    text = " ".join(f"w{i % 71}" for i in range(500))
    monkeypatch.setattr(simhash, "WORDS", 64)
    assert simhash.fingerprint(text.encode()) == by_hand(text)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").collect()
    fps = [by_hand(d["text"]) for d in docs]
    label = groups_by_hand(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op5_simhash(spark, f"{DATA}/sf0.001").collect()}
    assert got == {d["doc_id"]: (f"{fps[i]:016x}", docs[label[i]]["doc_id"]) for i, d in enumerate(docs)}


def test_links_reach_all_within_the_radius_over_split_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) for b in base]
    for b in base[:20]:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(bit)
            near.append(x)
    fps = sorted(set(near))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=4), "a", "b").collect()
    mine: dict = {}
    for r in found:
        mine.setdefault(r["component"], set()).add(r["node"])
    label = groups_by_hand(fps)
    want: dict = {}
    for x, l in zip(signed, label):
        want.setdefault(l, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_dense_tile_gives_a_forest(monkeypatch):
    fps = np.array([0, *(1 << b for b in range(60))], np.int64)
    edges = list(simhash.tile_links(fps, fps, True))
    assert len(edges) <= 2 * len(fps)
    seen = {0}
    for _ in fps:
        seen |= {x for e in edges if seen & set(e) for x in e}
    assert seen == set(fps.tolist())


def test_awkward_rows(spark):
    texts = awkward_texts()
    ids = [None, 3, 3, *range(4, len(texts) + 1)]
    got = simhash.simhash_components(clashing(documents(spark, texts, ids)))
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == len(texts)
    by_id = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by_id[3] == by_id[None] == 3  # null and blank texts are alike
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    texts = ["a b c d e", "a b c d e", None, "", "z y x w v u", "a b c d e"]
    docs = clashing(documents(spark, texts, [5, 2, 9, 8, 7, 2]))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a b c d e"), (7, "z y x w v u"), (8, "")]
    assert rows(simhash.drop_near_copies(documents(spark, []))) == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
