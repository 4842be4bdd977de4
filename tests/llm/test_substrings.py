from __future__ import annotations

import random

import numpy as np

from clausework.llm import substrings
from tests.llm.helpers import awkward_texts, clashing, documents


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def gear_by_hand(data):
    h, out = 0, []
    for b in data:
        h = (2 * h + int(substrings.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    assert substrings.gear_hashes(np.frombuffer(data, np.uint8).copy()).tolist() == gear_by_hand(data)


def test_boundaries_are_local_maxima_and_resist_shifts(monkeypatch):
    rng = random.Random(2)
    data = prose(rng, 400).encode()
    h, r = gear_by_hand(data), substrings.REACH
    peaks = [i + 1 for i in range(len(h)) if h[i] == max(h[max(0, i - r) : i + r + 1])]
    got = substrings.boundaries(data).tolist()
    assert got[-1] == len(data) and set(got[:-1]) <= set(peaks) and len(got) >= 0.9 * len(peaks)
    moved = substrings.boundaries(b"some inserted bytes" + data).tolist()
    shift = len(b"some inserted bytes")
    assert len({x + shift for x in got} & set(moved)) >= len(got) - 3
    assert substrings.boundaries(b"").tolist() == [] and substrings.boundaries(b"aaaa" * 100)[-1] == 400
    monkeypatch.setattr(substrings, "PART", 256)
    assert substrings.boundaries(data).tolist() == got


def chunks_by_hand(texts, within=False):
    """Spans that an earlier text has too, or an earlier place, from chunks alone; texts are in the order of places."""
    first: dict = {}
    found = []
    for k, (i, t) in enumerate(texts):
        data, at, open_ = (t or "").encode(), 0, None
        for e in substrings.boundaries(data).tolist():
            p, q = first.setdefault(data[at:e], (k, at))
            dup = p != k or (within and q != at)
            if dup and open_:
                open_ = (open_[0], open_[1] + e - at)
            elif dup:
                open_ = (at, e - at)
            elif open_:
                found.append((i, *open_))
                open_ = None
            at = e
        found += [(i, *open_)] if open_ else []
    return sorted(found)


def test_planted_passages_against_brute_force(spark):
    rng = random.Random(3)
    shared = [prose(rng, 52) for _ in range(20)]
    texts = []
    for i in range(120):
        own = [prose(rng, rng.randint(5, 60)) for _ in range(3)]
        if i < 60:
            own.insert(1, shared[i % 20])
        texts.append((i, " ".join(own)))
    docs = documents(spark, [t for _, t in texts], [i for i, _ in texts])
    got = substrings.repeated_spans(docs, min_words=0).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got) == chunks_by_hand(texts)
    found = substrings.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in found} == set(range(20, 60)) and all(r["first_doc_id"] == r["doc_id"] % 20 for r in found)
    for r in found:
        data = texts[r["doc_id"]][1].encode()[r["start"] : r["start"] + r["length"]]
        assert data in texts[r["first_doc_id"]][1].encode() and r["words"] >= substrings.MIN_WORDS


def test_awkward_rows(spark):
    texts = awkward_texts()
    docs = clashing(documents(spark, texts, [None, 1, 1, *range(3, len(texts))]))
    spans = substrings.repeated_spans(docs)
    got = spans.drop("doc_key").collect()
    assert [(r["doc_id"], r["first_doc_id"]) for r in got] == [(8, 7)]  # the long text and its copy
    # the long text repeats itself as well
    assert {(r["doc_id"], r["first_doc_id"]) for r in substrings.repeated_spans(docs, within=True).collect()} >= {(7, 7), (8, 7)}
    cleaned = substrings.without_spans(docs, spans)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    left = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert len(left[8]) < 200 and left[7] == texts[7] and left[None] is None
    assert substrings.repeated_spans(documents(spark, [])).count() == 0


def test_null_and_equal_ids_and_repeated_rows(spark):
    rng = random.Random(11)
    p = prose(rng, 200)
    texts = [p, "own words first " + p, prose(rng, 150)]
    for ids in ([1, 2, 3], [4, 4, 4], [None, None, None], [4, None, 5]):
        want = None
        for times in (1, 2, 3):  # rows that are repeated change nothing
            docs = documents(spark, texts * times, ids * times)
            got = sorted((r["doc_id"] is None, r["start"], r["length"], r["words"], r["first_doc_id"] is None) for r in substrings.repeated_spans(docs).collect())
            want = want or got
            assert got == want and len(got) == 1 and got[0][3] >= 190, (ids, times, got)


def test_repeats_within_one_text(spark):
    rng = random.Random(12)
    p, texts = prose(rng, 80), []
    texts = [(3, " ".join([prose(rng, 30), p, prose(rng, 30), p, prose(rng, 20)]))]
    docs = documents(spark, [t for _, t in texts], [3])
    assert substrings.repeated_spans(docs, min_words=0).count() == 0
    got = substrings.repeated_spans(docs, min_words=0, within=True).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got) == chunks_by_hand(texts, within=True)
    assert len(got) == 1 and got[0]["first_doc_id"] == 3 and got[0]["words"] >= 60


def test_runs_of_one_word_have_chunks_and_are_found(spark):
    rng = random.Random(13)
    texts = []
    for i, (word, n) in enumerate([("and", 99), ("and", 60), ("a", 400), ("a", 70), ("over again", 300), ("over again", 45), ("lone", 80)]):
        run = " ".join([word] * n)
        data = f"{prose(rng, 30)} {run} {prose(rng, 30)}"
        texts.append((i, data))
        ends = substrings.boundaries(data.encode())
        assert np.diff(ends).max() <= 200 and np.diff(ends[:-1]).min() > substrings.REACH
    got = substrings.repeated_spans(documents(spark, [t for _, t in texts], [i for i, _ in texts])).collect()
    assert sorted((r["doc_id"], r["first_doc_id"]) for r in got) == [(1, 0), (3, 2), (5, 4)]
    for r in got:
        data = texts[r["doc_id"]][1].encode()[r["start"] : r["start"] + r["length"]]
        assert data in texts[r["first_doc_id"]][1].encode() and r["words"] >= substrings.MIN_WORDS
    whole = b"and " * 100_000
    assert np.diff(substrings.boundaries(whole)).max() <= 64
