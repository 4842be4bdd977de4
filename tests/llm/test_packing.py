from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausework.llm import packing
from tests.conftest import DATA
from tests.llm.helpers import awkward_texts, clashing, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got, limit=2048):
    """Every id in one piece, in order; sequences without gaps and within the limit."""
    whole = Tokenizer.from_file(PATH)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids[i][p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[i])
            at += p["length"]
        assert at == len(ids[i])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), sum(map(len, ids.values()))


def test_query_round_trip(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    n, total = check(docs, packing.op9_packing(spark, f"{DATA}/sf0.01").collect())
    assert n <= 1.01 * -(-total // 2048)


def test_awkward_rows(spark):
    texts = [*awkward_texts(), "it's <|endoftext|> x áb ΑΣ İx"]
    docs = documents(spark, texts)
    check(list(enumerate(texts)), packing.pack(clashing(docs), PATH).collect())
    twice = packing.pack(docs.union(docs.selectExpr("CAST(NULL AS long)", "text", "lang", "source", "n_chars")), PATH)
    pieces = twice.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in pieces) <= 2048
    assert packing.pack(documents(spark, []), PATH).count() == 0


words = st.text(st.characters(min_codepoint=1, max_codepoint=0x400), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=8))
def test_words_have_the_tokenizers_ids(parts):
    known = test_words_have_the_tokenizers_ids.__dict__.setdefault("known", packing.Words(PATH))
    text = " ".join(parts).replace("\n", " ")
    want = np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert known.ids(text.split(" ")) == want


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_patterns_use_every_length_once(histogram):
    used: dict = {}
    for count, lengths in packing.shortest_pack_first(histogram, 64):
        assert count > 0 and sum(lengths) <= 64 and lengths == sorted(lengths, reverse=True)
        for x in lengths:
            used[x] = used.get(x, 0) + count
    assert used == histogram
    slots = packing._slots(packing.shortest_pack_first(histogram, 64))
    for x, n in histogram.items():
        spans = sorted((lo, hi) for length, lo, hi, *_ in slots if length == x)
        assert [s for s, _ in spans] == [0, *(e for _, e in spans[:-1])] and spans[-1][1] == n


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), max_size=20))
def test_patterns_are_those_of_packing_one_at_a_time(histogram):
    packs: list[list[int]] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            shortest = min(packs, key=sum, default=None)
            if shortest is not None and sum(shortest) + length <= 64:
                shortest.append(length)
            else:
                packs.append([length])
    got = [tuple(lengths) for count, lengths in packing.shortest_pack_first(histogram, 64) for _ in range(count)]
    assert len(got) == len(packs) and sorted(map(sum, got)) == sorted(map(sum, packs))


def test_other_tokenizers_are_refused(tmp_path):
    import json

    import pytest

    data = json.load(open(PATH, encoding="utf-8"))
    data["normalizer"] = None  # no lower case
    (tmp_path / "t.json").write_text(json.dumps(data), encoding="utf-8")
    with pytest.raises(ValueError):
        packing.Words(str(tmp_path / "t.json"))


def test_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    p = spark.range(100).selectExpr("id AS doc_id", "0L AS start", "id % 3 AS length", "0L AS ids_crc32", "1L AS doc_tokens").checkpoint()
    got = packing.ranked(p).collect()
    for x in range(3):
        assert sorted(r["rank"] for r in got if r["length"] == x) == list(range(sum(i % 3 == x for i in range(100))))
