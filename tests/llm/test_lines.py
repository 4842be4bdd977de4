from __future__ import annotations

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from clausework.llm import lines
from clausework.llm.common import join_counted
from tests.conftest import DATA
from tests.llm.helpers import awkward_texts, clashing, documents


def by_hand(texts, least=2):
    """texts in order of id, without the pieces that an earlier place has."""
    first, out = {}, []
    for k, t in enumerate(texts):
        ls, gone = (t or "").split("\n"), set()
        for at, n in lines.pieces([x.encode() for x in ls], least) if t else []:
            p, q = first.setdefault(tuple(ls[at : at + n]), (k, at))
            if p < k or q + n <= at:
                gone |= set(range(at, at + n))
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone) if t is not None else None)
    return out


def runs_by_hand(texts, least=2):
    """The same for every run of lines that an earlier place has: lines are compared, and no chunks are made."""
    first, out = {}, []
    for k, t in enumerate(texts):
        ls, gone = (t or "").split("\n"), set()
        for i in range(len(ls) - least + 1):
            at = first.setdefault(tuple(ls[i : i + least]), (k, i))
            if at[0] < k or at[1] + least <= i:
                gone |= set(range(i, i + least))
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone) if t is not None else None)
    return out


def test_chunks_cover_all_lines_and_resist_shifts():
    rng = random.Random(1)
    ls = [str(rng.random()).encode() for _ in range(300)]
    got = lines.line_chunks(ls)
    assert [a for a, _ in got] == [0, *(a + n for a, n in got[:-1])] and sum(n for _, n in got) == 300
    moved = {a - 2 for a, _ in lines.line_chunks([b"x", b"y", *ls])}
    assert len({a for a, _ in got} & moved) >= len(got) - 2
    assert 1.2 < 300 / len(got) < 1.5 and max(n for _, n in got) <= lines.MOST
    assert max(n for _, n in lines.line_chunks([b"same"] * 1000)) <= lines.MOST
    assert lines.line_chunks([]) == []


def test_query_against_brute_force(spark):
    import hashlib

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect())
    want = by_hand([t for _, t in docs])
    got = {r["doc_id"]: r for r in lines.op8_lines(spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == len(docs)
    for (i, t), w in zip(docs, want):
        assert got[i]["text_sha256"] == hashlib.sha256(w.encode()).hexdigest() and got[i]["n_removed"] == len(t.split("\n")) - (len(w.split("\n")) if w else 0), i


def test_repeats_within_and_across(spark):
    rng = random.Random(5)
    block = "\n".join(str(rng.random()) for _ in range(40))
    texts = [f"a{i}\n{block}\nz{i}" for i in range(30)] + [f"{block}\nmid\n{block}", "single\nlines"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == by_hand(texts)
    assert got[0]["text"] == texts[0] and all(got[i]["n_chars"] == len(got[i]["text"]) for i in got)


def test_awkward_rows(spark):
    texts = [*awkward_texts(), awkward_texts()[-1]]
    docs = clashing(documents(spark, texts, [None, 1, 1, *range(3, len(texts))]))
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == len(texts)
    by_id = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by_id[None] is None and by_id[7] == texts[7] and len(by_id[11]) < len(texts[11])
    twice = documents(spark, [texts[-1]] * 2, [4, 4])
    assert len({r["text"] for r in lines.drop_repeated_lines(twice).collect()}) == 1  # equal rows are one document
    assert lines.drop_repeated_lines(documents(spark, [])).count() == 0


def test_digests_that_collide_are_told_apart(spark, monkeypatch):
    docs = documents(spark, ["p1\np2", "q1\nq2", "p1\np2\nz"], [1, 2, 3])
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.lit(0).alias("line"), F.lit(2).alias("lines"), F.lit(7).cast("long").alias("h1"), F.lit(7).cast("long").alias("h2"))
    monkeypatch.setattr(lines, "piece_rows", lambda docs, min_lines=2: rows)
    assert [(r["id"], r["keeper"]) for r in lines.repeated_pieces(docs).collect()] == [(3, 1)]


def test_runs_of_lines_are_found_wherever_they_begin_and_end(spark):
    rng = random.Random(3)
    some = lambda n: [str(rng.random()) for _ in range(n)]
    lost = total = 0
    texts = []
    for n in (2, 3, 4, 8):
        for _ in range(40):
            run = some(n)
            texts += ["\n".join([*some(rng.randrange(6)), *run, *some(rng.randrange(6))]) for _ in range(2)]
    for t, w, all_ in zip(texts, by_hand(texts), runs_by_hand(texts)):
        total += len(t) - len(all_)
        lost += len(w) - len(all_)
        assert len(w) >= len(all_)
    assert lost <= 0.1 * total
    texts += ["x\ny\nx\ny\nx", "a\na\na\na", "x\nq"]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts) and got[len(texts) - 2] == "a\na" and got[len(texts) - 1] == "x\nq"
    three = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(documents(spark, texts), min_lines=3).collect()}
    assert [three[i] for i in range(len(texts))] == by_hand(texts, 3) and three[1] == texts[1]


def test_share_of_all_repeated_runs():
    docs = sorted((r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist())
    texts = [t for _, t in docs]
    removed = [sum(len(t.split("\n")) - len(w.split("\n")) for t, w in zip(texts, f(texts))) for f in (by_hand, runs_by_hand)]
    assert 0.95 * removed[1] <= removed[0] <= removed[1]


def test_null_and_equal_ids_and_repeated_rows(spark):
    rng = random.Random(9)
    block = "\n".join(str(rng.random()) for _ in range(40))
    texts = [f"a{i}\n{block}\nz{i}" for i in range(4)]
    for ids in ([1, 2, 3, 4], [None] * 4, [7] * 4, [5, None, 5, None]):
        for times in (1, 2, 3):
            got = [r["text"] for r in lines.drop_repeated_lines(documents(spark, texts * times, ids * times)).collect()]
            assert len(got) == 4 * times and sorted(map(len, set(got)))[-1] == len(texts[0])
            assert sum(t in texts for t in got) == times and all(t.count("\n") <= 4 for t in got if t not in texts)


def test_a_very_common_piece_is_dealt_over_tasks(spark):
    texts = [f"{i}\ncommon one\ncommon two\n{i} end" for i in range(500)]
    small = lines.piece_rows(documents(spark, texts))
    counted = small.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    met = join_counted(small, counted, ["h1", "h2"], ["id", "key"], parts=50)
    assert met.count() == small.count()
    big = counted.orderBy(F.desc("n")).first()
    parts = small.where((F.col("h1") == big["h1"]) & (F.col("h2") == big["h2"])).select(F.pmod(F.xxhash64("id", "key"), F.lit(8)).alias("p")).groupBy("p").count().collect()
    assert big["n"] == 500 and max(r["count"] for r in parts) < 120
