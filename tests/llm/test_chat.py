from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausework.llm import chat, registry
from tests.conftest import DATA, assert_like_sql

LOG = "conv_id long, seq long, kind string, msg string, turn long, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"


def folded(spark, rows):
    return sorted(map(tuple, chat.fold(spark.createDataFrame(rows, LOG)).collect()), key=repr)


def test_deltas_edits_and_regenerations(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 2)
    rows = [
        (1, 5, "delta", "m", 0, None, "c"), (1, 1, "message", "m", 0, "user", "a"), (1, 3, "delta", "m", 0, None, "b"),
        (1, 2, "message", "n", 1, "assistant", "bad"), (1, 6, "regenerate", "n", 1, None, ""), (1, 7, "delta", "n", 1, None, "go"), (1, 9, "delta", "n", 1, None, "od"),
        (2, 1, "delta", "m", 0, "user", "only "), (2, 2, "delta", "m", 0, None, "deltas"), (2, 3, "delta", "m", 0, None, None),
        (3, 1, "message", "m", 0, "user", "old"), (3, 2, "edit", "m", 0, None, "new"), (3, 3, "delta", "m", 0, None, "er"),
    ]
    assert folded(spark, rows) == [(1, 0, "user", "abc"), (1, 1, "assistant", "good"), (2, 0, "user", "only deltas"), (3, 0, "user", "newer")]


def test_round_trip_of_control_strings(spark):
    nasty = ["</s>", "[INST]", "\\", "\\\\[INST\\]", "<s", "s>", "[/INST]</s><s>[INST]", "a\nb", "", None, "<\\/s>", "é🙂", "x" * 5000]
    rows = [(1, i, "assistant" if i % 2 else t or "user", t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (None, 0, "user", "q"), (3, 0, "user", "hi")]
    done = chat.render(spark.createDataFrame(rows, TURNS)).select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_of(F.col("formatted"), F.col("mask")).alias("loss"), "mask")
    by_id = {r["conv_id"]: r for r in done.collect()}
    assert [(x["role"], x["text"]) for x in by_id[1]["t"]] == [("assistant" if i % 2 else t or "user", t or "") for i, t in enumerate(nasty)]
    assert by_id[1]["loss"] == "".join((t or "") for i, t in enumerate(nasty) if i % 2 or t == "assistant")
    assert sum(m["before"] + m["loss"] + m["after"] for m in by_id[1]["mask"]) + len(chat.OPEN) == len(by_id[1]["formatted"])
    assert [(x["role"], x["text"]) for x in by_id[2]["t"]] == [("", "")] and by_id[2]["loss"] == ""
    assert by_id[None]["t"][0]["text"] == "q"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("\\<>[]/sINT a\n"), max_size=30), min_size=1, max_size=40))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_order_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 2)
    rows = [(1, 5, "user", "f"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 3, "assistant", "e"), (1, 1, "assistant", "d")]
    df = spark.createDataFrame(rows, TURNS).withColumn("seq", F.lit("x")).withColumn("mask", F.lit(1))
    got = chat.render(chat.fold(chat.as_events(df))).select(chat.turns_of(F.col("formatted")).alias("t")).first()["t"]
    assert [x["text"] for x in got] == ["first", "a", "a", "b", "d", "e", "f"]
    assert chat.render(chat.fold(chat.as_events(spark.createDataFrame([], TURNS)))).count() == 0


def test_native_plan(spark):
    plan = chat.op6_chat_formatting(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_like_sql(spark):
    assert_like_sql(chat.op6_chat_formatting(spark, f"{DATA}/sf0.01"), registry.oracle_sql()["op6_chat_formatting"], "sf0.01")
