from __future__ import annotations

import corpus_pipeline
from clausework.llm import decontaminate, lines, simhash
from tests.conftest import DATA
from tests.llm.test_lines import by_hand as lines_by_hand
from tests.llm.test_packing import check
from tests.llm.test_simhash import by_hand as fingerprint_by_hand
from tests.llm.test_simhash import groups_by_hand

SF = f"{DATA}/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        assert name == "packing" or docs.columns == names
    assert list(kept) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {name: dict(sorted((r["doc_id"], r["text"]) for r in df.collect())) for name, df in kept.items() if name != "packing"}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = start.keys() - after["toxicity"].keys()
    assert all(after["toxicity"][i] == start[i] for i in after["toxicity"])
    assert sum(labels.get(i) == 1 for i in gone) >= 0.6 * sum(labels.values()) and sum(labels.get(i) == 0 for i in gone) <= 0.08 * len(labels)
    assert list(after["line_dedup"].values()) == lines_by_hand(after["toxicity"].values())
    ids = list(after["line_dedup"])
    label = groups_by_hand([fingerprint_by_hand(after["line_dedup"][i]) for i in ids])
    assert after["near_dedup"] == {ids[k]: after["line_dedup"][ids[k]] for k in sorted(set(label))}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = after["near_dedup"].keys() - after["decontamination"].keys()
    assert {i for i, t in after["near_dedup"].items() if any(x in t for x in items)} <= leaked
    assert all(decontaminate.words_of(after["near_dedup"][i]) for i in leaked) and len(leaked) < 0.1 * len(after["near_dedup"])
    check(list(after["decontamination"].items()), kept["packing"].collect())


def test_run_is_registered_and_gives_the_last_stage(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, f"{DATA}/sf0.001")
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
    assert simhash.RADIUS == 3 and lines.MIN_LINES == 2
