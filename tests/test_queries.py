"""Every registered query of the engine against its DuckDB counterpart."""

from __future__ import annotations

from functools import partial

import pytest
from pyspark.sql import functions as F

from clausework.operators import ranking
from clausework.plans import registry
from tests.conftest import DATA, assert_like_sql

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_sql(spark, name):
    assert_like_sql(registry.queries()[name](spark, f"{DATA}/{SF}"), registry.oracle_sql()[name], SF)


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cosine_ranking_has_every_item_with_a_vector(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{SF}/{t}.parquet")
    want = {r[0] for r in read("benchmark").select("item_id").collect()} & {r[0] for r in read("embeddings").select("vec_id").collect()}
    got = registry.queries()["cosine_ranking"](spark, f"{DATA}/{SF}").groupBy("item_id").count().collect()
    assert {r["item_id"] for r in got} == want and {r["count"] for r in got} == {read("embeddings").count()}


def test_heading_shape_has_every_line(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/{SF}/documents.parquet").collect()}
    got = {(r["doc_id"], r["line"]) for r in registry.queries()["heading_shape"](spark, f"{DATA}/{SF}").collect()}
    assert got == {(i, n) for i, t in texts.items() for n in range(len(t.split("\n")))} and len(got) > len(texts)


def test_checks_have_something_to_find(spark):
    for name in ("list_faults", "vector_check"):
        assert registry.queries()[name](spark, f"{DATA}/{SF}").count() > 0


def test_nothing_stays_cached(spark):
    registry.queries()["keyword_ranking"](spark, f"{DATA}/{SF}").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_copies_tie_at_every_digit(spark, tmp_path, monkeypatch):
    """hydrate_mapping ranks a copy behind its original, without rounding that hides the last digits."""
    docs = spark.read.parquet(f"{DATA}/{SF}/documents.parquet")
    docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(ranking, "ranked_in_parts", partial(ranking.ranked_in_parts, digits=17))
    rank = {(r["item_id"], r["chunk_id"]): r["rank"] for r in registry.queries()["hydrate_mapping"](spark, str(tmp_path)).collect()}
    assert len(rank) == 2 * docs.count() * spark.read.parquet(f"{tmp_path}/benchmark.parquet").count()
    assert all(rank[i, k] < rank[i, k + 10_000] for i, k in rank if k < 10_000)
