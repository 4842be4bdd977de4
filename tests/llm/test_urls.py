from __future__ import annotations

from pyspark.sql import functions as F

from clausework.llm import registry, urls
from tests.conftest import DATA, TABLES, assert_like_sql, rows_of

PAGES = "page_id long, url string, html string, host string, node string, rule int"


def canonical(href):
    return f'<html><HEAD><link rel="stylesheet" href="x.css"><LINK href=\'{href}\' rel="canonical"></html>'


def refresh(href):
    return f'<meta charset="utf-8"><meta http-equiv="Refresh" content="0; URL={href}">'


ROWS = [
    (1, "http://EXAMPLE.com/en/1", None), (2, "https://www.example.com/en/x?q#f", ""), (3, "http://a.b.com/", None), (4, "http://a.b.com", None), (5, "http://x.net/es/1", None), (6, "nothing", None), (7, None, canonical("http://x.net/es/1")),
    (8, "http://badexample.com/en/", None), (9, "ftp://com/", None), (10, "http://É.NET/fr/#a", None), (11, "http://x.net?/es/", None),
    # a chain of aliases of a blocked address, and one that an allowed address belongs to
    (20, "http://alias.org/a", canonical("http://alias.org/b")), (21, "http://ALIAS.org/b#top", refresh("//other.org/c?x=1&amp;y=2")), (22, "http://other.org/c?x=1&y=2", refresh("http://x.net/es/1")),
    (30, "http://p.org/a", canonical("http://x.net/fr/2")), (31, "http://p.org/b", canonical("/a")), (32, "http://p.org/d/e", refresh("../a")), (33, "http://p.org/d/f", canonical("g")), (34, "http://p.org/d/g", canonical("http://www.example.com/en/z")),
    (35, "http://p.org/d/h", canonical("http://p.org/d/g")), (36, "http://p.org/d/h", canonical("http://x.net/es/9")),
    (50, "http://q.org/1/../2?x", canonical("./3/./..")), (51, "http://q.org/", refresh("http://x.net/es/..")), (52, "http://q.org/2/", canonical("../../../k/../..//m")), (53, "http://q.org//m", canonical("http://x.net/fr/./1/.")),
    (40, "http://loop.org/", canonical("http://loop.org/")), (20, "http://alias.org/a", canonical("http://alias.org/b")),
]


def test_rules_and_aliases(spark):
    df = spark.createDataFrame([(*r, "clash", "clash", 0) for r in ROWS], PAGES)
    got = urls.judge(df).collect()
    assert len(got) == len(ROWS)
    by_id = {r["page_id"]: r for r in got}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in by_id.items() if i < 20} == {
        1: ("example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 3: ("a.b.com", "/", "com/", "allow"), 4: ("a.b.com", "", None, "allow"),
        5: ("x.net", "/es/1", "net/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("badexample.com", "/en/", "com/", "allow"), 9: ("com", "/", "com/", "allow"),
        10: ("É.net", "/fr/", "net/fr/", "block"), 11: ("x.net", "", None, "allow"),
    }
    assert [by_id[i]["verdict"] for i in (20, 21, 22, 30, 31, 32)] == ["block"] * 6
    # one class with a blocked and an explicitly allowed address: the allow takes precedence
    assert [by_id[i]["verdict"] for i in (33, 34, 35, 36)] == ["allow"] * 4
    assert by_id[40]["verdict"] == "allow" and by_id[40]["alias_of_blocked"] is False
    assert urls.judge(df.where("page_id = 99")).count() == 0


def test_dot_segments_are_resolved(spark):
    paths = {"/a/../b": "/b", "/a/./b": "/a/b", "/../a": "/a", "/a/b/..": "/a/", "/a/b/.": "/a/b/", "/..": "/", "/.": "/", "/a..b/.c": "/a..b/.c", "/a//../b": "/a/b", "": "", "/a/b/../../c/": "/c/", "a/../b": "a/../b"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["q"] for r in df.select("p", urls.without_dots(F.col("p")).alias("q")).collect()} == paths


def test_redirect_log_adds_edges(spark):
    df = spark.createDataFrame([(1, "http://q.org/1", None, "", "", 0)], PAGES)
    log = spark.createDataFrame([("http://q.org/1", "http://q.org/2"), ("http://q.org/2", "http://y.net/fr/"), (None, "http://q.org/1")], "from_url string, to_url string")
    assert urls.judge(df, redirects=log).first()["verdict"] == "block"


def test_like_sql(spark):
    assert_like_sql(urls.op10_url_filters(spark, f"{DATA}/sf0.01"), registry.oracle_sql()["op10_url_filters"], "sf0.01")


def test_sql_says_the_same_of_aliases(spark):
    import duckdb

    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in df.collect()])
    found = c.execute(registry.oracle_sql()["op10_url_filters"])
    names = [d[0] for d in found.description]
    got = urls.judge(df).select(*names)
    assert "pages" in TABLES and rows_of(names, got.collect()) == rows_of(names, found.fetchall())
