"""Cleaning of layouts: headers, subdocuments, tables, blocks; and a whole workspace."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.api import Engine
from clausework.functions import text as X
from clausework.operators import checklist, clean, quality
from clausework.operators import tables as T
from clausework.plans import ingest, reports
from clausework.schemas import schema

HEADER = [["DOCUMENT\nNAME", "Manual", "DOCUMENT NO.", "QM-1"], ["REVISION", "2", "PAGE NO.", "Page 1 of 3"]]


def span(text, page, block, line, y0, x0=50.0, font="Arial", size=10.0, n=0, h=10.0):
    return ("m.pdf", page, block, line, n, text, font, 0, size, [x0, y0, x0 + 100, y0 + h])


def raw(page, ord_, rows, box, cells=None):
    cells = cells or [[[box[0] + 50 * c, box[1], box[0] + 50 * c + 40, box[3]] for c in range(len(r))] for r in rows]
    return ("m.pdf", ord_, page, box, rows, cells, len(rows[0]) if rows else 0, None, None)


@pytest.fixture(scope="module")
def layout(spark):
    spans = [
        span("stray", 1, 0, 0, 300.0),
        span("DOCUMENT NAME", 2, 0, 0, 60.0),
        span("1 Scope", 2, 1, 0, 150.0, font="Arial-Bold"), span("Applies to all.", 2, 2, 0, 170.0), span("Page 2 of 5", 2, 3, 0, 780.0),
        span("in table", 2, 4, 0, 610.0),
        span("2 Terms", 3, 0, 0, 300.0, font="Arial-Bold"), span("Word", 3, 1, 0, 320.0), span("s are", 3, 1, 0, 320.0, x0=160.0, n=1), span("meant.", 3, 1, 1, 335.0),
        span("Organisation", 4, 0, 0, 200.0, font="Arial-Bold"),
        span("Form A", 5, 0, 0, 50.0, font="Arial-Bold"), span("Document Number: F-9", 5, 0, 1, 60.0), span("Revision Number 3 Approved by Q", 5, 0, 2, 70.0),
        span("FORM", 5, 1, 0, 200.0, font="Arial-Bold"),
    ]
    pages = [("m.pdf", p, 800.0, 1 if p == 4 else 0) for p in range(1, 6)]
    tables = [
        raw(1, 0, [["x", "y"]], [50.0, 350.0, 150.0, 380.0]),
        raw(2, 1, HEADER, [40.0, 40.0, 500.0, 100.0]),
        raw(2, 2, [["Who", "What"], ["A", "B"]], [50.0, 600.0, 150.0, 720.0]),
        raw(3, 3, [["C", None]], [52.0, 60.0, 149.0, 100.0]),
        raw(3, 4, [["h", "empty"], ["a", " "]], [50.0, 500.0, 150.0, 530.0]),
    ]
    return spark.createDataFrame(spans, schema("spans")), spark.createDataFrame(pages, schema("pages")), spark.createDataFrame(tables, schema("raw_tables"))


@pytest.fixture(scope="module")
def stored(spark, layout, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("workspace")))
    assert engine.status() == {"status": "none"}
    with pytest.raises(LookupError):
        engine.build_index(spark.createDataFrame([], schema("items")))
    assert engine.ingest(*layout) == {"subdocuments": 2, "chunks": 3}
    return engine


def test_headers_and_subdocuments(layout, stored):
    made = {"subdocuments": stored.catalog.read("subdocuments"), "report": ingest.parse(*layout)["report"]}
    subs = {r["subdoc_idx"]: r for r in made["subdocuments"].collect()}
    assert (subs[0]["doc_id"], subs[0]["doc_name"], subs[0]["revision"], subs[0]["doc_relative_page_span"]) == ("QM-1", "Manual", "2", "1 of 3")
    assert (subs[0]["pdf_page_start"], subs[0]["pdf_page_end"], subs[0]["header_template"]) == (2, 4, "standard_table")
    assert (subs[1]["doc_id"], subs[1]["doc_name"], subs[1]["revision"], subs[1]["approved_by"]) == ("F-9", "Form A", "3", "Q")
    report = made["report"].first()
    assert (report["subdocument_count"], report["standard_table"], report["form_freetext"], report["doc_ids"]) == (2, 1, 1, ["QM-1", "F-9"])
    assert report["header_absent_pages"] == [1, 3, 4]


def test_tables_are_stitched_filtered_and_logged(stored):
    kept = stored.catalog.read("tables").collect()
    assert [(r["table_id"], r["page_start"], r["page_end"], r["rows"]) for r in kept] == [("QM-1__t01", 2, 3, [["Who", "What"], ["A", "B"], ["C", None]])]
    log = sorted((r["page"], r["rule"]) for r in stored.catalog.read("removal_log").collect())
    assert log == [(1, "before_first_header"), (3, "empty_table"), (4, "diagram_only_page")]


def test_blocks_chunks_and_coverage(layout, stored):
    made = {t: stored.catalog.read(t) for t in ("blocks", "chunks", "events")}
    blocks = {r["block_id"]: r["text"] for r in made["blocks"].collect()}
    assert blocks["QM-1__p002_b001"] == "1 Scope" and not any("Page 2" in t or "table" in t or "stray" in t for t in blocks.values())
    chunks = made["chunks"].orderBy("chunk_ord").collect()
    assert [c["chunk_id"] for c in chunks] == ["QM-1__c001", "QM-1__c002", "F-9__c001"]
    assert chunks[0]["text"] == "1 Scope\nApplies to all.\nWho | What\nA | B\nC | " and chunks[0]["table_ids"] == ["QM-1__t01"]
    assert "Words are" in chunks[1]["text"]
    cover = quality.coverage(made["events"], ingest.parse(*layout)["rows"]).first()
    assert cover["unaccounted"] == 0 and cover["bucket_a"] + cover["bucket_b"] + cover["bucket_d"] == cover["total_raw_lines"]
    assert cover["n_tables_attached"] == cover["n_tables_total"] == 1
    assert quality.missing_text(made["events"], made["chunks"].withColumn("source_pdf", F.lit("m.pdf"))).isEmpty()


def verdicts(spark, tables):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, rows array<array<string>>")
    return [r["v"]["verdict"] for r in df.select("i", T.verdict(F.col("rows"), F.size(F.col("rows")[0])).alias("v")).orderBy("i").collect()]


def test_g27_verdicts(spark):
    assert verdicts(spark, [[["h", "k"], ["a", ""], ["b", None]], [["", None]], [["h", "x"]], [["h", "x"], ["a", "b"]]]) == ["DISCARD", "DISCARD", "KEEP", "KEEP"]


def test_g26_slivers(spark):
    cells = [[[0.0, 0.0, 50.0, 1.0], [50.0, 0.0, 55.0, 1.0], [55.0, 0.0, 90.0, 1.0]]] * 3
    df = spark.createDataFrame(
        [(1, 3, [["h", "x", "k"], ["a", "", "b"], ["c", None]], cells), (2, 3, [["h", "x", "k"], ["a", "q", "b"], ["c", None, "d"]], cells)],
        "i int, ncols int, rows array<array<string>>, cell_bboxes array<array<array<double>>>",
    )
    got = {r["i"]: (r["rows"], r["dropped_cols"]) for r in T.without_slivers(df).collect()}
    assert got[1] == ([["h", "k"], ["a", "b"], ["c", None]], [2]) and got[2][1] == []


def test_g24_g25_stitching(spark):
    def one(gap, below=False, y=60.0, x=50.0, page=2):
        a = ("p", 0, 1, [50.0, 100.0, 150.0, 700.0], [["a"]], [[None]], 1, below, gap)
        b = ("p", 1, page, [x, y, 150.0, 200.0], [["b"]], [[None]], 1, False, 300.0)
        return T.stitch(spark.createDataFrame([a, b], schema("raw_tables"))).count()

    assert one(91.0) == 1
    assert [one(120.0), one(90.0, below=True), one(90.0, y=150.0), one(90.0, x=65.0), one(90.0, page=3)] == [2] * 5


def test_segment_repeats_and_missing_ids(spark):
    pages = spark.createDataFrame([("p", i) for i in range(1, 7)], "source_pdf string, page int")
    heads = spark.createDataFrame([("p", 2, "A", "x"), ("p", 3, "A", "x"), ("p", 4, "A", "y"), ("p", 5, None, "y"), ("p", 6, None, "y")], "source_pdf string, page int, doc_id string, doc_name string")
    got = [(r["page"], r["subdoc_idx"], r["is_start"]) for r in clean.segment(pages, heads).orderBy("page").collect()]
    assert got == [(1, -1, False), (2, 0, True), (3, 0, False), (4, 1, True), (5, 2, True), (6, 3, True)]


def lines(spark, rows):
    return spark.createDataFrame([("AQB", p, i, y, x, b, s, t) for i, (p, y, x, b, s, t) in enumerate(rows)], schema("checklist_lines"))


CHECKLIST = [
    (1, 10.0, 40.0, True, 11.0, "DOCUMENT NAME"), (1, 11.0, 200.0, False, 11.0, "value"), (1, 30.0, 40.0, True, 14.0, "TITLE"), (1, 800.0, 40.0, False, 9.0, "Page 1 of 2"),
    (1, 40.0, 120.0, False, 10.0, "before anything"),
    (1, 50.0, 40.0, True, 10.0, "8. Consistency"), (1, 60.0, 40.0, False, 10.0, "4.2.5.2"), (1, 61.0, 120.0, False, 10.0, "First question?"),
    (1, 90.0, 120.0, False, 10.0, "Second question?"), (1, 100.0, 120.0, False, 10.0, "2 years of it"),
    (2, 50.0, 40.0, True, 10.0, "9 Records"), (2, 60.0, 40.0, False, 10.0, "9.1 Keep them."), (2, 90.0, 120.0, False, 10.0, "2 more years"), (2, 95.0, 40.0, False, 10.0, "9.1 Again"),
]


def test_g30_to_g32_checklist(spark):
    rows = checklist.grouped_rows(checklist.without_margins(lines(spark, CHECKLIST)))
    got = [(r["item_id"], r["text"], [p["clause_no"] for p in r["ancestor_path"]]) for r in checklist.items(rows).orderBy("item_ord").collect()]
    assert got == [
        ("AQB__4.2.5.2", "First question?", ["8"]), ("AQB__4.2.5.2#2", "Second question?\n2 years of it", ["8"]),
        ("AQB__9.1", "Keep them.\n2 more years", ["9"]), ("AQB__9.1#2", "Again", ["9"]),
    ]
    assert [r["text"] for r in checklist.orphans(rows).collect()] == ["before anything"]
    report = checklist.parse_report(rows).first()
    assert (report["n_headings"], report["n_items_raw"], report["n_items_final"], report["n_synthesized_paragraph_splits"]) == (2, 3, 4, 1)


def test_g33_unclear_columns_are_an_error(spark):
    near = [(1, 10.0 * i, 40.0 + 10 * (i % 2), False, 10.0, f"{i} x") for i in range(1, 5)]
    for rows in (near, near[:1]):
        with pytest.raises(Exception, match="numbered rows|column gap"):
            checklist.items(checklist.grouped_rows(lines(spark, rows))).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([(" a \n b ", "É1 İx_y z9", "(x)")], "c string, t string, p string")
    r = df.select(X.normalize_cell(F.col("c")).alias("c"), X.tokens(F.col("t")).alias("t"), X.is_parenthetical(F.col("p")).alias("p")).first()
    import re

    assert r["c"] == "a b" and r["t"] == re.findall("[a-z0-9]+", "É1 İx_y z9".lower()) and r["p"]


def test_workspace(spark, stored):
    engine = stored
    assert engine.status() == {"status": "uploaded"}
    items = engine.parse_checklists(lines(spark, CHECKLIST))

    def load():
        def encode(texts):
            return np.array([[len(t), t.count("e"), t.count("r"), 1.0] for t in texts], np.float32)

        return encode

    n = engine.catalog.read("chunks").count()
    assert engine.build_index(items, load)["n_chunks"] == n
    assert engine.status()["status"] == "indexed"
    rankings = engine.catalog.read("rankings")
    assert quality.list_faults(rankings, n).isEmpty()
    assert rankings.where("view = 'both'").agg(F.max("score")).first()[0] <= round(2 / 61, 6)
    got = engine.mapping("aqb", "AQB__9.1")
    assert got.count() == 3 * n and got.where("text IS NULL").isEmpty()
    with pytest.raises(LookupError):
        engine.mapping("AQB", "nothing")
    assert {r["item_count"] for r in engine.checklists().collect()} == {4}
    assert engine.items("aqb").count() == 4
    assert math.isclose(engine.catalog.read("gate").first()["min_high_idf_terms"], 1)


def test_reports(layout, stored):
    made = ingest.parse(*layout)
    text = reports.empty_tables(made["judged"], stored.catalog.read("removal_log")) + reports.diagram_pages(made["diagrams"])
    assert "| m.pdf | 3 | 2 | 1 |" in text and "| m.pdf | 5 | 1 |" in text
    assert "2.00 s" in reports.summary({"index": 2.0}, {"chunks": 3})
