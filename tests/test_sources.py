"""Catalog, layouts and encoder."""

from __future__ import annotations

import numpy as np
import pytest

from clausework.functions.encoder import with_embeddings
from clausework.schemas import SCHEMAS, schema
from clausework.sources import layouts
from clausework.sources.catalog import Catalog


def test_schemas_are_well_formed(spark):
    assert all(schema(t).names for t in SCHEMAS)


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    old = spark.createDataFrame([("m.pdf", 1, 800.0, 0)], schema("pages"))
    c.write("pages", old)
    from pyspark.sql import functions as F

    bad = old.withColumn("height", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        c.write("pages", bad)
    assert c.read("pages").collect() == old.collect()
    c.write("pages", old.union(old))
    assert c.read("pages").count() == 2
    c.export_json("pages", str(tmp_path / "json"))
    assert layouts.read_layout(spark, str(tmp_path / "json"), "pages", "json").count() == 2
    c.clear()
    assert not c.exists("pages")
    with pytest.raises(LookupError):
        c.path("nothing")


def test_rankings_are_partitioned(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = [("A", "i", v, "c", 1, 0.5, None) for v in ("keyword", "both")]
    c.write("rankings", spark.createDataFrame(rows, schema("rankings")))
    plan = c.read("rankings").where("view = 'both'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(view" in plan


def test_uploads_are_checked(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"text")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 x")
    for name in ("a.txt", "b.pdf"):
        with pytest.raises(ValueError):
            layouts.check_upload(spark, str(tmp_path / name))
    layouts.check_upload(spark, str(tmp_path / "c.pdf"))


def test_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(20)] + [(99, None)], "i int, text string")

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = with_embeddings(df, load, batch=3).collect()
    assert len(got) == 21 and all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in got)
    assert with_embeddings(df.where("i < 0"), load).count() == 0


FITZ = '''
import json

class Page:
    def __init__(self, n, page):
        self.number, self.page = n, page
    def get_text(self, kind):
        return {"blocks": [{"type": 1, "number": 0}] + self.page["blocks"]}
    def get_images(self, full):
        return [0] * self.page["images"]

class Pdf(list):
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass

def open(stream, filetype):
    return Pdf(Page(n, p) for n, p in enumerate(json.loads(stream[5:])))
'''
PDFPLUMBER = '''
import json

class Row:
    def __init__(self, cells):
        self.cells = cells

class Table:
    def __init__(self, t):
        self.bbox, self.cells, self.rows = t["bbox"], t["rows"], [Row([None if c is None else t["bbox"] for c in r]) for r in t["rows"]]
    def extract(self):
        return self.cells

class Page:
    def __init__(self, page):
        self.height, self.tables = page["height"], page["tables"]
    def find_tables(self):
        return [Table(t) for t in self.tables]

class Pdf:
    def __init__(self, pages):
        self.pages = pages
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass

def open(f):
    return Pdf([Page(p) for p in json.loads(f.read()[5:])])
'''


def test_pdfs_are_read_where_readers_are_installed(spark, tmp_path):
    """Stand-ins for the readers, with the calls that are made of them, give pages that are stated as JSON."""
    import json

    from clausework.api import Engine

    for name, text in (("fitz.py", FITZ), ("pdfplumber.py", PDFPLUMBER)):
        (tmp_path / name).write_text(text)
        spark.sparkContext.addPyFile(str(tmp_path / name))

    def block(n, y, text, bold=False):
        return {"type": 0, "number": n, "lines": [{"spans": [{"text": text, "font": "F-Bold" if bold else "F", "flags": 0, "size": 9.0, "bbox": [50.0, y, 300.0, y + 10]}]}, {"spans": []}]}

    header = {"bbox": [0, 0, 600, 80], "rows": [["DOCUMENT NAME", "Manual", "DOCUMENT NO.", "QM-1"], ["PAGE NO.", "Page 1 of 2", None, ""]]}
    table = {"bbox": [50, 200, 300, 260], "rows": [["Who", "What"], ["A", "B"]]}
    pages = [
        {"height": 800, "images": 1, "blocks": [block(1, 20.0, "inside the header"), block(2, 120.0, "1 Scope", True), block(3, 150.0, "Applies to all."), block(4, 210.0, "A B"), block(5, 750.0, "Page 1 of 2")], "tables": [header, {"bbox": [0, 0, 1, 1], "rows": []}, table]},
        {"height": 700, "images": 0, "blocks": [block(1, 120.0, "2 Terms", True), block(2, 150.0, "Words.")], "tables": []},
    ]
    (tmp_path / "m.pdf").write_bytes(b"%PDF-" + json.dumps(pages).encode())
    engine = Engine(spark, str(tmp_path / "space"))
    assert engine.ingest_pdf(str(tmp_path / "m.pdf")) == {"subdocuments": 1, "chunks": 2}
    chunks = engine.catalog.read("chunks").orderBy("chunk_ord").collect()
    assert [c["text"] for c in chunks] == ["1 Scope\nApplies to all.\nWho | What\nA | B", "2 Terms\nWords."]
    got = layouts.pdf_pages(spark, str(tmp_path / "m.pdf")).orderBy("page").collect()
    assert [(r["page"], r["height"], r["image_count"]) for r in got] == [(1, 800.0, 1), (2, 700.0, 0)]


def test_faulty_lists_are_not_published(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    rows = spark.createDataFrame([("A", "i", "both", "c", 1, 0.5, None)], schema("rankings"))
    c.write("rankings", rows)

    def refuse(df):
        raise ValueError(f"{df.count()} faulty")

    with pytest.raises(ValueError, match="2 faulty"):
        c.write("rankings", rows.union(rows), check=refuse)
    assert c.read("rankings").count() == 1
