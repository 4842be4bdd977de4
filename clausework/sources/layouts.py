"""Layouts from Parquet or JSON in explicit schemas, and from PDFs where a reader is installed."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions.text import strip
from clausework.schemas import schema

MOST_BYTES = 200 * 1024 * 1024


def read_layout(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A layout table (spans, pages, raw_tables, checklist_lines) in its schema."""
    return spark.read.schema(schema(table)).format(fmt).load(path)


def check_upload(spark: SparkSession, path: str) -> None:
    """ValueError unless path is one non-empty PDF of at most MOST_BYTES."""
    rows = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 5).cast("string").alias("head")).limit(2).collect()
    if len(rows) != 1 or not path.lower().endswith(".pdf") or not rows[0]["length"]:
        raise ValueError("one non-empty PDF is wanted")
    if rows[0]["length"] > MOST_BYTES:
        raise ValueError("the PDF is too large")


def _from_pdfs(spark: SparkSession, path: str, table: str, readers: tuple[str, ...], rows_of: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """A layout table of the PDFs at path: one call of rows_of(name, content) for each. The readers must be installed on the executors."""
    missing = [r for r in readers if importlib.util.find_spec(r) is None]
    if missing:
        raise ModuleNotFoundError(f"reading PDFs needs {', '.join(missing)}; layouts can be read as Parquet or JSON without it")
    want = schema(table)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(rows_of(name, content), columns=want.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, want)


def pdf_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of PDFs: text blocks only, lines without spans left out. Needs PyMuPDF."""

    def rows_of(name: str, content: bytes) -> list[tuple]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as pdf:
            return [
                (name, page.number + 1, b["number"], ln, sn, s["text"], s["font"], s["flags"], float(s["size"]), [float(x) for x in s["bbox"]])
                for page in pdf
                for b in page.get_text("dict")["blocks"]
                if b["type"] == 0
                for ln, line in enumerate(b["lines"])
                for sn, s in enumerate(line["spans"])
            ]

    return _from_pdfs(spark, path, "spans", ("fitz",), rows_of)


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDFs with their heights and numbers of images. Needs pdfplumber and PyMuPDF."""

    def rows_of(name: str, content: bytes) -> list[tuple]:
        import fitz
        import pdfplumber

        with fitz.open(stream=content, filetype="pdf") as pdf, pdfplumber.open(io.BytesIO(content)) as plumbed:
            return [(name, n, float(p.height), len(page.get_images(full=True))) for n, (page, p) in enumerate(zip(pdf, plumbed.pages), 1)]

    return _from_pdfs(spark, path, "pages", ("fitz", "pdfplumber"), rows_of)


def pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """Tables of PDFs as they stand on their pages, headers among them; what lies around them is left to tables.with_page_facts. Needs pdfplumber."""

    def rows_of(name: str, content: bytes) -> list[tuple]:
        import pdfplumber

        floats = lambda box: None if box is None else [float(x) for x in box]
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            found = [(n, t, t.extract()) for n, page in enumerate(pdf.pages, 1) for t in page.find_tables()]
        found = [(n, t, rows) for n, t, rows in found if rows]
        return [(name, k, n, floats(t.bbox), rows, [[floats(c) for c in r.cells] for r in t.rows], len(rows[0]), None, None) for k, (n, t, rows) in enumerate(found)]

    return _from_pdfs(spark, path, "raw_tables", ("pdfplumber",), rows_of)


def checklist_lines(spans: DataFrame) -> DataFrame:
    """Lines of a checklist's spans: left and top edge, largest size, bold if all that isn't blank is."""
    bold = F.lower("font").contains("bold") | (F.col("flags").bitwiseAND(16) != 0)
    s = F.struct("span_no", "text", bold.alias("bold"), "font_size", "bbox")
    lines = spans.groupBy("source_pdf", "page", "block_no", "line_no").agg(F.sort_array(F.collect_list(s)).alias("s"))
    shown = F.filter("s", lambda x: strip(x["text"]) != "")
    lines = lines.withColumn("shown", shown).where(F.size("shown") > 0)
    return lines.select(
        F.col("source_pdf").alias("checklist"), "page", (F.col("block_no") * 10_000 + F.col("line_no")).cast("int").alias("line_ord"),
        F.array_min(F.transform("s", lambda x: x["bbox"][1])).alias("y0"), F.array_min(F.transform("s", lambda x: x["bbox"][0])).alias("x0"),
        F.forall("shown", lambda x: x["bold"]).alias("bold"), F.array_max(F.transform("shown", lambda x: x["font_size"])).alias("size"),
        strip(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text"),
    )
