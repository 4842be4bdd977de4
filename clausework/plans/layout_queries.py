"""Queries of the layout operators over layouts that are made of the driver's tables, and their DuckDB counterparts.

An order stands for a PDF or a page, its lines for spans, lines or tables; `n`
numbers them. Places, sizes and texts follow from the columns of lineitem.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import encoder
from clausework.functions import patterns as P
from clausework.functions import text as X
from clausework.operators import bm25, checklist, clean, outline, quality, serve
from clausework.operators import tables as T
from clausework.plans import index
from clausework.schemas import schema
from clausework.sources import layouts
from clausework.sources.scratch import stored

_SPANS = "array<struct<text:string,page:int,font_size:double,bold:boolean,bbox:array<double>>>"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ln(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"))


def _box(*edges) -> Column:
    return F.array(*((F.lit(float(e)) if isinstance(e, (int, float)) else e.cast("double")) for e in edges))


def _pdf() -> Column:
    return F.col("k").cast("string").alias("source_pdf")


def _shaped(df: DataFrame, table: str) -> DataFrame:
    """df in the schema of a layout table; columns that it hasn't are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("n"), F.col("q")
    return _ln(spark, sf_dir).select(
        _pdf(), (n % 2 + 1).alias("page"), F.floor((n - 1) / 4).cast("int").alias("block_no"), F.floor((n - 1) / 2).cast("int").alias("line_no"), n.alias("span_no"),
        F.when(F.col("f") == "N", " ").otherwise(F.concat(F.lit("w"), F.col("p").cast("string"), F.lit(" "))).alias("text"), F.when(F.col("f") == "R", "Arial-Bold").otherwise("Arial").alias("font"),
        F.when(F.col("f") == "A", 16 + F.col("p").cast("int") % 2).otherwise(4).alias("flags"), (q / 3).alias("font_size"), _box(n * 10, q, n * 10 + 8, q + 9).alias("bbox"),
    )


def span_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = clean.blocks_from_spans(_spans(spark, sf_dir))
    spans = F.flatten(F.transform("lines", lambda l: l["spans"]))
    return b.select(
        "source_pdf", "page", "block_no", F.array_join(F.transform("lines", lambda l: l["text"]), "/").alias("text"), F.col("bbox")[0].alias("x0"), F.col("bbox")[3].alias("y1"),
        F.size(F.filter(spans, lambda s: s["bold"])).alias("n_bold"), F.round(F.array_max(F.transform(spans, lambda s: s["font_size"])), 2).alias("size"),
    )


def checklist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layouts.checklist_lines(_spans(spark, sf_dir))
    return lines.select("checklist", "page", "line_ord", "y0", "x0", "bold", F.round("size", 4).alias("size"), "text")


def _header_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    kind, cell = F.col("o_custkey") % 4, lambda x: x if isinstance(x, Column) else F.lit(x)
    row = lambda *xs: F.array(*(cell(x).cast("string") for x in xs))
    rows = F.array(
        row("DOCUMENT\nNAME", F.concat(F.lit(" Name  of "), o), F.when(kind == 0, " Document  No.").otherwise("X"), F.concat(F.lit("N-"), c)),
        row("PAGE  NO.", F.concat(F.lit("page "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" of 9")), "REVISION", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string")))),
        F.when(kind == 1, row("DOCUMENT NO.", F.concat(F.lit("M-"), c), "document name", F.concat(F.lit("Later "), o))).otherwise(row("", None, None, "end")),
    )
    t = _read(spark, sf_dir, "orders").select(
        F.lit("orders").alias("source_pdf"), F.col("o_orderkey").cast("int").alias("page"), F.lit(1).alias("table_ord"), _box(0, 0, 600, 90).alias("bbox"),
        F.when(F.col("o_custkey") % 7 == 0, F.array(row("no", "header"))).otherwise(rows).alias("rows"),
    )
    return _shaped(t, "raw_tables")


def _form_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda n, x, y, text: F.struct(F.lit(n).alias("span_no"), _box(x, y, x + 90, y + 9).alias("bbox"), text.alias("text"))
    no = F.when(k % 5 == 0, F.concat(F.lit("Doc Number F-"), k.cast("string"))).when(k % 7 == 0, F.lit("Document Number : ")).otherwise(F.concat(F.lit("Document Number:  F-"), k.cast("string")))
    spans = F.array(
        s(1, 50, 60, F.concat(F.lit("approved BY : A"), k.cast("string"))), s(2, 300, 30, F.concat(F.lit("Revision Number "), (k % 7).cast("string"))), s(3, 50, 30, no),
        s(4, 50, 10, F.concat(F.lit(" Form of "), "c_name")), s(5, 50, 150, F.lit("Document Number: below the band")), s(6, 60, 80, F.lit("  ")),
    )
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.explode(spans).alias("s")).select(
        F.lit("forms").alias("source_pdf"), F.col("c_custkey").cast("int").alias("page"), F.lit(1).alias("block_no"), F.col("s.span_no").alias("line_no"), "s.*", F.lit("Arial").alias("font"),
        F.when((F.col("s.span_no") == 2) & (k % 3 != 0), 16).otherwise(0).alias("flags"), F.lit(9.0).alias("font_size"),
    )
    return _shaped(c, "spans")


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = clean.headers(_header_tables(spark, sf_dir), _form_spans(spark, sf_dir))
    return h.select("source_pdf", "page", "header_template", "doc_id", "doc_name", "revision", "doc_relative_page_span", "approved_by")


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on each order's page, with the order's lines below or above it; every sixth order has no first page."""
    ln, k = _ln(spark, sf_dir), F.col("k")
    spans = ln.select(_pdf(), (F.col("n") % 2 + 1).alias("page"), F.when(F.col("f") == "R", "Page 1 of 2").when(F.col("f") == "A", "  ").otherwise("text").alias("text"), _box(0, F.col("q") * 10, 9, F.col("q") * 10 + 9).alias("bbox"))
    of = ln.select("k").distinct()
    raw = of.select(_pdf(), F.lit(1).alias("table_ord"), (k % 2 + 1).alias("page"), _box(0, 100, 500, k % 200 + 200).alias("bbox"))
    pages = of.where(k % 6 != 0).select(_pdf(), F.lit(1).alias("page"), (k % 3 * 100 + 500).alias("height"))
    met = T.with_page_facts(_shaped(raw, "raw_tables"), _shaped(spans, "spans"), _shaped(pages, "pages"))
    return met.select("source_pdf", "page", "content_below", "gap_to_bottom")


def sliver_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    row = lambda *xs: F.array(*(x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string") for x in xs))
    rows = F.array(row("a", "b", "c"), row(p, F.when(p % 3 == 0, "x").when(p % 3 == 1, " "), F.when(p % 2 == 0, "z")), row(p))
    cells = F.array(*(F.array(_box(0, 0, 50, 9), F.when(F.lit(i == 1), _box(50, 0, F.col("p_size") % 20 + 50, 9)), _box(80, 0, F.when(p % 5 == 0, 85).otherwise(99), 9)) for i in range(3)))
    t = _read(spark, sf_dir, "part").select("p_partkey", F.lit(3).alias("ncols"), rows.alias("rows"), cells.alias("cell_bboxes"))
    d = T.without_slivers(t)
    return d.select("p_partkey", "ncols_before_filter", "ncols", F.array_join("dropped_cols", ",").alias("dropped"), F.array_join(T.serialize(F.col("rows")), "/").alias("rows"))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as PDFs of a page for each line; every third page from the second on has a header."""
    ln = _ln(spark, sf_dir)
    pages = ln.select(_pdf(), F.col("n").alias("page"), F.lit(800.0).alias("height"), (F.col("q").cast("int") % 3).alias("image_count"))
    heads = ln.where("n % 3 = 2").select(_pdf(), F.col("n").alias("page"), F.concat(F.lit("D"), (F.col("p") % 3).cast("string")).alias("doc_id"), F.lit("name").alias("doc_name"), F.lit("standard_table").alias("header_template"), _box(0, 0, 600, F.col("p") % 100 + 60).alias("bbox"))
    return clean.segment(_shaped(pages, "pages"), _shaped(heads, "headers"))


def subdocuments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = clean.subdocuments(_segmented(spark, sf_dir))
    return s.select("source_pdf", "subdoc_idx", "doc_id", "doc_name", "pdf_page_start", "pdf_page_end")


def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = clean.extraction_report(_segmented(spark, sf_dir))
    return r.select("source_pdf", "subdocument_count", "standard_table", F.array_join("doc_ids", ",").alias("doc_ids"), F.size("header_absent_pages").alias("absent"))


def _cleaned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned blocks, segmented pages and raw tables: a page has a block of four lines, some of them in its header or table."""
    ln, segmented = _ln(spark, sf_dir), _segmented(spark, sf_dir)
    line = lambda i: F.struct(
        F.when((F.col("f") == "R") & F.lit(i == 3), "Page 1 of 2").when((F.col("f") == "A") & F.lit(i == 1), " ").otherwise(F.concat(F.lit(f"line {i} of "), F.col("p").cast("string"))).alias("text"),
        _box(F.col("q"), i * 230 + F.col("q"), F.col("q") + 50, i * 230 + F.col("q") + 9).alias("bbox"), F.array().cast(_SPANS).alias("spans"),
    )
    blocks = ln.select(_pdf(), F.col("n").alias("page"), F.lit(1).alias("block_no"), _box(0, 0, 100, 800).alias("bbox"), F.array(*map(line, range(4))).alias("lines"))
    raw = _shaped(ln.where("f = 'N'").select(_pdf(), F.lit(1).alias("table_ord"), F.col("n").alias("page"), _box(0, 200, 60, 500).alias("bbox"), F.array(F.array(F.lit("cell"))).alias("rows")), "raw_tables")
    pages = _shaped(ln.select(_pdf(), F.col("n").alias("page"), F.lit(800.0).alias("height")), "pages")
    return clean.page_blocks(blocks, segmented, raw, pages), segmented, raw


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _cleaned(spark, sf_dir)[0]
    return b.select("source_pdf", "page", "text", F.size("lines").alias("n_lines"), F.col("bbox")[3].alias("y1"))


def named_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, segmented, _ = _cleaned(spark, sf_dir)
    return clean.named_blocks(cleaned, segmented).select("source_pdf", "subdoc_idx", "block_ord", "block_id", "page")


def diagram_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, segmented, raw = _cleaned(spark, sf_dir)
    return clean.diagram_pages(cleaned, segmented, raw).select("source_pdf", "page", "doc_id", "remaining_blocks", "chars", "has_table", "diagram_only")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on each page; some go on over pages, some are empty."""
    ln, q = _ln(spark, sf_dir), F.col("q")
    rows = F.array(F.array(F.lit("h"), F.lit("i")), F.array(F.col("p").cast("string"), F.when(F.col("f") != "R", F.col("p").cast("string"))))
    raw = ln.select(
        _pdf(), F.col("n").alias("table_ord"), F.col("n").alias("page"), _box(10, F.col("p") % 200, 500, 700).alias("bbox"), rows.alias("rows"), F.lit(2).alias("ncols"),
        (F.col("f") == "A").alias("content_below"), (q * 4).alias("gap_to_bottom"), F.array(F.array(_box(10, 0, 50, 9), _box(50, 0, 90, 9))).alias("cell_bboxes"),
    )
    return clean.judged_tables(_shaped(raw, "raw_tables"), _segmented(spark, sf_dir))


def kept_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = clean.kept_tables(_judged(spark, sf_dir))
    return t.select("source_pdf", "subdoc_idx", "table_id", "page_start", "page_end", F.size("rows").alias("n_rows"), F.size("bbox_by_page").alias("n_boxes"))


def removal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, segmented, raw = _cleaned(spark, sf_dir)
    log = clean.removal_log(_judged(spark, sf_dir), clean.diagram_pages(cleaned, segmented, raw))
    return log.select("source_pdf", "page", F.coalesce(F.array_join(F.transform("pages", lambda x: x.cast("string")), ","), F.lit("")).alias("pages"), "rule", F.md5("detail").alias("detail_md5"))


def table_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.table_ranges(_judged(spark, sf_dir))


def checklist_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when((F.col("n") == 1) & (F.col("k") % 2 == 0), "REVISION").when(F.col("f") == "R", "Page 1 of 2").otherwise("text")
    lines = _ln(spark, sf_dir).select(F.col("k").cast("string").alias("checklist"), F.lit(1).alias("page"), F.col("n").alias("line_ord"), F.col("q").alias("y0"), (F.col("p") % 6 + 9).cast("double").alias("size"), text.alias("text"))
    return checklist.without_margins(lines).select("checklist", "line_ord", "text")


def checklist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _ln(spark, sf_dir).select(
        F.col("k").cast("string").alias("checklist"), F.lit(1).alias("page"), (F.col("q") / 2).alias("y0"), F.col("n").alias("line_ord"), (F.col("p") % 300).cast("double").alias("x0"), (F.col("f") != "A").alias("bold"), F.concat(F.lit("w"), F.col("n").cast("string")).alias("text"),
    )
    return checklist.grouped_rows(lines)


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("n"), F.col("q")
    word = F.concat(F.lit("w"), n.cast("string"))
    span = lambda x, text, bold: F.struct(text.alias("text"), F.lit(1).alias("page"), F.lit(9.0).alias("font_size"), bold.alias("bold"), _box(x, q / 2, x + 5, q / 2 + 9).alias("bbox"))
    spans = F.array(span(F.col("p") % 300, F.when(F.col("f") == "N", " ").otherwise(word), F.col("f") == "R"), span(F.col("p") % 300 + 400, F.lit(" "), F.lit(False)))
    line = F.struct("n", F.when(F.col("f") == "N", " ").otherwise(word).alias("text"), _box(0, q / 2, 9, q / 2 + 9).alias("bbox"), spans.alias("spans"))
    of = _ln(spark, sf_dir).groupBy("k", (F.floor((n - 1) / 6) + 1).cast("int").alias("block_ord")).agg(F.sort_array(F.collect_list(line)).alias("ls"))
    lines = F.transform("ls", lambda l: F.struct(l["text"].alias("text"), l["bbox"].alias("bbox"), l["spans"].alias("spans")))
    blocks = of.select(_pdf(), F.lit(0).alias("subdoc_idx"), "block_ord", F.concat(F.lit("b"), F.col("block_ord").cast("string")).alias("block_id"), F.lit(1).alias("page"), lines.alias("lines"))
    return outline.rows_of_blocks(blocks).select("source_pdf", "row_ord", "text", "all_bold", "block_id", "y0", "n_lines")


def clause_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.concat_ws(".", F.col("k").cast("string"), F.when(F.col("n") > 1, F.col("n").cast("string")), F.when(F.col("n") > 3, F.col("p").cast("string")))
    numbered = _ln(spark, sf_dir).withColumn("clause_no", no)
    return numbered.select("k", "n", X.clause_depth(F.col("clause_no")).alias("depth"), F.aggregate(X.clause_tuple(F.col("clause_no")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), X.top_level(F.col("clause_no")).alias("top"))


def viewer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewer's keys of chunks, and which of them show on a page; keys that several have are kept once."""
    end = F.col("n") + (F.col("p") % 3).cast("int")
    key = serve.chunk_key(F.concat(F.lit("D"), F.col("k").cast("string")), F.when(F.col("f") != "N", F.concat(F.lit("c"), (F.col("p") % 2).cast("string"))), F.col("n") % 2, end % 2)
    c = _ln(spark, sf_dir).select(key.alias("key"), F.col("n").alias("chunk_ord"), "k", serve.on_page(F.lit(3), F.col("n"), end).alias("on_page"))
    return serve.keep_last(c, ["key"])


def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored entries of one item of a checklist, whose name is given in another case."""
    ln = _ln(spark, sf_dir)
    e = ln.select(F.concat(F.lit("List"), (F.col("k") % 5).cast("string")).alias("checklist"), F.concat(F.lit("i"), (F.col("k") % 11).cast("string")).alias("item_id"), F.when(F.col("f") == "R", "keyword").otherwise("both").alias("view"), "k", "n")
    return serve.view_of(e, "LIST3", "i7", "keyword").select("checklist", "item_id", "k", "n")


def weak_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), F.col("doc_id").alias("chunk_id"), "text")
    tokenized = bm25.corpus(chunks)
    sparse = bm25.sparse_scores(_read(spark, sf_dir, "benchmark").select("item_id", "text"), tokenized, bm25.vocabulary(tokenized), bm25.fixed_gate(spark))
    return quality.weak_pairs(sparse).select("n_term_pass_pairs", F.round("below_min_score", 6).alias("below_min_score"))


def _vowels():
    """A small model for texts: how often five letters occur."""
    return lambda texts: np.array([[float(t.count(c)) for c in "aeiou"] for t in texts], np.float32).reshape(-1, 5)


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length of whole texts, from an injected model."""
    v = encoder.with_embeddings(_read(spark, sf_dir, "documents").select("doc_id", "text"), _vowels)
    return v.select("doc_id", *(F.round(F.col("embedding")[i].cast("double"), 4).alias(c) for i, c in enumerate("aeiou")))


def ranking_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries of all three views: every item of the benchmark that has a vector, every document that has one."""
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_ord"), F.col("doc_id").alias("chunk_id"), "text").join(v, "id").drop("id")
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "item_id", F.lit("B").alias("checklist"), "text").join(v, "id").drop("id")
    index.check_items(items)
    tokenized = stored(bm25.corpus(chunks))
    vocab = stored(bm25.vocabulary(tokenized))
    return index.rank_views(items, chunks, bm25.fixed_gate(spark), tokenized, vocab, tokenized.count()).withColumn("score", F.floor(F.col("score") * 100 + 1e-7))


_QUERIES = (
    span_blocks, checklist_lines, page_headers, page_facts, sliver_columns, subdocuments, extraction_report, page_blocks, named_blocks, diagram_pages, kept_tables, removal_log, table_ranges,
    checklist_margins, checklist_rows, block_rows, clause_depths, viewer_keys, mapping_lookup, weak_pairs, text_vectors, ranking_views,
)

# --- DuckDB ---------------------------------------------------------------

_LN = "ln AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS n, l_quantity AS q, l_partkey AS p, l_returnflag AS f FROM lineitem)"
_SP = f"""{_LN}, sp AS (SELECT k, n, n % 2 + 1 AS page, (n - 1) // 4 AS block_no, (n - 1) // 2 AS line_no, CASE WHEN f = 'N' THEN ' ' ELSE 'w' || p || ' ' END AS text, f = 'R' OR f = 'A' AS bold, f = 'R' OR (f = 'A') AS b2, q, round_even(q / 3, 2) AS size, q / 3 AS raw FROM ln)"""
_SEG = f"""{_LN}, hd AS (SELECT k, n, 'D' || (p % 3) AS id, lag('D' || (p % 3)) OVER (PARTITION BY k ORDER BY n) AS before FROM ln WHERE n % 3 = 2),
seg AS (SELECT ln.k, ln.n, ln.q, ln.p, ln.f, hd.k IS NOT NULL AS has, coalesce(hd.id IS DISTINCT FROM before, false) AND hd.k IS NOT NULL AS start, id FROM ln LEFT JOIN hd ON hd.k = ln.k AND hd.n = ln.n),
cur AS (SELECT *, (sum(start::INT) OVER w - 1)::INT AS sub, last_value(CASE WHEN start THEN id END IGNORE NULLS) OVER w AS doc FROM seg WINDOW w AS (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING))"""
_CL = f"""{_SEG}, cl AS (SELECT *, list_filter([{', '.join(f"CASE WHEN f = 'R' AND {i} = 3 AND 800 - ({i} * 230 + q + 9) BETWEEN 0 AND {P.FOOTER_BAND} THEN NULL WHEN f = 'A' AND {i} = 1 THEN NULL WHEN has AND q + 25 <= 600 AND {i} * 230 + q + 4.5 <= p % 100 + 60 THEN NULL WHEN f = 'N' AND q + 25 <= 60 AND {i} * 230 + q + 4.5 BETWEEN 200 AND 500 THEN NULL WHEN f = 'R' AND {i} = 3 THEN 'Page 1 of 2' ELSE 'line {i} of ' || p END" for i in range(4))}], lambda x: x IS NOT NULL) AS ls FROM cur)"""
_DG = f"""{_CL}, dg AS (SELECT k, n, doc, (len(ls) > 0)::INT AS blocks, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::BIGINT AS chars, f = 'N' AS tab, q::INT % 3 AS images, array_to_string(ls, ' ') AS heading FROM cl)"""
_FLAG = f"NOT tab AND images >= 1 AND blocks <= {P.DIAGRAM_BLOCKS} AND chars <= {P.DIAGRAM_CHARS}"
_JD = f"""st AS (SELECT *, CASE WHEN n > 1 AND lag(f) OVER w <> 'A' AND lag(q) OVER w * 4 < {P.STITCH_GAP} AND p % 200 < {P.STITCH_TOP} THEN 0 ELSE 1 END AS new FROM ln WINDOW w AS (PARTITION BY k ORDER BY n)),
sn AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM st),
tb AS (SELECT k, s, min(n) AS a, max(n) AS z, list(n ORDER BY n) AS pages, 2 * count(*) AS n_rows, count(*) AS boxes,
  list(['h', p::VARCHAR] ORDER BY n) AS unused, bool_or(f <> 'R') OR count(*) > 1 AS last FROM sn GROUP BY k, s),
jd AS (SELECT tb.*, sub, doc, CASE WHEN last THEN 'KEEP' ELSE 'DISCARD' END AS verdict, CASE WHEN last THEN 'has content' ELSE 'rightmost column blank on every data row' END AS reason FROM tb JOIN cur ON cur.k = tb.k AND cur.n = tb.a)"""
_FOOTER = P.FOOTER.replace("'", "''")
_TAKE = "trim(regexp_extract(j, '(?i){}\\s*:?\\s*(.*?)(?:{}|$)', 1))"


def _take(label: str) -> str:
    return _TAKE.format(label, "|".join(x for x in P.FORM_LABELS if x != label))


_SQL = {
    "span_blocks": f"""WITH {_SP}, l AS (SELECT k, page, block_no, line_no, string_agg(text, '' ORDER BY n) AS text, min(n * 10) AS x0, max(q + 9) AS y1, sum((bold OR b2)::INT) AS b, max(size) AS size FROM sp GROUP BY ALL)
SELECT k::VARCHAR AS source_pdf, page, block_no::INT AS block_no, string_agg(text, '/' ORDER BY line_no) AS text, min(x0)::DOUBLE AS x0, max(y1)::DOUBLE AS y1, sum(b)::INT AS n_bold, round(max(size), 2) AS size FROM l GROUP BY ALL""",
    "checklist_lines": f"""WITH {_SP}, l AS (SELECT *, trim(text) <> '' AS shown FROM sp)
SELECT k::VARCHAR AS checklist, page, (block_no * 10000 + line_no)::INT AS line_ord, min(q)::DOUBLE AS y0, min(n * 10)::DOUBLE AS x0, bool_and(bold) FILTER (shown) AS bold, round(max(raw) FILTER (shown), 4) AS size, trim(string_agg(text, '' ORDER BY n)) AS text
FROM l GROUP BY k, page, block_no, line_no HAVING bool_or(shown)""",
    "page_headers": f"""WITH f AS (SELECT *, 'Form of ' || c_name || ' ' || CASE WHEN c_custkey % 5 = 0 THEN 'Doc Number F-' || c_custkey WHEN c_custkey % 7 = 0 THEN 'Document Number :' ELSE 'Document Number:  F-' || c_custkey END || ' Revision Number ' || (c_custkey % 7) || ' approved BY : A' || c_custkey AS j FROM customer)
SELECT 'orders' AS source_pdf, o_orderkey::INT AS page, 'standard_table' AS header_template, CASE o_custkey % 4 WHEN 0 THEN 'N-' ELSE 'M-' END || o_custkey AS doc_id, CASE o_custkey % 4 WHEN 0 THEN 'Name of ' ELSE 'Later ' END || o_orderkey AS doc_name,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'r' || (o_orderkey % 5) END AS revision, (o_orderkey % 9) || ' of 9' AS doc_relative_page_span, NULL AS approved_by FROM orders WHERE o_custkey % 4 < 2 AND o_custkey % 7 <> 0
UNION ALL SELECT 'forms', c_custkey::INT, 'form_freetext', {_take('Document Number')}, 'Form of ' || c_name, {_take('Revision Number')}, NULL, {_take('Approved by')} FROM f WHERE j LIKE '%Document Number%' AND c_custkey % 3 <> 0 AND {_take('Document Number')} <> ''""",
    "page_facts": f"""WITH {_LN}, low AS (SELECT k, n % 2 + 1 AS page, max(q * 10) AS y FROM ln WHERE f = 'N' GROUP BY ALL), o AS (SELECT DISTINCT k FROM ln)
SELECT o.k::VARCHAR AS source_pdf, (o.k % 2 + 1)::INT AS page, coalesce(y > o.k % 200 + 200, false) AS content_below, CASE WHEN o.k % 6 <> 0 THEN o.k % 3 * 100 + 500 - (o.k % 200 + 200) END::DOUBLE AS gap_to_bottom FROM o LEFT JOIN low ON low.k = o.k AND low.page = o.k % 2 + 1""",
    "sliver_columns": f"""WITH t AS (SELECT p_partkey AS p, p_size % 20 < {P.MIN_COLUMN_WIDTH} AND p_partkey % 3 <> 0 AS b, p_partkey % 5 = 0 AND p_partkey % 2 <> 0 AS c FROM part)
SELECT p AS p_partkey, 3 AS ncols_before_filter, 3 - b::INT - c::INT AS ncols, array_to_string(list_filter([CASE WHEN b THEN 2 END, CASE WHEN c THEN 3 END], lambda x: x IS NOT NULL), ',') AS dropped,
  'a' || CASE WHEN b THEN '' ELSE ' | b' END || CASE WHEN c THEN '' ELSE ' | c' END || '/' || p || CASE WHEN b THEN '' ELSE ' | ' || CASE p % 3 WHEN 0 THEN 'x' WHEN 1 THEN ' ' ELSE '' END END || CASE WHEN c THEN '' ELSE ' | ' || CASE WHEN p % 2 = 0 THEN 'z' ELSE '' END END
  || '/' || p || CASE WHEN b THEN '' ELSE ' | ' END || CASE WHEN c THEN '' ELSE ' | ' END AS rows FROM t""",
    "subdocuments": f"""WITH {_SEG}, s AS (SELECT *, max(n) OVER (PARTITION BY k) AS z FROM cur) SELECT k::VARCHAR AS source_pdf, sub AS subdoc_idx, id AS doc_id, 'name' AS doc_name, n AS pdf_page_start,
  coalesce(lead(n) OVER (PARTITION BY k ORDER BY n) - 1, z)::INT AS pdf_page_end FROM s WHERE start""",
    "extraction_report": f"""WITH {_SEG} SELECT k::VARCHAR AS source_pdf, count(*) FILTER (start) AS subdocument_count, count(*) FILTER (start) AS standard_table, coalesce(string_agg(CASE WHEN start THEN id END, ',' ORDER BY n), '') AS doc_ids, count(*) FILTER (NOT has)::INT AS absent FROM cur GROUP BY k""",
    "page_blocks": f"""WITH {_CL} SELECT k::VARCHAR AS source_pdf, n AS page, array_to_string(ls, ' ') AS text, len(ls)::INT AS n_lines, 800.0::DOUBLE AS y1 FROM cl WHERE len(ls) > 0""",
    "named_blocks": f"""WITH {_CL}, b AS (SELECT *, row_number() OVER (PARTITION BY k, sub ORDER BY n)::INT AS o FROM cl WHERE len(ls) > 0 AND doc IS NOT NULL)
SELECT k::VARCHAR AS source_pdf, sub AS subdoc_idx, o AS block_ord, doc || printf('__p%03d_b%03d', n, o) AS block_id, n AS page FROM b""",
    "diagram_pages": f"""WITH {_DG} SELECT k::VARCHAR AS source_pdf, n AS page, doc AS doc_id, blocks::BIGINT AS remaining_blocks, chars, tab AS has_table, {_FLAG} AS diagram_only FROM dg""",
    "kept_tables": f"""WITH {_SEG}, {_JD}, kt AS (SELECT *, row_number() OVER (PARTITION BY k, sub ORDER BY s) AS o FROM jd WHERE verdict = 'KEEP' AND sub >= 0)
SELECT k::VARCHAR AS source_pdf, sub AS subdoc_idx, doc || printf('__t%02d', o) AS table_id, a AS page_start, z AS page_end, n_rows::INT AS n_rows, boxes::INT AS n_boxes FROM kt""",
    "removal_log": f"""WITH {_DG}, {_JD}
SELECT k::VARCHAR AS source_pdf, a AS page, array_to_string(pages, ',') AS pages, CASE WHEN verdict = 'DISCARD' THEN 'empty_table' ELSE 'before_first_header' END AS rule,
  md5('doc_id=' || coalesce(doc, 'None') || ' table pp.' || a || '-' || z || ': ' || reason || ' (ncols_before_filter=2, ncols_after_filter=2, dropped_cols=[])') AS detail_md5 FROM jd WHERE verdict = 'DISCARD' OR sub < 0
UNION ALL SELECT k::VARCHAR, n, '', 'diagram_only_page', md5('doc_id=' || coalesce(doc, 'None') || ': heading ' || heading || ' kept, ' || images || ' image(s) not extracted') FROM dg WHERE {_FLAG}""",
    "table_ranges": f"""WITH {_SEG}, {_JD} SELECT k::VARCHAR AS source_pdf, a AS page_start, z AS page_end, verdict, doc AS doc_id FROM jd""",
    "checklist_margins": f"""WITH {_LN}, t AS (SELECT k, n, q, p % 6 + 9 AS size, CASE WHEN n = 1 AND k % 2 = 0 THEN 'REVISION' WHEN f = 'R' THEN 'Page 1 of 2' ELSE 'text' END AS text FROM ln),
b AS (SELECT *, max(CASE WHEN text = 'REVISION' THEN q END) OVER (PARTITION BY k) AS band FROM t)
SELECT k::VARCHAR AS checklist, n AS line_ord, text FROM b WHERE coalesce(q > band + {P.HEADER_MARGIN}, true) AND text <> 'Page 1 of 2' AND size < {P.TITLE_SIZE}""",
    "checklist_rows": f"""WITH RECURSIVE {_LN}, t AS (SELECT *, q / 2 AS y, row_number() OVER (PARTITION BY k ORDER BY q, n) AS o FROM ln),
g(k, o, y, anchor, g) AS (SELECT k, o, y, y, 0 FROM t WHERE o = 1 UNION ALL SELECT t.k, t.o, t.y, CASE WHEN abs(t.y - anchor) > {P.ROW_TOLERANCE} THEN t.y ELSE anchor END, g + (abs(t.y - anchor) > {P.ROW_TOLERANCE})::INT FROM g JOIN t ON t.k = g.k AND t.o = g.o + 1)
SELECT t.k::VARCHAR AS checklist, g AS row_ord, 1 AS page, min(t.y)::DOUBLE AS y0, min(p % 300)::DOUBLE AS x0, bool_and(f <> 'A') AS bold, string_agg('w' || n, ' ' ORDER BY p % 300, t.y, n) AS text FROM g JOIN t ON t.k = g.k AND t.o = g.o GROUP BY t.k, g""",
    "block_rows": f"""WITH RECURSIVE {_LN}, t AS (SELECT *, q / 2 AS y, (n - 1) // 6 + 1 AS b, row_number() OVER (PARTITION BY k, (n - 1) // 6 ORDER BY n) AS o FROM ln WHERE f <> 'N'),
g(k, b, o, y, high, g) AS (SELECT k, b, o, y, y, 0 FROM t WHERE o = 1 UNION ALL SELECT t.k, t.b, t.o, t.y, CASE WHEN abs(t.y - high) > {P.ROW_TOLERANCE} THEN t.y ELSE least(high, t.y) END, g + (abs(t.y - high) > {P.ROW_TOLERANCE})::INT FROM g JOIN t ON t.k = g.k AND t.b = g.b AND t.o = g.o + 1),
w AS (SELECT k, b, g, t.y, n, f, p % 300 AS x, 'w' || n AS s FROM g JOIN t USING (k, b, o) UNION ALL SELECT k, b, g, t.y, n, NULL, p % 300 + 400, ' ' FROM g JOIN t USING (k, b, o)),
r AS (SELECT k, b, g, trim(string_agg(s, '' ORDER BY x, n)) AS text, bool_and(f = 'R') FILTER (f IS NOT NULL) AS bold, min(y) AS y, count(f) AS c FROM w GROUP BY k, b, g)
SELECT k::VARCHAR AS source_pdf, (row_number() OVER (PARTITION BY k ORDER BY b, g) - 1)::INT AS row_ord, text, bold AS all_bold, 'b' || b AS block_id, y::DOUBLE AS y0, c::INT AS n_lines FROM r""",
    "clause_depths": f"""WITH {_LN} SELECT k, n, 1 + (n > 1)::INT + (n > 3)::INT AS depth, (k + CASE WHEN n > 1 THEN n ELSE 0 END + CASE WHEN n > 3 THEN p ELSE 0 END)::BIGINT AS total, k AS top FROM ln""",
    "viewer_keys": f"""WITH {_LN}, c AS (SELECT 'D' || k || '|' || CASE WHEN f <> 'N' THEN 'c' || (p % 2) ELSE '' END || '|' || (n % 2) || '|' || ((n + p % 3) % 2) AS key, n, k, 3 BETWEEN n AND n + p % 3 AS on_page FROM ln)
SELECT key, n AS chunk_ord, k, on_page FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""",
    "text_vectors": "WITH c AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda x: (length(text) - length(replace(text, x, '')))::DOUBLE) AS v FROM documents), n AS (SELECT doc_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS s FROM c) SELECT doc_id, "
    + ", ".join(f"round((v[{i + 1}] / s)::FLOAT::DOUBLE, 4) AS {c}" for i, c in enumerate("aeiou")) + " FROM n",
    "mapping_lookup": f"""WITH {_LN} SELECT 'List3' AS checklist, 'i7' AS item_id, k, n FROM ln WHERE k % 5 = 3 AND k % 11 = 7 AND f = 'R'""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
