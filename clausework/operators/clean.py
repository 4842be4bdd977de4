"""From spans and pages to headers, subdocuments, blocks and a log of what was removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import patterns as P
from clausework.functions.text import bounded_field, centre_in, is_blank, is_bold, is_footer, normalize_cell, strip, union_box
from clausework.operators import tables as T
from clausework.schemas import SCHEMAS

HEADER_FIELDS = ("header_template", "doc_id", "doc_name", "revision", "issue_date", "revised_date", "doc_relative_page_span", "approved_by", "reviewed_revised_by", "reference_procedure", "bbox")


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """source_pdf, page, block_no, bbox, lines: the page's blocks with lines and spans; sizes to two digits."""
    span = F.struct(
        "span_no", "text", "page", F.bround("font_size", 2).alias("font_size"),
        is_bold(F.col("font"), F.col("flags")).alias("bold"), "bbox",
    )
    lines = spans.groupBy("source_pdf", "page", "block_no", "line_no").agg(F.sort_array(F.collect_list(span)).alias("s"))
    plain = F.transform("s", lambda s: F.struct(s["text"].alias("text"), s["page"].alias("page"), s["font_size"].alias("font_size"), s["bold"].alias("bold"), s["bbox"].alias("bbox")))
    line = F.struct("line_no", F.array_join(F.transform("s", lambda s: s["text"]), "").alias("text"), union_box(F.transform("s", lambda s: s["bbox"])).alias("bbox"), plain.alias("spans"))
    grouped = lines.select("source_pdf", "page", "block_no", line.alias("line")).groupBy("source_pdf", "page", "block_no").agg(F.sort_array(F.collect_list("line")).alias("l"))
    out = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"), x["spans"].alias("spans")))
    return grouped.select("source_pdf", "page", "block_no", union_box(F.transform("l", lambda x: x["bbox"])).alias("bbox"), out.alias("lines"))


def table_headers(raw_tables: DataFrame) -> DataFrame:
    """The header of each page whose first header table names both document labels.

    A label's value is the cell to its right; of a label that occurs again the
    last one counts.
    """
    first = Window.partitionBy("source_pdf", "page").orderBy("table_ord")
    band = raw_tables.where((F.size("rows") > 0) & T.is_header_band(F.col("rows"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    cells = band.select("source_pdf", "page", "bbox", F.posexplode("rows").alias("ri", "row")).select("source_pdf", "page", "bbox", "ri", "row", F.posexplode("row").alias("ci", "cell"))
    label = F.upper(normalize_cell(F.col("cell")))
    found = cells.withColumn("label", label).where(F.col("label").isin(*P.HEADER_LABELS))
    value = normalize_cell(F.get("row", F.col("ci") + 1))
    last = found.groupBy("source_pdf", "page", "bbox").agg(*(F.max_by(F.when(F.col("label") == x, F.struct(value.alias("v"))), F.when(F.col("label") == x, F.struct("ri", "ci"))).alias(x) for x in P.HEADER_LABELS))
    got = lambda x: F.col(f"`{x}`.v")
    page = F.regexp_replace(got("PAGE NO."), r"(?i)^Page\s+", "")
    null = F.lit(None).cast("string")
    return last.where(F.col("`DOCUMENT NAME`").isNotNull() & F.col("`DOCUMENT NO.`").isNotNull()).select(
        "source_pdf", "page", F.lit("standard_table").alias("header_template"), got("DOCUMENT NO.").alias("doc_id"), got("DOCUMENT NAME").alias("doc_name"),
        got("REVISION").alias("revision"), got("ISSUE DATE").alias("issue_date"), got("REVISED DATE").alias("revised_date"), page.alias("doc_relative_page_span"),
        null.alias("approved_by"), null.alias("reviewed_revised_by"), null.alias("reference_procedure"), "bbox",
    )


def form_headers(spans: DataFrame) -> DataFrame:
    """The header of each page whose top band is a form's free text with a document number and something bold."""
    bold = is_bold(F.col("font"), F.col("flags"))
    band = spans.where((F.col("bbox")[3] <= P.FORM_BAND_BOTTOM) & ~is_blank(F.col("text")))
    s = F.struct(F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), "block_no", "line_no", "span_no", strip(F.col("text")).alias("text"), "bbox")
    pages = band.groupBy("source_pdf", "page").agg(F.sort_array(F.collect_list(s)).alias("s"), F.max(bold).alias("any_bold"))
    pages = pages.withColumn("joined", F.array_join(F.transform("s", lambda x: x["text"]), " "))
    pages = pages.where(F.col("joined").contains("Document Number") & F.col("any_bold"))
    field = lambda label: bounded_field(F.col("joined"), label, P.FORM_LABELS)
    null = F.lit(None).cast("string")
    out = pages.select(
        "source_pdf", "page", F.lit("form_freetext").alias("header_template"), field("Document Number").alias("doc_id"), F.col("s")[0]["text"].alias("doc_name"),
        field("Revision Number").alias("revision"), null.alias("issue_date"), field("Revision Date").alias("revised_date"), null.alias("doc_relative_page_span"),
        field("Approved by").alias("approved_by"), field("Reviewed / Revised by").alias("reviewed_revised_by"), field("Reference Procedure").alias("reference_procedure"),
        union_box(F.transform("s", lambda x: x["bbox"])).alias("bbox"),
    )
    return out.where(F.coalesce(F.col("doc_id"), F.lit("")) != "")


def headers(raw_tables: DataFrame, spans: DataFrame) -> DataFrame:
    """One header for each page that has one; a table header comes before a form's."""
    a, b = table_headers(raw_tables), form_headers(spans)
    return a.unionByName(b.join(a.select("source_pdf", "page"), ["source_pdf", "page"], "left_anti"))


def segment(pages: DataFrame, found: DataFrame, key: str = "source_pdf", order: str = "page") -> DataFrame:
    """pages with their header fields, is_start, subdoc_idx and the doc_id and doc_name carried forward.

    A header starts a subdocument if its doc_id or doc_name differs from the
    last header's, or if that one had no doc_id. Pages before the first header
    have index -1. Only pages with a header decide, so the comparison is a lag
    over these; a running sum numbers the starts.
    """
    heads = Window.partitionBy(key).orderBy(order)
    h = found.withColumns({"_id": F.lag("doc_id").over(heads), "_name": F.lag("doc_name").over(heads), "_any": F.lag(F.lit(1)).over(heads)})
    new = F.col("_any").isNull() | F.col("_id").isNull() | ~F.col("doc_id").eqNullSafe(F.col("_id")) | ~F.col("doc_name").eqNullSafe(F.col("_name"))
    h = h.withColumn("is_start", new).drop("_id", "_name", "_any").withColumn("_header", F.lit(True))
    met = pages.join(h, [key, order], "left").withColumn("is_start", F.coalesce("is_start", F.lit(False)))
    so_far = heads.rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(F.when(F.col("is_start"), F.struct(c)), ignorenulls=True).over(so_far)[c]
    return met.withColumns({
        "subdoc_idx": (F.sum(F.col("is_start").cast("int")).over(so_far) - 1).cast("int"),
        "cur_doc_id": carried("doc_id"), "cur_doc_name": carried("doc_name"), "has_header": F.col("_header").isNotNull(),
    }).drop("_header")


def subdocuments(segmented: DataFrame) -> DataFrame:
    """One row for each subdocument: its header's fields and its first and last page."""
    order = Window.partitionBy("source_pdf").orderBy("page")
    last_page = F.max("page").over(Window.partitionBy("source_pdf"))
    starts = segmented.withColumn("_last", last_page).where("is_start").withColumn("pdf_page_end", F.coalesce(F.lead("page").over(order) - 1, F.col("_last")).cast("int"))
    wanted = [c.split()[0] for c in SCHEMAS["subdocuments"].split(", ")]
    return starts.withColumn("pdf_page_start", F.col("page")).select(*wanted)


def extraction_report(segmented: DataFrame) -> DataFrame:
    """Counts of subdocuments by template, their ids in order, and pages without a header, for each PDF."""
    starts = F.col("is_start")
    ids = F.sort_array(F.collect_list(F.when(starts, F.struct("page", "doc_id"))))
    return segmented.groupBy("source_pdf").agg(
        F.count_if(starts).alias("subdocument_count"),
        F.count_if(starts & (F.col("header_template") == "standard_table")).alias("standard_table"),
        F.count_if(starts & (F.col("header_template") == "form_freetext")).alias("form_freetext"),
        F.transform(ids, lambda x: x["doc_id"]).alias("doc_ids"),
        F.sort_array(F.collect_list(F.when(~F.col("has_header"), F.col("page")))).alias("header_absent_pages"),
    )


def page_blocks(blocks: DataFrame, segmented: DataFrame, raw_tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of a page without blank lines, footers and lines inside its header or any of its tables.

    A block keeps its own box, whatever lines it loses. The height is that of the
    PDF's first page; a PDF without one has no footers.
    """
    height = pages.where("page = 1").select("source_pdf", F.col("height").alias("_height"))
    regions = raw_tables.where((F.size("rows") > 0) & ~T.is_header_band(F.col("rows"))).groupBy("source_pdf", "page").agg(F.collect_list("bbox").alias("_tables"))
    head = segmented.where("has_header").select("source_pdf", "page", F.array("bbox").alias("_head"))
    met = blocks.join(height, "source_pdf", "left").join(regions, ["source_pdf", "page"], "left").join(head, ["source_pdf", "page"], "left")
    none = F.array().cast("array<array<double>>")
    inside = F.concat(F.coalesce("_tables", none), F.coalesce("_head", none))
    keep = F.filter(
        "lines",
        lambda l: ~is_blank(l["text"]) & ~F.exists(inside, lambda r: centre_in(l["bbox"], r)) & ~F.coalesce(is_footer(l["text"], l["bbox"][3], F.col("_height")), F.lit(False)),
    )
    out = met.withColumn("lines", keep).where(F.size("lines") > 0)
    return out.withColumn("text", F.array_join(F.transform("lines", lambda l: l["text"]), " ")).drop("_height", "_tables", "_head")


def named_blocks(cleaned: DataFrame, segmented: DataFrame) -> DataFrame:
    """The blocks of subdocuments, numbered through each of them; pages without a doc_id have none."""
    met = cleaned.join(segmented.select("source_pdf", "page", "subdoc_idx", "cur_doc_id"), ["source_pdf", "page"]).where(F.col("cur_doc_id").isNotNull())
    n = F.row_number().over(Window.partitionBy("source_pdf", "subdoc_idx").orderBy("page", "block_no"))
    name = F.concat("cur_doc_id", F.format_string("__p%03d_b%03d", F.col("page"), F.col("block_ord")))
    wanted = ("source_pdf", "subdoc_idx", "block_ord", "block_id", "page", "bbox", "text", "lines")
    return met.withColumn("block_ord", n.cast("int")).withColumn("block_id", name).select(*wanted)


def diagram_pages(cleaned: DataFrame, segmented: DataFrame, raw_tables: DataFrame) -> DataFrame:
    """Every page with image_count, remaining_blocks and diagram_only: images, no table, hardly any text."""
    chars = F.aggregate("lines", F.lit(0), lambda n, l: n + F.length(strip(l["text"])))
    left = cleaned.groupBy("source_pdf", "page").agg(F.count("*").alias("remaining_blocks"), F.sum(chars).alias("chars"), F.min_by(strip(F.col("text")), "block_no").alias("heading"))
    has = T.body_tables(raw_tables).select("source_pdf", "page").distinct().withColumn("has_table", F.lit(True))
    met = segmented.select("source_pdf", "page", "image_count", F.col("cur_doc_id").alias("doc_id")).join(left, ["source_pdf", "page"], "left").join(has, ["source_pdf", "page"], "left")
    met = met.na.fill({"remaining_blocks": 0, "chars": 0, "has_table": False})
    only = ~F.col("has_table") & (F.col("image_count") >= 1) & (F.col("remaining_blocks") <= P.DIAGRAM_BLOCKS) & (F.col("chars") <= P.DIAGRAM_CHARS)
    return met.withColumn("diagram_only", only)


def judged_tables(raw_tables: DataFrame, segmented: DataFrame) -> DataFrame:
    """Stitched tables with subdoc_idx, doc_id of their first page, verdict and reason."""
    t = T.without_slivers(T.stitch(T.body_tables(raw_tables)))
    t = t.withColumns({"page": F.col("pages")[0], "page_end": F.element_at("pages", -1), "v": T.verdict(F.col("rows"), F.col("ncols"))})
    owner = segmented.select("source_pdf", "page", "subdoc_idx", F.col("cur_doc_id").alias("doc_id"))
    return t.join(owner, ["source_pdf", "page"], "left").select("*", "v.verdict", "v.reason").drop("v")


def kept_tables(judged: DataFrame) -> DataFrame:
    """Kept tables of subdocuments, numbered through each of them."""
    n = F.row_number().over(Window.partitionBy("source_pdf", "subdoc_idx").orderBy("stitch"))
    kept = judged.where((F.col("verdict") == "KEEP") & (F.col("subdoc_idx") >= 0)).withColumn("_n", n)
    return kept.select(
        "source_pdf", "subdoc_idx", F.concat(F.coalesce("doc_id", F.lit("None")), F.format_string("__t%02d", F.col("_n"))).alias("table_id"), F.col("page").alias("page_start"), "page_end", "rows",
        F.map_from_arrays("pages", "bboxes").alias("bbox_by_page"),
    )


def removal_log(judged: DataFrame, diagrams: DataFrame) -> DataFrame:
    """What was taken out or only marked: empty tables, diagram pages, and tables before the first header."""
    ident = F.coalesce("doc_id", F.lit("None"))
    drop = judged.where("verdict = 'DISCARD' OR subdoc_idx < 0")
    rule = F.when(F.col("verdict") == "DISCARD", "empty_table").otherwise("before_first_header")
    why = F.concat(
        F.lit("doc_id="), ident, F.format_string(" table pp.%d-%d: ", "page", "page_end"), "reason",
        F.format_string(" (ncols_before_filter=%d, ncols_after_filter=%d, dropped_cols=", "ncols_before_filter", "ncols"),
        F.lit("["), F.array_join(F.transform("dropped_cols", lambda c: (c - 1).cast("string")), ", "), F.lit("])"),
    )
    tables = drop.select("source_pdf", "page", "pages", rule.alias("rule"), why.alias("detail"))
    said = F.concat(F.lit("doc_id="), ident, F.lit(": heading "), F.coalesce("heading", F.lit("")), F.format_string(" kept, %d image(s) not extracted", "image_count"))
    marked = diagrams.where("diagram_only").select("source_pdf", "page", F.lit(None).cast("array<int>").alias("pages"), F.lit("diagram_only_page").alias("rule"), said.alias("detail"))
    return tables.unionByName(marked)
