"""Tables of a layout: stitching over pages, narrow columns, verdicts, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import patterns as P
from clausework.functions.text import is_blank, normalize_cell


def is_header_band(rows: Column) -> Column:
    """One of the first two rows has a document label."""
    cells = F.flatten(F.slice(rows, 1, 2))
    return F.exists(cells, lambda c: F.coalesce(F.upper(normalize_cell(c)).isin(*P.REQUIRED_LABELS), F.lit(False)))


def body_tables(raw: DataFrame) -> DataFrame:
    """Raw tables that have rows and aren't a page's header."""
    return raw.where((F.size("rows") > 0) & ~is_header_band(F.col("rows")))


def with_page_facts(raw: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """content_below and gap_to_bottom of each raw table; the height is that of the PDF's first page.

    Without a first page the gap is null, and the table isn't continued.
    """
    height = pages.where("page = 1").select("source_pdf", F.col("height").alias("_height"))
    text = spans.where(
        ~is_blank(F.col("text")) & ~F.coalesce(F.col("text").rlike("(?U)(?d)(?i)(?u)" + P.FOOTER), F.lit(False))
    )
    lowest = text.groupBy("source_pdf", "page").agg(F.max(F.col("bbox")[1]).alias("_lowest"))
    met = raw.drop("content_below", "gap_to_bottom").join(height, "source_pdf", "left").join(lowest, ["source_pdf", "page"], "left")
    below = F.coalesce(F.col("_lowest") > F.col("bbox")[3], F.lit(False))
    return met.withColumn("content_below", below).withColumn("gap_to_bottom", F.col("_height") - F.col("bbox")[3]).drop("_height", "_lowest")


def stitch(raw: DataFrame) -> DataFrame:
    """Tables that go on at the top of the next page, as one: rows in order, pages and boxes of the parts.

    A part continues the one before it if nothing stands below that one, it ends
    near the bottom and this one starts near the top of the next page, with as
    many columns and the same edges. Every condition looks at the part before
    only, so it is a lag; a running sum numbers the tables.
    """
    order = Window.partitionBy("source_pdf").orderBy("table_ord")
    last = lambda c: F.lag(c).over(order)
    box, before = F.col("bbox"), last("bbox")
    goes_on = (
        (last("ncols") == F.col("ncols"))
        & (last("page") + 1 == F.col("page"))
        & ~last("content_below")
        & (last("gap_to_bottom") < P.STITCH_GAP)
        & (box[1] < P.STITCH_TOP)
        & (F.abs(before[0] - box[0]) < P.STITCH_X)
        & (F.abs(before[2] - box[2]) < P.STITCH_X)
    )
    starts = raw.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    numbered = starts.withColumn("stitch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("table_ord", "page", "bbox", "rows", "cell_bboxes")
    whole = numbered.groupBy("source_pdf", "stitch").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.first("ncols").alias("ncols"))
    each = lambda name: F.transform("parts", lambda p: p[name])
    return whole.select(
        "source_pdf", "stitch", "ncols", each("page").alias("pages"), each("bbox").alias("bboxes"),
        F.flatten(each("rows")).alias("rows"), F.flatten(each("cell_bboxes")).alias("cell_bboxes"),
    )


def without_slivers(stitched: DataFrame) -> DataFrame:
    """Columns go that are narrower than MIN_COLUMN_WIDTH and empty in all rows but the first.

    rows, ncols and dropped_cols of the result; rows that are too short count as
    having null cells.
    """
    columns = F.when(F.col("ncols") > 0, F.sequence(F.lit(1), F.col("ncols"))).otherwise(F.array().cast("array<int>"))
    padded = stitched.withColumn("rows", F.transform("rows", lambda r: F.transform(columns, lambda c: F.get(r, c - 1))))

    def sliver(c: Column) -> Column:
        boxes = F.filter(F.transform("cell_bboxes", lambda r: F.get(r, c - 1)), lambda b: b.isNotNull())
        width = F.coalesce(F.array_max(F.transform(boxes, lambda b: b[2] - b[0])), F.lit(0.0))
        return (width < P.MIN_COLUMN_WIDTH) & F.forall(F.slice(F.col("rows"), 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: is_blank(F.get(r, c - 1)))

    dropped = padded.withColumn("dropped_cols", F.filter(columns, sliver))
    # a column of its own: inside a lambda, ncols would mean the new one
    marked = dropped.withColumn("_kept", F.array_except(columns, F.col("dropped_cols")))
    rows = F.transform("rows", lambda r: F.transform("_kept", lambda c: F.get(r, c - 1)))
    return marked.withColumns({"rows": rows, "ncols_before_filter": F.col("ncols"), "ncols": F.size("_kept")}).drop("_kept")


def verdict(rows: Column, ncols: Column) -> Column:
    """(verdict, reason): DISCARD if all cells, or the last cell of every data row, are blank; else KEEP.

    The first row is a header and no data, unless it is the only one.
    """
    cells = F.flatten(rows)
    data = F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    blank_last = F.forall(data, lambda r: F.when(F.size(r) > 0, is_blank(F.element_at(r, -1))).otherwise(True))
    said = lambda v, why: F.struct(F.lit(v).alias("verdict"), F.lit(why).alias("reason"))
    return (
        F.when((F.size(cells) > 0) & F.forall(cells, is_blank), said("DISCARD", "entirely empty"))
        .when((F.size(data) > 0) & (ncols > 0) & blank_last, said("DISCARD", "rightmost column blank on every data row"))
        .otherwise(said("KEEP", "has content"))
    )


def serialize(rows: Column) -> Column:
    """One line for each row; null and empty cells are empty."""
    return F.transform(rows, lambda r: F.array_join(r, P.CELL_SEPARATOR, ""))
