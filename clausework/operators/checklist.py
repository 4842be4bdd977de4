"""Checklist lines to rows, rows to leaf items under their headings."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import patterns as P
from clausework.functions.text import java, nests_under, strip
from clausework.operators.outline import numbered_again
from clausework.schemas import schema


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines that are no header (down to the lowest label of the page), page number or title."""
    label = F.when(F.col("text").isin(*P.HEADER_LABELS), F.col("y0"))
    band = F.max(label).over(Window.partitionBy("checklist", "page"))
    keep = F.coalesce(F.col("y0") > F.col("_band") + P.HEADER_MARGIN, F.lit(True)) & ~F.col("text").rlike(java(P.CHECKLIST_FOOTER)) & (F.col("size") < P.TITLE_SIZE)
    return lines.withColumn("_band", band).where(keep).drop("_band")


def anchored_groups(tops: list[float], tolerance: float = P.ROW_TOLERANCE) -> list[int]:
    """The row of each line, in order: a new one begins where a line is further than tolerance from the first of the open row."""
    groups, anchor = [], None
    for y in tops:
        new = anchor is None or abs(y - anchor) > tolerance
        groups.append((groups[-1] if groups else -1) + new)
        anchor = y if new else anchor
    return groups


def grouped_rows(lines: DataFrame) -> DataFrame:
    """One row for each group of lines of a page within a tolerance of the group's first line."""

    @F.pandas_udf("array<int>")
    def groups(column: pd.Series) -> pd.Series:
        return column.map(lambda tops: anchored_groups(list(tops)))

    line = F.struct("y0", "line_ord", "x0", "bold", "text")
    pages = lines.groupBy("checklist", "page").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    g = pages.withColumn("g", groups(F.transform("ls", lambda l: l["y0"]))).select("checklist", "page", F.explode(F.arrays_zip("g", "ls")).alias("l"))
    g = g.select("checklist", "page", "l.g", "l.ls.*")
    cell = F.struct("x0", "y0", "line_ord", "text")
    rows = g.groupBy("checklist", "page", "g").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.bool_and("bold").alias("bold"))
    rows = rows.withColumn("text", strip(F.array_join(F.transform("cells", lambda c: c["text"]), " ")))
    n = F.row_number().over(Window.partitionBy("checklist").orderBy("page", "g")) - 1
    return rows.withColumn("row_ord", n.cast("int")).select(*schema("checklist_rows").names)


def column_gap(df: DataFrame, key: str, x: str) -> DataFrame:
    """key, n, gap, threshold: the middle of the widest gap between neighbouring values of x, the first of equals."""
    order = Window.partitionBy(key).orderBy(x)
    # equal values have no gap between them, so distinct values give the same widest gap
    counted = df.groupBy(key, x).agg(F.count("*").alias("_n"))
    gaps = counted.withColumns({"_next": F.lead(x).over(order)}).withColumn("_gap", F.col("_next") - F.col(x))
    best = F.max_by(F.struct(F.col(x).alias("left"), F.col("_next").alias("right")), F.struct(F.col("_gap"), -F.col(x)))
    found = gaps.groupBy(key).agg(F.sum("_n").alias("n"), F.max("_gap").alias("gap"), best.alias("b"))
    return found.select(key, "n", F.coalesce("gap", F.when(F.col("n") > 1, F.lit(0.0))).alias("gap"), ((F.col("b.left") + F.col("b.right")) / 2).alias("threshold"))


def classified(rows: DataFrame) -> DataFrame:
    """rows with kind (heading, item or body), clause_no and title.

    Numbers count only left of the widest gap between the columns of numbered
    rows. Too few of these, or no clear gap, is an error and no guess.
    """
    no = F.regexp_extract("text", java(P.CHECKLIST_NUMBERED), 1)
    title = F.regexp_extract("text", java(P.CHECKLIST_NUMBERED), 2)
    shaped = rows.withColumns({"clause_no": no, "title": title})
    gap = column_gap(shaped.where("clause_no <> ''"), "checklist", "x0")
    few = F.coalesce(F.col("n"), F.lit(0)) < 2
    fault = F.when(few, F.concat(F.lit("too few numbered rows in "), "checklist")).when(F.col("gap") < P.COLUMN_GAP, F.concat(F.lit("no clear column gap in "), "checklist"))
    met = shaped.join(gap, "checklist", "left").withColumn("threshold", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("threshold")))
    numbered = (F.col("clause_no") != "") & (F.col("x0") < F.col("threshold"))
    kind = F.when(~numbered, "body").when(F.col("bold"), "heading").otherwise("item")
    out = met.withColumn("kind", kind)
    return out.withColumns({"clause_no": F.when(numbered, F.col("clause_no")), "title": F.when(numbered, F.col("title"))}).select(*rows.columns, "kind", "clause_no", "title", "threshold")


def open_headings(depths: list[int]) -> list[list[int]]:
    """For each heading the places of those that are open at it, itself last."""
    stack: list[int] = []
    out = []
    for i, depth in enumerate(depths):
        stack = [j for j in stack if depths[j] < depth] + [i]
        out.append(stack)
    return out


def heading_paths(c: DataFrame) -> DataFrame:
    """c with `path`: the open headings at each row, one for each depth at most.

    A heading closes those of its own depth and deeper: the heading of a depth is
    the last one of that depth since the last shallower one. Depths are folded in
    the order of rows, headings alone, which are few.
    """

    @F.pandas_udf("array<array<int>>")
    def open_at(column: pd.Series) -> pd.Series:
        return column.map(lambda depths: open_headings(list(depths)))

    heads = c.where("kind = 'heading'").groupBy("checklist").agg(F.sort_array(F.collect_list(F.struct("row_ord", "clause_no", F.col("title").alias("clause_title")))).alias("hs"))
    of = F.transform(open_at(F.transform("hs", lambda h: F.size(F.split(h["clause_no"], r"\.")))), lambda at: F.transform(at, lambda i: F.struct(F.get("hs", i)["clause_no"].alias("clause_no"), F.get("hs", i)["clause_title"].alias("clause_title"))))
    paths = heads.withColumn("ps", of).select("checklist", F.explode(F.arrays_zip("hs", "ps")).alias("x")).select("checklist", F.col("x.hs.row_ord").alias("row_ord"), F.col("x.ps").alias("path"))
    so_far = Window.partitionBy("checklist").orderBy("row_ord").rowsBetween(Window.unboundedPreceding, 0)
    met = c.join(paths, ["checklist", "row_ord"], "left")
    return met.withColumn("path", F.coalesce(F.last("path", ignorenulls=True).over(so_far), F.array().cast("array<struct<clause_no:string,clause_title:string>>")))


def leaf_rows(c: DataFrame) -> DataFrame:
    """Rows of items with item_no, its number and path, and `para`: the paragraph within the item.

    A row starts an item, or belongs to the open one; a heading closes it. Only
    an item that isn't numbered below its heading is split, where lines are
    further apart than PARAGRAPH_GAP. item_no 0 marks rows with nothing open.
    """
    order = Window.partitionBy("checklist").orderBy("row_ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    opened = heading_paths(c).withColumn("_open", F.last(F.when(F.col("kind") != "body", F.struct("kind", "row_ord", "clause_no", "path")), ignorenulls=True).over(so_far))
    leaf = opened.where("kind <> 'heading'").withColumn("item_no", F.when(F.col("_open.kind") == "item", F.col("_open.row_ord") + 1).otherwise(0))
    heading = F.get(F.reverse("_open.path"), F.lit(0))["clause_no"]
    split = ~F.coalesce(nests_under(F.col("_open.clause_no"), heading), F.lit(False))
    inside = Window.partitionBy("checklist", "item_no").orderBy("row_ord")
    far = F.col("y0") - F.lag("y0").over(inside) > P.PARAGRAPH_GAP
    leaf = leaf.withColumn("_far", F.coalesce(split & far, F.lit(False)).cast("int"))
    return leaf.withColumn("para", F.sum("_far").over(inside.rowsBetween(Window.unboundedPreceding, 0))).select(
        "checklist", "row_ord", "item_no", "para", "page", F.col("_open.clause_no").alias("clause_no"), F.col("_open.path").alias("ancestor_path"),
        F.when(F.col("kind") == "item", F.col("title")).otherwise(F.col("text")).alias("line"),
    )


def items(rows: DataFrame) -> DataFrame:
    """Leaf items of each checklist, numbered and named; repeated numbers end in #2, #3 and so on."""
    leaf = leaf_rows(classified(rows)).where("item_no > 0")
    made = leaf.groupBy("checklist", "item_no", "para").agg(
        F.first("clause_no").alias("clause_no"), F.first("ancestor_path").alias("ancestor_path"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_ord", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    made = numbered_again(made, ["checklist"], "clause_no", ["item_no", "para"])
    n = F.row_number().over(Window.partitionBy("checklist").orderBy("item_no", "para")) - 1
    return made.withColumns({"item_ord": n.cast("int"), "item_id": F.concat("checklist", F.lit("__"), "clause_no")}).select(*schema("items").names)


def orphans(rows: DataFrame) -> DataFrame:
    """Rows of text that come before any item."""
    return leaf_rows(classified(rows)).where("item_no = 0").select("checklist", "row_ord", "page", F.col("line").alias("text"))


def parse_report(rows: DataFrame) -> DataFrame:
    """Counts of headings, items and orphans, and the column threshold, for each checklist."""
    c = classified(rows)
    counts = c.groupBy("checklist").agg(F.count_if(F.col("kind") == "heading").alias("n_headings"), F.count_if(F.col("kind") == "item").alias("n_items_raw"), F.first("threshold").alias("threshold"))
    final = items(rows).groupBy("checklist").agg(F.count("*").alias("n_items_final"))
    lost = orphans(rows).groupBy("checklist").agg(F.count("*").alias("n_orphan_body_rows"))
    out = counts.join(final, "checklist", "left").join(lost, "checklist", "left").na.fill(0, ["n_items_final", "n_orphan_body_rows"])
    return out.withColumn("n_synthesized_paragraph_splits", F.col("n_items_final") - F.col("n_items_raw"))
