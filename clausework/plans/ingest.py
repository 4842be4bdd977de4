"""Stage A: a layout becomes subdocuments, blocks, tables and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from clausework.operators import clean, outline
from clausework.operators import tables as T
from clausework.sources.catalog import Catalog
from clausework.sources.scratch import stored


def parse(spans: DataFrame, pages: DataFrame, raw_tables: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Every table of stage A by name; also `segmented`, `judged`, `diagrams`, `report` and `folded`.

    All are lazy, but keep() may store what several of them read.
    """
    raw = T.with_page_facts(raw_tables, spans, pages)
    head = clean.headers(raw_tables, spans)
    segmented = keep(clean.segment(pages, head))  # a row for each page; every table needs it
    subdocs = clean.subdocuments(segmented)
    cleaned = keep(clean.page_blocks(clean.blocks_from_spans(spans), segmented, raw_tables, pages))
    blocks = clean.named_blocks(cleaned, segmented)
    judged = keep(clean.judged_tables(raw, segmented))
    tables = clean.kept_tables(judged)
    diagrams = clean.diagram_pages(cleaned, segmented, raw_tables)
    rows = outline.rows_of_blocks(blocks)
    folded = outline.outlines(rows, tables, subdocs)
    return {
        "headers": head, "segmented": segmented, "subdocuments": subdocs, "blocks": blocks, "judged": judged, "tables": tables, "diagrams": diagrams,
        "removal_log": clean.removal_log(judged, diagrams), "report": clean.extraction_report(segmented), "rows": rows, "folded": folded,
        "events": outline.events_table(folded), "chunks": outline.chunks_table(folded, subdocs),
    }


def run(catalog: Catalog, spans: DataFrame, pages: DataFrame, raw_tables: DataFrame) -> dict[str, int]:
    """Replace the workspace by this layout's tables; how many subdocuments and chunks there are.

    Each step reads what the step before it has stored, so that no page is
    cleaned and no subdocument folded twice.
    """
    catalog.clear()
    made = parse(spans, pages, raw_tables, stored)
    tables = {name: catalog.write(name, made[name]) for name in ("subdocuments", "blocks", "tables", "removal_log")}
    folded = stored(outline.outlines(outline.rows_of_blocks(tables["blocks"]), tables["tables"], tables["subdocuments"]))
    catalog.write("events", outline.events_table(folded))
    chunks = catalog.write("chunks", outline.chunks_table(folded, tables["subdocuments"]))
    return {"subdocuments": tables["subdocuments"].count(), "chunks": chunks.count()}
