"""Explicit schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_SPAN = "struct<text:string,page:int,font_size:double,bold:boolean,bbox:array<double>>"
_LINE = f"struct<text:string,bbox:array<double>,spans:array<{_SPAN}>>"
_PATH = "array<struct<clause_no:string,clause_title:string>>"

SCHEMAS: dict[str, str] = {
    "spans": "source_pdf string, page int, block_no int, line_no int, span_no int, text string, font string, flags int, font_size double, bbox array<double>",
    "pages": "source_pdf string, page int, height double, image_count int",
    "raw_tables": "source_pdf string, table_ord int, page int, bbox array<double>, rows array<array<string>>, cell_bboxes array<array<array<double>>>, ncols int, content_below boolean, gap_to_bottom double",
    "headers": "source_pdf string, page int, header_template string, doc_id string, doc_name string, revision string, issue_date string, revised_date string, doc_relative_page_span string, approved_by string, reviewed_revised_by string, reference_procedure string, bbox array<double>",
    "subdocuments": "source_pdf string, subdoc_idx int, doc_id string, doc_name string, revision string, issue_date string, revised_date string, pdf_page_start int, pdf_page_end int, doc_relative_page_span string, header_template string, approved_by string, reviewed_revised_by string, reference_procedure string",
    "blocks": f"source_pdf string, subdoc_idx int, block_ord int, block_id string, page int, bbox array<double>, text string, lines array<{_LINE}>",
    "tables": "source_pdf string, subdoc_idx int, table_id string, page_start int, page_end int, rows array<array<string>>, bbox_by_page map<int,array<double>>",
    "removal_log": "source_pdf string, page int, pages array<int>, rule string, detail string",
    "rows": "source_pdf string, subdoc_idx int, row_ord int, text string, all_bold boolean, page int, block_id string, y0 double, n_lines int",
    "events": f"source_pdf string, subdoc_idx int, ev_ord int, kind string, text string, page int, page_end int, y0 double, block_id string, clause_no string, clause_title string, annex_letter string, table_id string, n_lines int, bucket string, note string",
    "chunks": f"chunk_ord int, chunk_id string, doc_id string, doc_name string, clause_no string, clause_title string, ancestor_path {_PATH}, lead_lines array<string>, text string, page_start int, page_end int, table_ids array<string>",
    "checklist_lines": "checklist string, page int, line_ord int, y0 double, x0 double, bold boolean, size double, text string",
    "checklist_rows": "checklist string, row_ord int, page int, y0 double, x0 double, bold boolean, text string",
    "items": f"checklist string, item_ord int, item_id string, clause_no string, ancestor_path {_PATH}, text string, page_start int, page_end int",
    "rankings": "checklist string, item_id string, view string, chunk_id string, rank int, score double, above_floor boolean",
    "gate": "high_idf_threshold double, min_high_idf_terms int, min_score double, n_chunks bigint, rare_vocab_size bigint, vocab_size bigint, single_term_contribution_min double, single_term_contribution_n bigint",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])
