"""The labels, patterns and limits that decide how a layout is read.

Results depend on them; they are stated here once, as text.
"""

from __future__ import annotations

# --- fixed values: page headers and footers -------------------------------
HEADER_LABELS = ("DOCUMENT NAME", "DOCUMENT NO.", "REVISION", "REVISED DATE", "ISSUE DATE", "PAGE NO.")
REQUIRED_LABELS = ("DOCUMENT NAME", "DOCUMENT NO.")
FORM_LABELS = ("Document Number", "Revision Number", "Reference Procedure", "Revision Date", "Reviewed / Revised by", "Approved by")
FORM_BAND_BOTTOM = 101.0
FOOTER = r"^\s*(page\s+\d+\s+of\s+\d+|\d+\s*\|\s*p\s*a\s*g\s*e|\d+\s*of\s*\d+)\s*$"
FOOTER_BAND = 100.0

# --- fixed values: tables -------------------------------------------------
STITCH_GAP = 120.0
STITCH_X = 15.0
STITCH_TOP = 150.0
MIN_COLUMN_WIDTH = 10.0
CELL_SEPARATOR = " | "

# --- fixed values: diagram pages ------------------------------------------
DIAGRAM_BLOCKS = 1
DIAGRAM_CHARS = 150

# --- fixed values: rows and headings --------------------------------------
ROW_TOLERANCE = 3.0
NUMBERED = r"^(\d+(?:\.\d+)*)\s+(\S.*)$"
NUMBERED_PERIOD = r"^(\d+(?:\.\d+)*)\.\s+(\S.*)$"
PERIOD_TITLE_WORDS = 8
FIRST_TOP_LEVEL = 30
TOP_LEVEL_JUMP = 15
NUMBERED_PER_BLOCK = 5
ANNEX = r"^Annex\s+([A-Z])\b"
ANNEXURE = r"^Annexure\s*[–-]?\s*([A-Z])\b"
PARENTHETICAL = r"^\(.*\)$"

# --- fixed values: checklists ---------------------------------------------
CHECKLIST_NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
CHECKLIST_FOOTER = r"^Page \d+ of \d+$"
HEADER_MARGIN = 2.0
TITLE_SIZE = 13.0
PARAGRAPH_GAP = 14.0
COLUMN_GAP = 15.0

# --- fixed values: ranking ------------------------------------------------
TOKEN = "([a-z0-9]+)"
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
HIGH_IDF, MIN_HIGH_IDF_TERMS, MIN_SCORE = 5.0, 1, 0.5
RARE_DF = 2
MIN_SCORE_PERCENTILE = 0.01
