"""Queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from clausework.llm.chat import OP6_SQL, op6_chat_formatting
from clausework.llm.decontaminate import op3_decontaminate
from clausework.llm.language import op2_language
from clausework.llm.lines import op8_lines
from clausework.llm.packing import op9_packing
from clausework.llm.simhash import op5_simhash
from clausework.llm.substrings import op1_substrings
from clausework.llm.topk import OP4_SQL, op4_topk
from clausework.llm.toxicity import op7_toxicity
from clausework.llm.urls import OP10_SQL, op10_url_filters


def queries() -> dict:
    return {
        "op1_substrings": op1_substrings,
        "op2_language": op2_language,
        "op3_decontaminate": op3_decontaminate,
        "op4_topk": op4_topk,
        "op5_simhash": op5_simhash,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_toxicity": op7_toxicity,
        "op8_lines": op8_lines,
        "op9_packing": op9_packing,
        "op10_url_filters": op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": OP4_SQL,
        "op6_chat_formatting": OP6_SQL,
        "op10_url_filters": OP10_SQL,
    }
