"""Reports for people: small tables of a workspace as Markdown. All counting is done by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import patterns as P
from clausework.operators import quality, ranking

#: Rows of a listing, and entries of a sample list.
MOST_ROWS = 10_000
SAMPLE = 5


def table(df: DataFrame, most: int = MOST_ROWS) -> list[str]:
    """df as a Markdown table; says so if there are more rows than are listed."""
    rows = df.limit(most + 1).collect()
    out = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    return out + ([f"(more than {most} rows)"] if len(rows) > most else [])


def _page(title: str, *sections: tuple[str, DataFrame]) -> str:
    lines = [f"# {title}"]
    for name, df in sections:
        lines += ["", f"## {name}", "", *table(df)]
    return "\n".join(lines) + "\n"


def empty_tables(judged: DataFrame, removal_log: DataFrame) -> str:
    """Stitched tables by verdict, the multi-page ones, and why tables were discarded."""
    ranges = quality.table_ranges(judged)
    counts = ranges.groupBy("source_pdf").agg(F.count("*").alias("stitched"), F.count_if(F.col("verdict") == "KEEP").alias("kept"), F.count_if(F.col("verdict") == "DISCARD").alias("discarded"))
    long = ranges.where("page_end > page_start").orderBy("source_pdf", "page_start")
    gone = removal_log.where("rule = 'empty_table'").select("source_pdf", "page", "detail").orderBy("source_pdf", "page")
    return _page("Empty tables", ("Totals", counts), ("Tables over several pages", long), ("Discarded", gone))


def diagram_pages(diagrams: DataFrame) -> str:
    """Pages with hardly more than an image."""
    counts = diagrams.groupBy("source_pdf").agg(F.count("*").alias("pages"), F.count_if("diagram_only").alias("flagged"))
    flagged = diagrams.where("diagram_only").select("source_pdf", "page", "doc_id", "image_count", "remaining_blocks").orderBy("source_pdf", "page")
    return _page("Diagram-only pages", ("Totals", counts), ("Flagged", flagged))


def coverage(events: DataFrame, facts: DataFrame) -> str:
    """Where each source line went, and what the homogeneity of blocks has kept from being a heading."""
    return _page("Coverage of source lines", ("Lines", quality.coverage(events, facts)), ("Blocks", quality.homogeneity(facts, events)))


def index_inputs(chunks: DataFrame, items: DataFrame, tokenized: DataFrame) -> str:
    """What is indexed: chunks, items of each checklist, tokens."""
    sizes = tokenized.agg(F.count("*").alias("chunks"), F.sum("dl").alias("tokens"), F.max("dl").alias("longest"), F.percentile("dl", F.lit(0.5)).alias("median"))
    per = items.groupBy("checklist").agg(F.count("*").alias("items"))
    return _page("Index inputs", ("Corpus", sizes), ("Items", per), ("Repeated chunk ids", quality.duplicates(chunks, "chunk_id")))


def rankings(stored: DataFrame, gate: DataFrame, tokenized: DataFrame, vocab: DataFrame, n_chunks: int) -> str:
    """Gate, its grounding, items without a strong hit, faults of lists, and the top of each list of the first items."""
    first = stored.select("checklist", "item_id").distinct().orderBy("checklist", "item_id").limit(SAMPLE)
    top = stored.where(F.col("rank") <= SAMPLE).join(F.broadcast(first), ["checklist", "item_id"], "left_semi").orderBy("checklist", "item_id", "view", "rank")
    return _page(
        f"Rankings (fusion constant {P.RRF_K})",
        ("Gate", gate), ("Grounding", quality.gate_grounding(tokenized, vocab)), ("Items without a strong hit", ranking.zero_pass(stored)),
        ("Faulty lists", quality.list_faults(stored, n_chunks)), ("Tops of lists", top),
    )


def summary(seconds: dict[str, float], counts: dict) -> str:
    """Timings and counts of a run."""
    lines = ["# Run", ""] + [f"- {k}: {v:.2f} s" for k, v in seconds.items()] + [f"- {k}: {v}" for k, v in counts.items()]
    return "\n".join(lines) + "\n"
