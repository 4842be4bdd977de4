"""The queries of this engine over the driver's tables, and their DuckDB counterparts.

documents stand for chunks (doc_id is chunk_ord and chunk_id), benchmark for
items, embeddings for vectors, conversations for pages with headers. Scores are
ranked at six digits and shown at four.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import patterns as P
from clausework.functions import text as X
from clausework.operators import bm25, checklist, clean, outline, quality, ranking, serve
from clausework.operators import tables as T
from clausework.plans import index, layout_queries
from clausework.sources.scratch import stored


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), F.col("doc_id").alias("chunk_id"), "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    index.check_items(items)
    return items


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_ord"), F.col("vec_id").alias("chunk_id"), "embedding")


def _corpus(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens and vocabulary, both stored: several parts of a ranking read them."""
    tokenized = stored(bm25.corpus(chunks))
    return tokenized, stored(bm25.vocabulary(tokenized))


def _keyword(spark: SparkSession, chunks: DataFrame, items: DataFrame) -> DataFrame:
    return ranking.ranked_in_parts(bm25.keyword_scores(items, *_corpus(chunks), bm25.fixed_gate(spark)))


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("item_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score"), *more)


def keyword_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_keyword(spark, _chunks(spark, sf_dir), _items(spark, sf_dir)), "above_floor")


def keyword_ranking_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks, each list sorted as a whole."""
    scored = bm25.keyword_scores(_items(spark, sf_dir), *_corpus(_chunks(spark, sf_dir)), bm25.fixed_gate(spark))
    return _shown(ranking.ranked(scored), "above_floor")


def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(_corpus(_chunks(spark, sf_dir))[0]).select("chunk_ord", "term", "tf", "dl")


def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.rare_terms(_corpus(_chunks(spark, sf_dir))[1])
    return found.select("term", "df", F.round("idf", 4).alias("idf"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bm25.derive_gate(*_corpus(_chunks(spark, sf_dir)))
    digits = {c: F.round(c, 4) for c in ("high_idf_threshold", "min_score", "single_term_contribution_min")}
    return g.withColumns(digits)


def gate_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = quality.gate_grounding(*_corpus(_chunks(spark, sf_dir)))
    picks = [F.round(F.col("percentiles")[k], 4).alias(f"p{p}") for k, p in enumerate(quality.PERCENTILES)]
    return g.select("rare_vocab_size", "vocab_size", F.round("single_term_min", 4).alias("single_term_min"), F.round("below_5", 6).alias("below_5"), *picks)


def _keyword_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.entries(_keyword(spark, _chunks(spark, sf_dir), _items(spark, sf_dir)), "keyword", F.lit("B"))


def zero_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.zero_pass(_keyword_entries(spark, sf_dir))


def _faulty_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword lists with a missing chunk, a doubled rank or a missing mark in most of them."""
    e = _keyword_entries(spark, sf_dir)
    fault = F.col("item_id") % 4
    e = e.where((fault != 0) | (F.col("rank") != 3)).withColumn("rank", F.when((fault == 1) & (F.col("rank") == 2), 1).otherwise(F.col("rank")))
    return e.withColumn("above_floor", F.when((fault != 2) | (F.col("rank") != 5), F.col("above_floor")))


def full_list_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "documents").agg(F.count("*").alias("want"))
    lists = _faulty_entries(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.max("rank").alias("high"))
    return lists.crossJoin(F.broadcast(n))


def list_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "documents").count()
    return quality.list_faults(_faulty_entries(spark, sf_dir), n)


def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are missing, cut short or not finite."""
    v = _read(spark, sf_dir, "embeddings")
    broken = F.when(F.col("vec_id") % 7 == 1, None).when(F.col("vec_id") % 11 == 2, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 13 == 3, F.transform("embedding", lambda x: F.lit(float("inf")).cast("float"))).otherwise(F.col("embedding"))
    return quality.vector_faults(v.withColumn("embedding", broken), "vec_id")


def cosine_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is ranked for the vectors of all items of the benchmark."""
    v = _vectors(spark, sf_dir)
    items = _items(spark, sf_dir).join(v.select(F.col("chunk_ord").alias("item_id"), "embedding"), "item_id")
    return _shown(ranking.ranked_in_parts(ranking.semantic_scores(items.select("item_id", "embedding"), v)))


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    chunks = _chunks(spark, sf_dir).join(v.select("chunk_ord", "embedding"), "chunk_ord")
    items = _items(spark, sf_dir).join(v.select(F.col("chunk_ord").alias("item_id"), "embedding"), "item_id")
    k = _keyword(spark, chunks, items)
    s = ranking.ranked_in_parts(ranking.semantic_scores(items, chunks))
    return k, s, ranking.ranked_in_parts(ranking.fuse(k, s), digits=12, width=0.0005)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[2].select("item_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def hydrate_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _keyword_entries(spark, sf_dir).withColumnRenamed("item_id", "item")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source", "n_chars")
    return serve.hydrate(entries, docs, ("lang", "source", "n_chars")).select(F.col("item").alias("item_id"), "chunk_id", "rank", "lang", "source", "n_chars")


def slider_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = serve.eligible(_keyword_entries(spark, sf_dir))
    return serve.slider_bounds(pool, ["item_id"]).select("item_id", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "disabled")


def default_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.default_floor(_keyword_entries(spark, sf_dir), ["item_id"]).select("item_id", F.round("floor", 3).alias("floor"))


def shown_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = serve.eligible(_keyword_entries(spark, sf_dir))
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_ord"), "quality")
    return serve.shown(pool, 5.0, labels, ["chunk_id"]).select("item_id", "chunk_id", "quality", "join_missing")


def segment_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    # a user's turn stands for a page with a header; equal texts are one document that goes on
    heads = turns.where("role = 'user'").select("conv_id", "turn", F.col("role").alias("doc_id"), F.col("digest").alias("doc_name"))
    s = clean.segment(turns.select("conv_id", "turn"), heads, "conv_id", "turn")
    return s.select("conv_id", "turn", "is_start", "subdoc_idx", "cur_doc_id", "cur_doc_name")


def stitch_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    box = F.array(F.lit(10.0), F.col("l_linenumber") * 20.0, F.col("l_quantity") + 100, F.lit(700.0))
    raw = li.select(
        F.col("l_orderkey").cast("string").alias("source_pdf"), F.col("l_linenumber").alias("table_ord"), F.col("l_linenumber").alias("page"), box.alias("bbox"),
        F.array(F.array(F.col("l_returnflag"), F.col("l_linestatus"))).alias("rows"), F.lit(None).cast("array<array<array<double>>>").alias("cell_bboxes"), F.lit(2).alias("ncols"),
        (F.col("l_returnflag") == "R").alias("content_below"), (F.col("l_quantity") * 4).alias("gap_to_bottom"), "l_partkey", "l_suppkey",
    )
    raw = raw.withColumn("table_ord", F.row_number().over(Window.partitionBy("source_pdf").orderBy("page", "l_partkey", "l_suppkey")))
    return T.stitch(raw).select("source_pdf", F.col("stitch").cast("int").alias("stitch"), F.col("pages")[0].alias("page_start"), F.element_at("pages", -1).alias("page_end"), F.size("rows").alias("n_rows"))


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checklists of one item each, whose lines are those of the order; every third has a heading that its item nests under."""
    li = _read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    key, n = F.col("l_orderkey").cast("string"), F.row_number().over(order)
    rows = li.select("l_orderkey", key.alias("checklist"), n.alias("row_ord"), F.lit(1).alias("page"), (F.col("l_extendedprice") / 1000).alias("y0"), F.concat(F.lit("line "), n.cast("string")).alias("text"))
    lines = rows.select("checklist", "row_ord", "page", "y0", "text", F.when(F.col("row_ord") == 1, "item").otherwise("body").alias("kind"), F.when(F.col("row_ord") == 1, "2.1").alias("clause_no"), F.col("text").alias("title"))
    heads = rows.where("row_ord = 1").select("checklist", F.lit(0).alias("row_ord"), "page", F.lit(0.0).alias("y0"), F.lit("Heading").alias("text"), F.lit("heading").alias("kind"), F.when(F.col("l_orderkey") % 3 == 0, "2").otherwise("7").alias("clause_no"), F.lit("Heading").alias("title"))
    leaf = checklist.leaf_rows(lines.unionByName(heads))
    return leaf.groupBy("checklist").agg((F.max("para") + 1).alias("n_paragraphs"), F.count("*").alias("n_lines"))


def dedup_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("clause_no"))
    return outline.numbered_again(docs, ["lang"], "clause_no", ["doc_id"])


def column_gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("checklist"), F.col("p_retailprice").alias("x0"))
    g = checklist.column_gap(parts, "checklist", "x0")
    return g.select("checklist", "n", F.round("gap", 4).alias("gap"), F.round("threshold", 4).alias("threshold"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def heading_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat((F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, ". ").otherwise(" "))
    shaped = _lines(spark, sf_dir).withColumn("s", X.heading_shape(F.concat(number, F.col("text"))))
    return shaped.select("doc_id", "line", "s.clause_no", "s.clause_title", F.col("s").isNotNull().alias("numbered"))


def footer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 3 == 2, F.format_string("Page %d of 9", F.col("line") + 1)).otherwise(F.col("text")))
    y1 = 800.0 - (F.col("doc_id") % 200)
    return texts.where(~X.is_footer(F.col("text"), y1, F.lit(800.0))).groupBy("doc_id").agg(F.count("*").alias("kept"))


def parenthetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("line") % 2 == 0, F.concat(F.lit("("), F.col("text"), F.lit(")"))).otherwise(F.col("text"))
    found = _lines(spark, sf_dir).where(X.is_parenthetical(turned))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text") % 7
    kind = F.when(n == 0, "parenthetical").when(n == 1, "unnumbered_heading").when(n == 2, "numbered").when(n == 3, "table").otherwise("body")
    return _lines(spark, sf_dir).select("doc_id", "line", kind.alias("kind"))


def next_kind_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<boolean>")
    def ahead(column: pd.Series) -> pd.Series:
        return column.map(lambda kinds: outline.zero_body(list(kinds)))

    of = _kinds(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line", "kind"))).alias("ks"))
    each = of.withColumn("z", ahead(F.transform("ks", lambda k: k["kind"]))).select("doc_id", F.explode(F.arrays_zip("ks", "z")).alias("x"))
    return each.select("doc_id", "x.ks.line", "x.ks.kind", F.col("x.z").alias("zero_body"))


def _nation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    cell = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), cell, F.when(F.col("n_regionkey") < 2, F.lit("x"))).alias("r"))
    return n.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("rows"))


def table_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_rows(spark, sf_dir).select("n_regionkey", F.posexplode(T.serialize(F.col("rows"))).alias("line", "text"))


def empty_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _nation_rows(spark, sf_dir).withColumn("v", T.verdict(F.col("rows"), F.lit(3)))
    return v.select("n_regionkey", "v.verdict", "v.reason")


def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(_read(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unmatched(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "doc_id")


def _document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rows of subdocuments; some are numbered, in parentheses, or annex headings; short ones are bold."""
    r = _lines(spark, sf_dir).withColumn("text", X.strip(F.col("text"))).where("text <> ''")
    a, m, d = (F.floor(F.col("line") / 12) + 1).cast("string"), F.col("line") % 12, F.col("doc_id")
    before = (
        F.when((F.col("line") == 1) & (d % 9 == 0), "95.1 ").when(m == 1, F.concat(a, F.lit(".1 "))).when(m == 3, F.concat(a, F.lit(".1.2 "))).when((m == 4) & (d % 2 == 0), "(")
        .when(m == 5, F.concat(a, F.lit(".2 "))).when((m == 6) & (d % 5 == 0), "Annex B ").when((m == 7) & (d % 5 == 0), "1.1 ").when(m == 7, F.concat(a, F.lit(".2.4.1 "))).when(m == 8, F.concat(a, F.lit(". ")))
        .when(m == 10, F.concat(a, F.lit(".0 "))).when((m == 11) & (d % 7 == 0), "Annexure - C ").otherwise("")
    )
    text = F.concat(before, "text", F.when((m == 4) & (d % 2 == 0), ")").otherwise(""))
    block = F.when(d % 4 == 0, F.col("line")).otherwise(F.floor(F.col("line") / 2))
    return r.select(
        d.cast("string").alias("source_pdf"), F.lit(0).alias("subdoc_idx"), F.col("line").alias("row_ord"), text.alias("text"), (F.length("text") < 160).alias("all_bold"),
        (F.col("line") / 20 + 1).cast("int").alias("page"), F.concat(F.lit("b"), block.cast("string")).alias("block_id"), (m * 30.0).alias("y0"), F.lit(1).alias("n_lines"),
    )


def _document_outline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, and the folded outlines and subdocuments; every third document has two tables on its first pages."""
    rows = _document_rows(spark, sf_dir)
    d = _read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    cells = F.array(F.array(F.lit("Step"), F.lit(None).cast("string")), F.array(F.col("doc_id").cast("string"), F.col("page").cast("string")))
    box = F.array(F.lit(0.0), (F.col("doc_id") % 300).cast("double"), F.lit(500.0), F.lit(700.0))
    tables = d.select(
        F.col("doc_id").cast("string").alias("source_pdf"), F.lit(0).alias("subdoc_idx"), F.concat(F.lit("t"), F.col("page").cast("string")).alias("table_id"),
        F.col("page").alias("page_start"), (F.col("page") + 1).alias("page_end"), cells.alias("rows"), F.create_map("page", box).alias("bbox_by_page"),
    )
    subdocs = rows.select("source_pdf", "subdoc_idx").distinct().select("*", F.concat(F.lit("D"), "source_pdf").alias("doc_id"), F.lit("document").alias("doc_name"))
    return rows, outline.outlines(rows, tables, subdocs), subdocs


def chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folded, subdocs = _document_outline(spark, sf_dir)
    c = outline.chunks_table(folded, subdocs)
    path = F.array_join(F.transform("ancestor_path", lambda x: F.coalesce(x["clause_no"], F.lit(""))), "/")
    return c.select("chunk_id", "clause_no", "clause_title", path.alias("path"), F.size("ancestor_path").alias("depth"), F.size("lead_lines").alias("leads"), F.md5("text").alias("text_md5"), F.size("table_ids").alias("n_tables"), "page_start", "page_end")


def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and tables of the same documents, classified and in order, and where each went."""
    e = outline.events_table(_document_outline(spark, sf_dir)[1])
    return e.select("source_pdf", "ev_ord", "kind", "clause_no", "annex_letter", "table_id", "bucket")


def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same documents' events some are taken away, or their bucket is; their lines are unaccounted."""
    rows, folded, _ = _document_outline(spark, sf_dir)
    e = outline.events_table(folded).where("table_id IS NOT NULL OR length(text) % 11 <> 5")
    e = e.withColumn("bucket", F.when(F.col("table_id").isNotNull() | (F.length("text") % 13 != 6), F.col("bucket")))
    return quality.coverage(e, rows).select("source_pdf", "total_raw_lines", (F.col("bucket_a") + F.col("bucket_b") + F.col("bucket_d")).alias("placed"), "unaccounted", "n_tables_attached")


def homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents' blocks by how bold they are."""
    rows, folded, _ = _document_outline(spark, sf_dir)
    return quality.homogeneity(outline.row_facts(rows), outline.events_table(folded))


def _checklist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of checklists, one for each of many customers: headings, items and wrapped text by their place."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("i"))
    o = o.withColumn("n", F.count("*").over(Window.partitionBy("o_custkey"))).where("n >= 5")
    i, top = F.col("i"), F.floor((F.col("i") - 1) / 6) + 1
    sub = (i - 1) % 6
    lone = (sub == 1) & (F.col("o_custkey") % 5 == 0)
    deeper = (F.col("o_custkey") % 3 == 0) & (top % 2 == 0)
    text = (
        F.when(lone, F.format_string("nothing is open at %d", "o_orderkey")).when((sub == 0) & deeper, F.format_string("%d.9 Heading", top - 1)).when(sub == 0, F.format_string("%d Heading", top)).when(sub == 1, F.format_string("%d.%d Item of order %d", top, sub, "o_orderkey")).when(sub == 2, F.format_string("2 wrapped words of %d", "o_orderkey"))
        .when(sub == 3, F.when(F.col("o_custkey") % 2 == 0, F.format_string("%d.1 Item that comes again", top)).otherwise(F.format_string("%d. Item elsewhere", top + 40))).otherwise(F.format_string("more text of %d", "o_orderkey"))
    )
    return o.select(
        F.col("o_custkey").cast("string").alias("checklist"), i.alias("row_ord"), (i / 40 + 1).cast("int").alias("page"), (i % 40 * F.when(sub == 4, 12.0).otherwise(16.0)).alias("y0"),
        F.when(sub.isin(0, 1, 3) & ~lone, 40.0).otherwise(120.0).alias("x0"), (sub == 0).alias("bold"), text.alias("text"),
    )


def checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.items(_checklist_rows(spark, sf_dir)).select("checklist", "item_ord", "item_id", F.size("ancestor_path").alias("depth"), F.md5("text").alias("text_md5"), "page_start", "page_end")


def checklist_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.parse_report(_checklist_rows(spark, sf_dir))


_QUERIES = (
    keyword_ranking, keyword_ranking_whole, token_store, rare_terms, gate, gate_grounding, zero_pass, full_list_check, list_faults, vector_check, cosine_ranking, rrf_fusion, hydrate_mapping, slider_pool,
    default_floor, shown_candidates, segment_carry_forward, stitch_islands, paragraph_split, dedup_suffix, column_gap_threshold, heading_shape, footer_filter, parenthetical, next_kind_lookahead,
    table_serialise, empty_verdict, uniqueness_check, key_check, chunk_tree, event_kinds, line_coverage, homogeneity, checklist_items, checklist_report,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | layout_queries.queries()


# --- DuckDB ---------------------------------------------------------------

_K = f"{P.K1}::DOUBLE"
_PART = f"idf * (tf * ({_K} + 1)) / (tf + {_K} * (1 - {P.B}::DOUBLE + {P.B}::DOUBLE * dl / avgdl))"


def _corpus_sql(chunks: str = "SELECT doc_id AS chunk_ord, text FROM documents") -> str:
    return f"""
c0 AS ({chunks}),
c AS (SELECT chunk_ord, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS tokens FROM c0),
size AS (SELECT count(*) AS n_chunks, avg(len(tokens))::DOUBLE AS avgdl FROM c),
post AS (SELECT chunk_ord, dl, term, count(*) AS tf FROM (SELECT chunk_ord, len(tokens) AS dl, unnest(tokens) AS term FROM c) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, n_chunks, avgdl, ln(n_chunks - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, size),
vocab AS (SELECT term, df, n_chunks, avgdl, CASE WHEN raw < 0 THEN {P.EPSILON}::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _keyword_sql(items: str = "SELECT item_id, text FROM benchmark") -> str:
    return f"""
it AS ({items}),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM it) GROUP BY ALL),
sparse AS (SELECT item_id, chunk_ord, sum(qf * {_PART}) AS score, sum((idf >= {P.HIGH_IDF})::INT) AS rare
  FROM q JOIN post USING (term) JOIN vocab USING (term) GROUP BY ALL),
dense AS (SELECT i.item_id, c.chunk_ord, coalesce(score, 0) AS score, coalesce(rare, 0) AS rare FROM it i CROSS JOIN c LEFT JOIN sparse s ON s.item_id = i.item_id AND s.chunk_ord = c.chunk_ord),
kw AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, chunk_ord)::INT AS rank, rare >= {P.MIN_HIGH_IDF_TERMS} AND score >= {P.MIN_SCORE} AS above_floor FROM dense)"""


_ALL = f"WITH {_corpus_sql()}, {_keyword_sql()}"
_FAULTY = """faulty AS (SELECT item_id, chunk_ord, CASE WHEN item_id % 4 = 1 AND rank = 2 THEN 1 ELSE rank END AS rank,
  CASE WHEN item_id % 4 <> 2 OR rank <> 5 THEN above_floor END AS above_floor FROM kw WHERE item_id % 4 <> 0 OR rank <> 3)"""
_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_LINES = "lines AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1))::INT AS line, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"
_FOOTER = P.FOOTER.replace("'", "''")
_NATION = """t AS (SELECT n_regionkey, list([n_nationkey::VARCHAR, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, CASE WHEN n_regionkey < 2 THEN 'x' END] ORDER BY n_nationkey) AS rows FROM nation GROUP BY ALL)"""
_BLANK = "coalesce(trim({}), '') = ''"
_TRIM = "trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
#: Rows, events and chunks of documents, step by step, from the kinds of rows to the texts of chunks.
_OUTLINE = f"""RECURSIVE {_LINES},
raw AS (SELECT doc_id AS d, line, {_TRIM} AS t, line // 12 + 1 AS a, line % 12 AS m FROM lines WHERE {_TRIM} <> ''),
rows AS (SELECT d, line AS o, CASE WHEN line = 1 AND d % 9 = 0 THEN '95.1 ' WHEN m = 1 THEN a || '.1 ' WHEN m = 3 THEN a || '.1.2 ' WHEN m = 4 AND d % 2 = 0 THEN '(' WHEN m = 5 THEN a || '.2 '
    WHEN m = 6 AND d % 5 = 0 THEN 'Annex B ' WHEN m = 7 AND d % 5 = 0 THEN '1.1 ' WHEN m = 7 THEN a || '.2.4.1 ' WHEN m = 8 THEN a || '. ' WHEN m = 10 THEN a || '.0 ' WHEN m = 11 AND d % 7 = 0 THEN 'Annexure - C ' ELSE '' END
    || t || CASE WHEN m = 4 AND d % 2 = 0 THEN ')' ELSE '' END AS text, length(t) < 160 AS bold, (line // 20 + 1)::INT AS page, CASE WHEN d % 4 = 0 THEN line ELSE line // 2 END AS block, m * 30.0::DOUBLE AS y FROM raw),
shaped AS (SELECT *, regexp_matches(text, '{P.PARENTHETICAL}') AS paren, regexp_extract(text, '{P.NUMBERED}', 1) AS n1, regexp_extract(text, '{P.NUMBERED}', 2) AS t1, regexp_extract(text, '{P.NUMBERED_PERIOD}', 1) AS n2, regexp_extract(text, '{P.NUMBERED_PERIOD}', 2) AS t2,
    nullif(regexp_extract(text, '{P.ANNEX}', 1), '') AS annex, nullif(regexp_extract(text, '(?i){P.ANNEXURE}', 1), '') AS annexure FROM rows),
numbered AS (SELECT *, CASE WHEN n1 <> '' THEN n1 WHEN n2 <> '' AND len(regexp_split_to_array(trim(t2), '\\s+')) <= {P.PERIOD_TITLE_WORDS} THEN n2 END AS no, CASE WHEN n1 <> '' THEN trim(t1) ELSE trim(t2) END AS title FROM shaped),
facts AS (SELECT *, count(*) OVER b AS block_rows, count(*) FILTER (NOT paren AND no IS NOT NULL) OVER b AS candidates, bool_and(bold) OVER b AS solid,
    coalesce(first_value(CASE WHEN NOT paren THEN coalesce(split_part(no, '.', 1)::BIGINT, 0) END IGNORE NULLS) OVER (PARTITION BY d ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 1, false) AS restart
    FROM numbered WINDOW b AS (PARTITION BY d, block)),
letters AS (SELECT *, coalesce(CASE WHEN bold THEN annex END, CASE WHEN block_rows = 1 AND restart THEN annexure END) AS letter, CASE WHEN bold AND solid THEN 'unnumbered_heading' ELSE 'body' END AS other FROM facts),
kinds AS (SELECT *, CASE WHEN paren THEN 'parenthetical' WHEN letter IS NOT NULL THEN 'annex' WHEN no IS NOT NULL AND candidates <= {P.NUMBERED_PER_BLOCK} THEN 'candidate' ELSE other END AS k FROM letters),
cand AS (SELECT d, o, split_part(no, '.', 1)::BIGINT AS top, bold, row_number() OVER (PARTITION BY d ORDER BY o) AS n FROM kinds WHERE k = 'candidate'),
seen(d, o, n, high, ok) AS (
  SELECT d, o, n, CASE WHEN bold AND top <= {P.FIRST_TOP_LEVEL} THEN top ELSE 0 END, bold AND top <= {P.FIRST_TOP_LEVEL} FROM cand WHERE n = 1
  UNION ALL
  SELECT c.d, c.o, c.n, CASE WHEN CASE WHEN high = 0 THEN bold AND top <= {P.FIRST_TOP_LEVEL} ELSE top <= high + {P.TOP_LEVEL_JUMP} END THEN greatest(high, top) ELSE high END,
    CASE WHEN high = 0 THEN bold AND top <= {P.FIRST_TOP_LEVEL} ELSE top <= high + {P.TOP_LEVEL_JUMP} END FROM seen s JOIN cand c ON c.d = s.d AND c.n = s.n + 1),
tabs AS (SELECT doc_id AS d, p AS page, (doc_id % 300)::DOUBLE AS y FROM documents, (VALUES (1), (2)) v(p) WHERE doc_id % 3 = 0),
placed AS (SELECT t.*, coalesce((SELECT min(o) FROM rows r WHERE r.d = t.d AND (r.page, r.y) > (t.page, t.y)), 1000000000) - 0.5 AS o FROM tabs t),
stream AS (
  SELECT d, o::DOUBLE AS o, 0 AS sub, CASE WHEN k = 'candidate' THEN CASE WHEN ok THEN 'numbered' ELSE other END ELSE k END AS kind, no, title, letter, text, page, page AS last, NULL::VARCHAR AS tid FROM kinds LEFT JOIN seen USING (d, o)
  UNION ALL SELECT d, o, page, 'table', NULL, NULL, NULL, 'Step{P.CELL_SEPARATOR}' || chr(10) || d || '{P.CELL_SEPARATOR}' || page, page, page + 1, 't' || page FROM placed),
ev AS (SELECT d, row_number() OVER w AS i, kind, CASE WHEN kind = 'numbered' THEN no END AS no, CASE WHEN kind = 'numbered' THEN title ELSE text END AS title, CASE WHEN kind = 'annex' THEN letter END AS letter, text, page, last, tid,
    coalesce(first_value(CASE WHEN kind <> 'parenthetical' THEN kind END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) NOT IN ('body', 'table'), true) AS hollow,
    count(*) FILTER (kind = 'annex') OVER (w ROWS UNBOUNDED PRECEDING) AS seg, last_value(CASE WHEN kind = 'annex' THEN letter END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS in_annex,
    last_value(CASE WHEN kind = 'annex' THEN text END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS annex_line
    FROM stream WINDOW w AS (PARTITION BY d ORDER BY o, sub)),
states AS (SELECT *, kind IN ('numbered', 'unnumbered_heading') AND NOT hollow AS heads, kind IN ('body', 'table') AS content,
    CASE WHEN kind IN ('numbered', 'unnumbered_heading', 'annex') THEN kind <> 'annex' AND NOT hollow WHEN kind IN ('body', 'table') THEN true END AS state FROM ev),
opened AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was FROM states),
marked AS (SELECT *, heads OR (content AND NOT was) AS starts, sum((heads OR (content AND NOT was))::INT) OVER (PARTITION BY d ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM opened)"""
_CHUNKS = f"""nums AS (SELECT *, CASE WHEN len(p) > 1 AND p[-1] = 0 THEN p[:-2] ELSE p END AS key FROM (SELECT d, i, seg, no, title, text, hollow, list_transform(string_split(no, '.'), lambda x: x::BIGINT) AS p FROM marked WHERE kind = 'numbered')),
steps AS (SELECT n.d, n.i, n.seg, n.key[:k] AS key, k FROM nums n, unnest(generate_series(1, len(n.key) - 1)) u(k)),
above AS (SELECT s.d, s.i, s.k, max(n.i) AS at FROM steps s LEFT JOIN nums n ON n.d = s.d AND n.seg = s.seg AND n.key = s.key AND n.i < s.i GROUP BY ALL),
paths AS (SELECT a.d, a.i, list(coalesce(n.no, s.key[1]::VARCHAR) ORDER BY a.k) AS path, list(coalesce(n.text, s.key[1]::VARCHAR) ORDER BY a.k) AS lines
  FROM above a JOIN steps s ON s.d = a.d AND s.i = a.i AND s.k = a.k LEFT JOIN nums n ON n.d = a.d AND n.i = a.at WHERE a.at IS NOT NULL OR a.k = 1 GROUP BY a.d, a.i),
used AS (SELECT d, seg, key, i FROM nums UNION ALL SELECT d, seg, key, i FROM steps WHERE k = 1),
firsts AS (SELECT d, seg, key, min(i) AS first FROM used GROUP BY ALL),
lasts AS (SELECT d, seg, key, max(i) AS i FROM nums GROUP BY ALL),
rescued AS (SELECT n.d, n.seg, n.text, f.first, len(n.key) AS len FROM lasts l JOIN nums n ON n.d = l.d AND n.i = l.i JOIN firsts f ON f.d = n.d AND f.seg = n.seg AND f.key = n.key
  WHERE n.hollow AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.d = n.d AND s.seg = n.seg AND s.i > n.i AND s.key = n.key)),
ends AS (SELECT d, max(i) + 1 AS e, max(seg) AS seg FROM marked GROUP BY d),
pending AS (
  SELECT r.d, coalesce(m.i, e.e) AS i, 0 AS step, r.first, r.len, r.text FROM rescued r JOIN ends e ON e.d = r.d LEFT JOIN marked m ON m.d = r.d AND m.kind = 'annex' AND m.seg = r.seg + 1
  UNION ALL SELECT d, i, 1, 0, 0, text FROM marked WHERE kind = 'annex' OR (kind = 'unnumbered_heading' AND hollow) OR (kind = 'parenthetical' AND NOT was)),
lead AS (SELECT p.d, coalesce((SELECT min(m.c) FROM marked m WHERE m.d = p.d AND m.starts AND m.i > p.i), 1000000000) AS c, list(p.text ORDER BY p.i, p.step, p.first, p.len) AS ls FROM pending p GROUP BY ALL),
heads AS (SELECT m.*, CASE WHEN kind = 'unnumbered_heading' OR in_annex IS NULL THEN []::VARCHAR[] ELSE [''] END || coalesce(p.path, []::VARCHAR[]) AS path, CASE WHEN kind = 'unnumbered_heading' OR in_annex IS NULL THEN []::VARCHAR[] ELSE [annex_line] END || coalesce(p.lines, []::VARCHAR[]) AS plines
  FROM marked m LEFT JOIN paths p USING (d, i) WHERE starts),
bodies AS (SELECT d, c, list(text ORDER BY i) FILTER (content OR kind = 'parenthetical') AS ls, count(tid) AS n_tables, max(CASE WHEN starts AND NOT content THEN page ELSE last END) AS page_end FROM marked WHERE starts OR content OR (kind = 'parenthetical' AND was) GROUP BY d, c),
top AS (SELECT d, max(c) AS c FROM marked GROUP BY d),
made AS (SELECT h.d, h.c, CASE WHEN h.kind = 'numbered' THEN CASE WHEN in_annex IS NULL THEN '' ELSE 'Annex ' || in_annex || '/' END || no END AS no,
    CASE WHEN h.content THEN coalesce(l.ls[-1], 'document') ELSE title END AS title, path, plines, coalesce(l.ls, []::VARCHAR[]) || coalesce(z.ls, []::VARCHAR[]) AS leads, CASE WHEN NOT h.content THEN text END AS line, coalesce(b.ls, []::VARCHAR[]) AS body, n_tables, page, page_end
  FROM heads h JOIN bodies b ON b.d = h.d AND b.c = h.c LEFT JOIN lead l ON l.d = h.d AND l.c = h.c LEFT JOIN top t ON t.d = h.d AND t.c = h.c LEFT JOIN lead z ON z.d = t.d AND z.c = 1000000000
  UNION ALL SELECT z.d, 1, NULL::VARCHAR, z.ls[-1], []::VARCHAR[], []::VARCHAR[], z.ls, NULL::VARCHAR, []::VARCHAR[], 0, m.page, m.page FROM lead z JOIN top t ON t.d = z.d AND t.c = 0 JOIN ends e ON e.d = z.d JOIN marked m ON m.d = z.d AND m.i = e.e - 1 WHERE z.c = 1000000000)"""
#: Checklists from rows to paragraphs of items.
_CHECKLISTS = f"""o AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT *, (i - 1) // 6 + 1 AS top, (i - 1) % 6 AS sub FROM o WHERE n >= 5),
rows AS (SELECT k, i, i // 40 + 1 AS page, (i % 40 * CASE WHEN sub = 4 THEN 12.0 ELSE 16.0 END)::DOUBLE AS y, CASE WHEN sub IN (0, 3) OR (sub = 1 AND k % 5 <> 0) THEN 40.0 ELSE 120.0 END AS x, sub = 0 AS bold,
  CASE WHEN sub = 1 AND k % 5 = 0 THEN 'nothing is open at ' || id WHEN sub = 0 AND k % 3 = 0 AND top % 2 = 0 THEN (top - 1) || '.9 Heading' WHEN sub = 0 THEN top || ' Heading' WHEN sub = 1 THEN top || '.1 Item of order ' || id WHEN sub = 2 THEN '2 wrapped words of ' || id
    WHEN sub = 3 AND k % 2 = 0 THEN top || '.1 Item that comes again' WHEN sub = 3 THEN (top + 40) || '. Item elsewhere' ELSE 'more text of ' || id END AS text FROM s),
sh AS (SELECT *, regexp_extract(text, '{P.CHECKLIST_NUMBERED}', 1) AS no, regexp_extract(text, '{P.CHECKLIST_NUMBERED}', 2) AS title FROM rows),
gaps AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY x) AS z FROM (SELECT DISTINCT k, x FROM sh WHERE no <> '')),
limits AS (SELECT k, arg_max((x + z) / 2, z - x) AS threshold FROM gaps GROUP BY k),
kinds AS (SELECT sh.*, threshold, CASE WHEN no = '' OR x >= threshold THEN 'body' WHEN bold THEN 'heading' ELSE 'item' END AS kind FROM sh JOIN limits USING (k)),
opened AS (SELECT *, last_value(CASE WHEN kind <> 'body' THEN kind END IGNORE NULLS) OVER w AS okind, last_value(CASE WHEN kind <> 'body' THEN i END IGNORE NULLS) OVER w AS oi, last_value(CASE WHEN kind <> 'body' THEN no END IGNORE NULLS) OVER w AS ono,
  last_value(CASE WHEN kind = 'heading' THEN no END IGNORE NULLS) OVER w AS hno FROM kinds WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
leaf AS (SELECT *, CASE WHEN okind = 'item' THEN oi + 1 ELSE 0 END AS item FROM opened WHERE kind <> 'heading'),
far AS (SELECT *, (NOT coalesce(ono = hno OR starts_with(ono, hno || '.'), false) AND coalesce(y - lag(y) OVER (PARTITION BY k, item ORDER BY i) > {P.PARAGRAPH_GAP}, false))::INT AS f FROM leaf),
paras AS (SELECT *, sum(f) OVER (PARTITION BY k, item ORDER BY i ROWS UNBOUNDED PRECEDING) AS para FROM far),
made AS (SELECT k, item, para, any_value(ono) AS no, any_value(len(string_split(hno, '.'))) AS depth, string_agg(CASE WHEN kind = 'item' THEN title ELSE text END, chr(10) ORDER BY i) AS text, min(page) AS page_start, max(page) AS page_end FROM paras WHERE item > 0 GROUP BY ALL)"""
_RANKING = "SELECT item_id, chunk_ord AS chunk_id, rank, round(score, 4) AS score, above_floor FROM kw"

_SQL = {
    "keyword_ranking": f"{_ALL} {_RANKING}",
    "keyword_ranking_whole": f"{_ALL} {_RANKING}",
    "token_store": f"WITH {_corpus_sql()} SELECT chunk_ord, term, tf, dl::INT AS dl FROM post",
    "rare_terms": f"WITH {_corpus_sql()} SELECT term, df, round(idf, 4) AS idf FROM vocab WHERE idf >= {P.HIGH_IDF}",
    "gate": f"""WITH {_corpus_sql()},
t AS (SELECT ln(n_chunks - {P.RARE_DF} + 0.5::DOUBLE) - ln({P.RARE_DF} + 0.5::DOUBLE) AS exact FROM size),
s AS (SELECT {_PART} AS c FROM post JOIN vocab USING (term), t WHERE idf >= exact)
SELECT round((SELECT exact FROM t), 4) AS high_idf_threshold, {P.MIN_HIGH_IDF_TERMS} AS min_high_idf_terms,
  round(coalesce((SELECT quantile_cont(c, {P.MIN_SCORE_PERCENTILE}) FROM s), 0), 4) AS min_score, n_chunks,
  (SELECT count(*) FROM vocab, t WHERE idf >= exact) AS rare_vocab_size, (SELECT count(*) FROM vocab) AS vocab_size,
  round((SELECT min(c) FROM s), 4) AS single_term_contribution_min, (SELECT count(*) FROM s) AS single_term_contribution_n FROM size""",
    "gate_grounding": f"""WITH {_corpus_sql()}, s AS (SELECT {_PART} AS c FROM post JOIN vocab USING (term) WHERE idf >= {P.HIGH_IDF})
SELECT (SELECT count(*) FROM vocab WHERE idf >= {P.HIGH_IDF}) AS rare_vocab_size, (SELECT count(*) FROM vocab) AS vocab_size, round(min(c), 4) AS single_term_min,
  round(avg((c < 5.0)::INT), 6) AS below_5, {', '.join(f'round(quantile_cont(c, {p / 100}), 4) AS p{p}' for p in quality.PERCENTILES)} FROM s""",
    "zero_pass": f"{_ALL}, a AS (SELECT item_id, bool_or(above_floor) AS x FROM kw GROUP BY item_id) SELECT 'B' AS checklist, count(*) AS n_items, count(*) FILTER (NOT x) AS zero_pass FROM a",
    "full_list_check": f"{_ALL}, {_FAULTY} SELECT item_id, count(*) AS n, count(DISTINCT chunk_ord) AS ids, max(rank) AS high, (SELECT count(*) FROM documents) AS want FROM faulty GROUP BY item_id",
    "list_faults": f"""{_ALL}, {_FAULTY}, l AS (SELECT item_id, count(*) AS n, count(DISTINCT chunk_ord) AS ids, min(rank) AS low, max(rank) AS high, count(DISTINCT rank) AS ranks, count(above_floor) AS marks FROM faulty GROUP BY item_id)
SELECT 'B' AS checklist, item_id, 'keyword' AS view, n, ids, low, high, ranks, marks FROM l, (SELECT count(*) AS want FROM documents) WHERE NOT (n = want AND ids = want AND low = 1 AND high = want AND ranks = want AND marks = want)""",
    "vector_check": "SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN 'missing' WHEN vec_id % 11 = 2 THEN 'length' ELSE 'not finite' END AS fault FROM embeddings WHERE vec_id % 7 = 1 OR vec_id % 11 = 2 OR vec_id % 13 = 3",
    "cosine_ranking": f"""SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, chunk_id)::INT AS rank, round(s, 4) AS score
FROM (SELECT a.vec_id AS item_id, b.vec_id AS chunk_id, {_COSINE} AS s FROM embeddings a SEMI JOIN benchmark ON item_id = a.vec_id, embeddings b)""",
    "rrf_fusion": f"""WITH {_corpus_sql("SELECT doc_id AS chunk_ord, text FROM documents JOIN embeddings ON doc_id = vec_id")}, {_keyword_sql("SELECT item_id, text FROM benchmark JOIN embeddings ON item_id = vec_id")},
sem AS (SELECT i.item_id, c.chunk_ord, row_number() OVER (PARTITION BY i.item_id ORDER BY round({_COSINE}, 6) DESC, c.chunk_ord) AS rank
  FROM it i JOIN embeddings a ON a.vec_id = i.item_id CROSS JOIN c JOIN embeddings b ON b.vec_id = c.chunk_ord),
f AS (SELECT kw.item_id, kw.chunk_ord, 1.0::DOUBLE / ({P.RRF_K} + kw.rank) + 1.0::DOUBLE / ({P.RRF_K} + sem.rank) AS score FROM kw JOIN sem USING (item_id, chunk_ord))
SELECT item_id, chunk_ord AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, chunk_ord)::INT AS rank, round(score, 6) AS score FROM f""",
    "hydrate_mapping": f"{_ALL} SELECT item_id, chunk_ord AS chunk_id, rank, lang, source, n_chars FROM kw JOIN documents ON doc_id = chunk_ord",
    "slider_pool": f"{_ALL} SELECT item_id, round(round(min(score), 6), 3) AS low, round(round(max(score), 6), 3) AS high, round(min(score), 6) >= round(max(score), 6) AS disabled FROM kw WHERE above_floor GROUP BY item_id",
    "default_floor": f"{_ALL} SELECT item_id, round(round(arg_max(score, rank), 6), 3) AS floor FROM kw WHERE rank <= {serve.TOP_K} GROUP BY item_id",
    "shown_candidates": f"{_ALL} SELECT item_id, chunk_ord AS chunk_id, quality, doc_id IS NULL AS join_missing FROM kw LEFT JOIN labels ON doc_id = chunk_ord WHERE above_floor AND round(score, 6) >= 5.0",
    "segment_carry_forward": """WITH t AS (SELECT conv_id, turn, role, md5(text) AS i FROM conversations),
h AS (SELECT *, lag(i) OVER w IS DISTINCT FROM i OR row_number() OVER w = 1 AS s FROM t WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT t.conv_id, t.turn, coalesce(h.s, false) AS is_start, h.role AS doc_id, h.i AS doc_name FROM t LEFT JOIN h USING (conv_id, turn))
SELECT conv_id, turn, is_start, (sum(is_start::INT) OVER w - 1)::INT AS subdoc_idx,
  last_value(CASE WHEN is_start THEN doc_id END IGNORE NULLS) OVER w AS cur_doc_id, last_value(CASE WHEN is_start THEN doc_name END IGNORE NULLS) OVER w AS cur_doc_name
FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    "stitch_islands": f"""WITH r AS (SELECT l_orderkey, l_linenumber AS page, l_quantity AS q, l_returnflag = 'R' AS below, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem),
n AS (SELECT *, CASE WHEN lag(page) OVER w + 1 = page AND NOT lag(below) OVER w AND lag(q) OVER w * 4 < {P.STITCH_GAP} AND page * 20.0 < {P.STITCH_TOP} AND abs(lag(q) OVER w - q) < {P.STITCH_X} THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)),
s AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY o ROWS UNBOUNDED PRECEDING) AS stitch FROM n)
SELECT l_orderkey::VARCHAR AS source_pdf, stitch::INT AS stitch, arg_min(page, o) AS page_start, arg_max(page, o) AS page_end, count(*)::INT AS n_rows FROM s GROUP BY l_orderkey, stitch""",
    "paragraph_split": f"""WITH r AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 <> 0 AND l_extendedprice / 1000 - lag(l_extendedprice / 1000) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) > {P.PARAGRAPH_GAP} THEN 1 ELSE 0 END AS far FROM lineitem)
SELECT l_orderkey::VARCHAR AS checklist, (sum(far) + 1)::BIGINT AS n_paragraphs, count(*) AS n_lines FROM r GROUP BY l_orderkey""",
    "dedup_suffix": """SELECT doc_id, lang, source || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS clause_no
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)""",
    "column_gap_threshold": """WITH g AS (SELECT p_brand, p_retailprice AS x, lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS y FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY y - x DESC NULLS LAST, x) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM g)
SELECT p_brand AS checklist, n, round(y - x, 4) AS gap, round((x + y) / 2, 4) AS threshold FROM b WHERE k = 1""",
    "heading_shape": f"""WITH {_LINES}, t AS (SELECT doc_id, line, (doc_id % 40) || CASE WHEN doc_id % 3 = 0 THEN '. ' ELSE ' ' END || text AS text FROM lines),
m AS (SELECT doc_id, line, regexp_extract(text, '{P.NUMBERED}', 1) AS a, regexp_extract(text, '{P.NUMBERED}', 2) AS title, regexp_extract(text, '{P.NUMBERED_PERIOD}', 1) AS p, regexp_extract(text, '{P.NUMBERED_PERIOD}', 2) AS pt FROM t),
w AS (SELECT *, a <> '' AS x, a = '' AND p <> '' AND len(regexp_split_to_array(trim(pt), '\\s+')) <= {P.PERIOD_TITLE_WORDS} AS y FROM m)
SELECT doc_id, line, CASE WHEN x THEN a WHEN y THEN p END AS clause_no, CASE WHEN x THEN trim(title) WHEN y THEN trim(pt) END AS clause_title, x OR y AS numbered FROM w""",
    "footer_filter": f"""WITH {_LINES}, t AS (SELECT doc_id, CASE WHEN line % 3 = 2 THEN 'Page ' || (line + 1) || ' of 9' ELSE text END AS text FROM lines)
SELECT doc_id, count(*) AS kept FROM t WHERE NOT (doc_id % 200 <= {P.FOOTER_BAND} AND regexp_matches(text, '(?i){_FOOTER}')) GROUP BY doc_id""",
    "parenthetical": f"""WITH {_LINES} SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(CASE WHEN line % 2 = 0 THEN '(' || text || ')' ELSE text END, '{P.PARENTHETICAL}') GROUP BY doc_id""",
    "next_kind_lookahead": f"""WITH {_LINES}, k AS (SELECT doc_id, line, CASE length(text) % 7 WHEN 0 THEN 'parenthetical' WHEN 1 THEN 'unnumbered_heading' WHEN 2 THEN 'numbered' WHEN 3 THEN 'table' ELSE 'body' END AS kind FROM lines)
SELECT doc_id, line, kind, coalesce(first_value(CASE WHEN kind <> 'parenthetical' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) NOT IN ('body', 'table'), true) AS zero_body FROM k""",
    "table_serialise": f"""WITH {_NATION} SELECT n_regionkey, unnest(generate_series(0, len(rows) - 1))::INT AS line, unnest(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), '{P.CELL_SEPARATOR}'))) AS text FROM t""",
    "empty_verdict": f"""WITH {_NATION}, v AS (SELECT n_regionkey, len(list_filter(flatten(rows), lambda c: NOT ({_BLANK.format('c')}))) = 0 AS empty_, len(list_filter(CASE WHEN len(rows) > 1 THEN rows[2:] ELSE rows END, lambda r: NOT ({_BLANK.format('r[-1]')}))) = 0 AS last_ FROM t)
SELECT n_regionkey, CASE WHEN empty_ OR last_ THEN 'DISCARD' ELSE 'KEEP' END AS verdict, CASE WHEN empty_ THEN 'entirely empty' WHEN last_ THEN 'rightmost column blank on every data row' ELSE 'has content' END AS reason FROM v""",
    "chunk_tree": f"""WITH {_OUTLINE}, {_CHUNKS}
SELECT 'D' || d || '__c' || printf('%03d', c) AS chunk_id, no || CASE WHEN row_number() OVER (PARTITION BY d, no ORDER BY c) > 1 THEN '#' || row_number() OVER (PARTITION BY d, no ORDER BY c) ELSE '' END AS clause_no, title AS clause_title,
  array_to_string(path, '/') AS path, len(path)::INT AS depth, len(leads)::INT AS leads, md5(array_to_string(plines || leads || CASE WHEN line IS NULL THEN []::VARCHAR[] ELSE [line] END || body, chr(10))) AS text_md5, n_tables::INT AS n_tables, page AS page_start, page_end FROM made""",
    "event_kinds": f"""WITH {_OUTLINE} SELECT d::VARCHAR AS source_pdf, (i - 1)::INT AS ev_ord, kind, no AS clause_no, letter AS annex_letter, tid AS table_id, CASE kind WHEN 'table' THEN 'TABLE' WHEN 'body' THEN 'A' ELSE 'B' END AS bucket FROM ev""",
    "line_coverage": f"""WITH {_OUTLINE}, n AS (SELECT d, count(*) AS n FROM rows GROUP BY d)
SELECT d::VARCHAR AS source_pdf, any_value(n) AS total_raw_lines, count(*) FILTER (tid IS NULL AND length(text) % 11 <> 5 AND length(text) % 13 <> 6) AS placed,
  any_value(n) - count(*) FILTER (tid IS NULL AND length(text) % 11 <> 5 AND length(text) % 13 <> 6) AS unaccounted, count(tid) AS n_tables_attached FROM ev JOIN n USING (d) GROUP BY d""",
    "checklist_items": f"""WITH {_CHECKLISTS}, named AS (SELECT *, no || CASE WHEN row_number() OVER a > 1 THEN '#' || row_number() OVER a ELSE '' END AS named FROM made WINDOW a AS (PARTITION BY k, no ORDER BY item, para))
SELECT k::VARCHAR AS checklist, (row_number() OVER (PARTITION BY k ORDER BY item, para) - 1)::INT AS item_ord, k || '__' || named AS item_id, depth::INT AS depth, md5(text) AS text_md5, page_start::INT AS page_start, page_end::INT AS page_end FROM named""",
    "checklist_report": f"""WITH {_CHECKLISTS}, c AS (SELECT k, count(*) FILTER (kind = 'heading') AS n_headings, count(*) FILTER (kind = 'item') AS n_items_raw, any_value(threshold)::DOUBLE AS threshold FROM kinds GROUP BY k),
m AS (SELECT k, count(*) AS n FROM made GROUP BY k), l AS (SELECT k, count(*) AS n FROM leaf WHERE item = 0 GROUP BY k)
SELECT k::VARCHAR AS checklist, n_headings, n_items_raw, threshold, coalesce(m.n, 0) AS n_items_final, coalesce(l.n, 0) AS n_orphan_body_rows, coalesce(m.n, 0) - n_items_raw AS n_synthesized_paragraph_splits FROM c LEFT JOIN m USING (k) LEFT JOIN l USING (k)""",
    "ranking_views": f"""WITH {_corpus_sql("SELECT doc_id AS chunk_ord, text FROM documents JOIN embeddings ON doc_id = vec_id")}, {_keyword_sql("SELECT item_id, text FROM benchmark JOIN embeddings ON item_id = vec_id")},
sem AS (SELECT i.item_id, c.chunk_ord, {_COSINE} AS score, row_number() OVER (PARTITION BY i.item_id ORDER BY round({_COSINE}, 6) DESC, c.chunk_ord) AS rank FROM it i JOIN embeddings a ON a.vec_id = i.item_id CROSS JOIN c JOIN embeddings b ON b.vec_id = c.chunk_ord),
f AS (SELECT kw.item_id, kw.chunk_ord, 1.0::DOUBLE / ({P.RRF_K} + kw.rank) + 1.0::DOUBLE / ({P.RRF_K} + sem.rank) AS score FROM kw JOIN sem USING (item_id, chunk_ord)),
v AS (SELECT item_id, 'keyword' AS view, chunk_ord, rank, score, above_floor FROM kw UNION ALL SELECT item_id, 'semantic', chunk_ord, rank, score, NULL FROM sem
  UNION ALL SELECT item_id, 'both', chunk_ord, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, chunk_ord), score, NULL FROM f)
SELECT 'B' AS checklist, item_id, view, chunk_ord AS chunk_id, rank::INT AS rank, floor(round(score, 6) * 100 + 1e-7)::BIGINT AS score, above_floor FROM v""",
    "homogeneity": f"""WITH {_OUTLINE}, b AS (SELECT d, block, bool_and(bold) AS solid, count(*) AS n FROM rows GROUP BY ALL),
x AS (SELECT r.d, count(*) AS c FROM kinds r WHERE bold AND NOT solid AND EXISTS (SELECT 1 FROM kinds z LEFT JOIN seen s ON s.d = z.d AND s.o = z.o WHERE z.d = r.d AND z.block = r.block AND z.text = r.text AND CASE WHEN z.k = 'candidate' THEN NOT s.ok AND z.other = 'body' ELSE z.k = 'body' END) GROUP BY r.d)
SELECT d::VARCHAR AS source_pdf, count(*) AS n_blocks_total, count(*) FILTER (solid AND n = 1) AS n_homog_single, count(*) FILTER (solid AND n > 1) AS n_homog_multi, count(*) FILTER (NOT solid) AS n_mixed_blocks, coalesce(any_value(c), 0) AS n_excluded_midblock_bold_rows FROM b LEFT JOIN x USING (d) GROUP BY d""",
    "weak_pairs": f"{_ALL} SELECT count(*) AS n_term_pass_pairs, round(avg((score < {P.MIN_SCORE})::INT), 6) AS below_min_score FROM sparse WHERE rare >= {P.MIN_HIGH_IDF_TERMS}",
    "uniqueness_check": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "key_check": "SELECT doc_id, 'left' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'right' FROM labels ANTI JOIN documents USING (doc_id)",
}


def oracle_sql() -> dict[str, str]:
    return _SQL | layout_queries.oracle_sql()
