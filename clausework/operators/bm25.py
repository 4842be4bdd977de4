"""Keyword relevance: postings, corpus statistics, scores and the gate that tags weak hits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import patterns as P
from clausework.functions.text import tokens
from clausework.sources.scratch import stored


def corpus(chunks: DataFrame, text: str = "text") -> DataFrame:
    """chunk_ord, chunk_id, tokens, dl of every chunk."""
    t = chunks.select("chunk_ord", "chunk_id", tokens(F.col(text)).alias("tokens"))
    return t.withColumn("dl", F.size("tokens"))


def postings(tokenized: DataFrame) -> DataFrame:
    """chunk_ord, term, tf, dl: one row for each different term of a chunk."""
    return tokenized.select("chunk_ord", "dl", F.explode("tokens").alias("term")).groupBy("chunk_ord", "dl", "term").agg(F.count("*").alias("tf"))


def document_frequencies(tokenized: DataFrame) -> DataFrame:
    """term, df; the different terms of a chunk are found before anything is shuffled."""
    return tokenized.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(tokenized: DataFrame) -> DataFrame:
    """One row: n_chunks and avgdl."""
    return tokenized.agg(F.count("*").alias("n_chunks"), F.avg(F.col("dl").cast("double")).alias("avgdl"))


def exact_sum(x: Column) -> Column:
    """Sum of doubles, the same in whatever order rows come and however they are dealt.

    Sums of doubles drift with the number of rows and differ in their last digits
    from run to run, which moves ranks. Here whole steps of 2^-24 and the rest in
    steps of 2^-56 are added as integers; what a row has below that is cut. The
    absolute values have to add up to less than 2^39, of 2^31 rows at most.
    """
    steps = x * float(1 << 24)
    whole = F.floor(steps)
    return F.sum(whole) * 2.0**-24 + F.sum(F.floor((steps - whole) * float(1 << 32))) * 2.0**-56


def raw_idf(df: Column, n: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def idf_for_df(df: int, n: int) -> float:
    """The idf that a term of this document frequency would have; ValueError where it is undefined."""
    return math.log(n - df + 0.5) - math.log(df + 0.5)


def vocabulary(tokenized: DataFrame) -> DataFrame:
    """term, df, idf, n_chunks, avgdl.

    A negative idf is replaced by EPSILON times the mean of the raw idf over all
    terms, summed exactly. The two totals are single rows of aggregates.
    """
    df = document_frequencies(tokenized)
    size = corpus_size(tokenized)
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", raw_idf(F.col("df"), F.col("n_chunks")))
    mean = raw.agg((exact_sum(F.col("raw")) / F.count("*")).alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, F.lit(P.EPSILON) * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("idf", idf).select("term", "df", "idf", "n_chunks", "avgdl")


def contribution(tf: Column, dl: Column, idf: Column, avgdl: Column) -> Column:
    return idf * (tf * (P.K1 + 1)) / (tf + P.K1 * (1 - P.B + P.B * dl / avgdl))


def percentiles(values: DataFrame, column: str, fractions: list[float], width: float = 0.01) -> list[float | None]:
    """Exact percentiles, interpolated between neighbours, without bringing all values into one task.

    Values are counted by bands; only in the bands that hold a wanted rank
    distinct values are counted and put in order. Contributions are at most the
    idf times K1 + 1, so the bands that come back are some thousands at most.
    """
    band = F.floor(F.col(column) / width)
    counts = sorted((r["b"], r["n"]) for r in values.where(F.col(column).isNotNull()).groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in counts)
    if not n:
        return [None for _ in fractions]
    at = [(n - 1) * f for f in fractions]
    wanted = {r for x in at for r in (math.floor(x), math.ceil(x))}
    first, before = {}, 0
    for b, c in counts:
        if any(before <= r < before + c for r in wanted):
            first[b] = before
        before += c
    inside = values.where(band.isin(*first)).groupBy(band.alias("b"), F.col(column).alias("c")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("b").orderBy("c"))
    starts = F.element_at(F.create_map(*(F.lit(x) for b, s in first.items() for x in (b, s))), F.col("b"))
    placed = inside.withColumn("hi", so_far + starts).withColumn("lo", F.col("hi") - F.col("n"))
    hit = F.exists(F.array(*(F.lit(r) for r in sorted(wanted))), lambda r: (r >= F.col("lo")) & (r < F.col("hi")))
    rows = placed.where(hit).select("lo", "hi", "c").collect()
    of = {r: next(x["c"] for x in rows if x["lo"] <= r < x["hi"]) for r in wanted}
    return [of[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * of[math.floor(x)] + (x - math.floor(x)) * of[math.ceil(x)] for x in at]


def rare_terms(vocab: DataFrame, threshold: Column | float = P.HIGH_IDF) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return vocab.where(F.col("idf") >= limit)


def derive_gate(tokenized: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: the gate of this corpus, from the idf of a term in RARE_DF chunks.

    min_score is the first percentile of what single rare terms contribute; 0
    without rare terms. The thresholds are rounded to six digits; the counts use
    the exact one.
    """
    size = corpus_size(tokenized).withColumn("exact", raw_idf(F.lit(P.RARE_DF), F.col("n_chunks")))
    checked = F.when(F.col("n_chunks") >= P.RARE_DF, F.col("exact")).otherwise(F.raise_error(F.lit("a gate needs two chunks at least")).cast("double"))
    size = size.withColumn("exact", checked)
    v = vocab.select("term", "idf", "avgdl").crossJoin(F.broadcast(size.select("exact")))
    rare = v.where("idf >= exact")
    single = postings(tokenized).join(rare, "term").select(contribution(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl")).alias("c"))
    single = stored(single)
    p = percentiles(single, "c", [P.MIN_SCORE_PERCENTILE])[0]
    stats = single.agg(F.lit(p).cast("double").alias("p"), F.min("c").alias("low"), F.count("*").alias("n"))
    counts = v.agg(F.count_if(F.col("idf") >= F.col("exact")).alias("rare"), F.count("*").alias("all"))
    return size.crossJoin(stats).crossJoin(counts).select(
        F.bround("exact", 6).alias("high_idf_threshold"), F.lit(P.MIN_HIGH_IDF_TERMS).alias("min_high_idf_terms"), F.bround(F.coalesce("p", F.lit(0.0)), 6).alias("min_score"),
        "n_chunks", F.col("rare").alias("rare_vocab_size"), F.col("all").alias("vocab_size"), F.col("low").alias("single_term_contribution_min"), F.col("n").alias("single_term_contribution_n"),
    )


def fixed_gate(spark) -> DataFrame:
    return spark.range(1).select(F.lit(P.HIGH_IDF).alias("high_idf_threshold"), F.lit(P.MIN_HIGH_IDF_TERMS).alias("min_high_idf_terms"), F.lit(P.MIN_SCORE).alias("min_score"))


def exact_gate(gate: DataFrame) -> DataFrame:
    """gate with the unrounded threshold: terms in RARE_DF chunks pass it at every corpus size."""
    return gate.withColumn("high_idf_threshold", raw_idf(F.lit(P.RARE_DF), F.col("n_chunks")))


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term, qf: how often each term is asked for; repeated terms weigh as often."""
    return items.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("qf"))


def sparse_scores(items: DataFrame, tokenized: DataFrame, vocab: DataFrame, gate: DataFrame, key: str = "item_id") -> DataFrame:
    """item, chunk_ord, score, rare_overlap of the pairs that share a term.

    The terms of the items, a list whose size callers check, are the broadcast
    side: tokens that nobody asks for are dropped where they are read, and what
    is shuffled are counts of asked terms and sums of scores. The sums are exact,
    so that chunks of equal text tie.
    """
    asked = query_terms(items, key)
    terms = F.broadcast(asked.select("term").distinct())
    q = vocab.join(terms, "term", "left_semi").join(F.broadcast(asked), "term").crossJoin(F.broadcast(gate.select("high_idf_threshold")))
    q = q.withColumn("rare", (F.col("idf") >= F.col("high_idf_threshold")).cast("int")).select(key, "term", "qf", "idf", "avgdl", "rare")
    wanted = tokenized.select("chunk_ord", "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    tf = wanted.groupBy("chunk_ord", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("qf") * contribution(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"))
    return tf.join(F.broadcast(q), "term").groupBy(key, "chunk_ord").agg(exact_sum(part).alias("score"), F.sum("rare").alias("rare_overlap"))


def keyword_scores(items: DataFrame, tokenized: DataFrame, vocab: DataFrame, gate: DataFrame, key: str = "item_id") -> DataFrame:
    """item, chunk_ord, chunk_id, score, above_floor of every pair of an item and a chunk.

    All pairs are the specification: none is dropped for its score. Pairs that
    share a term come from the sparse scores; each chunk adds the items that it
    shares nothing with. So all pairs are made, but none is shuffled before it
    is ranked. Items, unlike chunks, are written by hand; their number is checked
    by callers (plans.index.check_items), and their ids fit into one array.
    """
    sparse = stored(sparse_scores(items, tokenized, vocab, gate, key))  # read twice below
    chunks = tokenized.select("chunk_ord", "chunk_id")
    met = sparse.groupBy("chunk_ord").agg(F.collect_list(key).alias("_met"))
    every = items.agg(F.collect_set(key).alias("_every"))
    none = F.array_except("_every", F.coalesce("_met", F.array().cast(f"array<{items.schema[key].dataType.simpleString()}>")))
    rest = chunks.join(met, "chunk_ord", "left").crossJoin(F.broadcast(every)).select(F.explode(none).alias(key), "chunk_ord", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rare_overlap"))
    dense = sparse.join(chunks, "chunk_ord").select(*rest.columns).unionByName(rest).crossJoin(F.broadcast(gate.select("min_high_idf_terms", "min_score")))
    above = (F.col("rare_overlap") >= F.col("min_high_idf_terms")) & (F.col("score") >= F.col("min_score"))
    return dense.select(key, "chunk_ord", "chunk_id", "score", above.alias("above_floor"))
