"""Exact top-k inner products on bit slices of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.common import cut, read

SCALE = 64
K = 20
EVERY = 20
#: Rows of an index block and queries of a query block at most, about.
BLOCK_ROWS = 16384
QUERIES = 2048


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lows, bits): of each attribute the smallest value, and bit slices of what is above it.

    values: rows x attributes. bits[d, s] has bit s of attribute d of all rows,
    64 rows a word.
    """
    lows = values.min(axis=0)
    above = (values - lows).astype(np.uint64)
    width = max(1, int(above.max()).bit_length())
    padded = np.zeros((values.shape[1], width, -(-len(values) // 64) * 64), np.uint8)
    for s in range(width):
        padded[:, s, : len(values)] = ((above >> np.uint64(s)) & np.uint64(1)).T
    return lows, np.packbits(padded, axis=2, bitorder="little").view(np.uint64)


def add(planes: dict[int, list[np.ndarray]], words: int) -> np.ndarray:
    """The sum of bitmaps, each worth 2**weight to the rows that have it, as slices from the lowest.

    Three bitmaps of a weight are one of it (exclusive-or) and one of the next
    (majority), for whole stacks at once, until each weight has one.
    """
    out: list[np.ndarray] = []
    weight = 0
    carry: list[np.ndarray] = []
    while carry or any(w >= weight for w in planes):
        stack = [x for x in [*planes.get(weight, []), *carry] if len(x)]
        carry = []
        if not stack:
            out.append(np.zeros(words, np.uint64))
            weight += 1
            continue
        x = np.concatenate(stack) if len(stack) > 1 else stack[0]
        while len(x) > 2:
            third = len(x) // 3
            a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
            ab = a ^ b
            carry.append((a & b) | (c & ab))
            ab ^= c
            x = np.concatenate([ab, x[3 * third :]]) if len(x) % 3 else ab
        if len(x) == 2:
            carry.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0])
        weight += 1
    return np.array(out)


def scores(query: np.ndarray, lows: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of the inner products of query with all rows, and what to add to each.

    A negative factor takes the complement of the attribute's slices, so that
    only positive terms are added.
    """
    width = bits.shape[1]
    size = np.abs(query)
    base = int((query * lows).sum()) - int(size[query < 0].sum()) * ((1 << width) - 1)
    planes: dict[int, list[np.ndarray]] = {}
    for f in range(int(size.max()).bit_length() if len(size) else 0):
        on = (size >> f) & 1 == 1
        plus, minus = bits[on & (query > 0)], ~bits[on & (query < 0)]
        for s in range(width):
            planes.setdefault(f + s, []).extend([plus[:, s], minus[:, s]])
    if not any(len(x) for xs in planes.values() for x in xs):
        return np.zeros((1, bits.shape[2]), np.uint64), base
    return add(planes, bits.shape[2]), base


def _count(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def _rows(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))


def select(sums: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """The rows of live with the k highest sums, from the highest slice down; ties to earlier rows."""
    sure, maybe = np.zeros_like(live), live.copy()
    for plane in sums[::-1]:
        new = sure | (maybe & plane)
        n = _count(new)
        if n > k:
            maybe &= plane
        else:
            sure, maybe = new, maybe & ~plane
            if n == k:
                return _rows(sure)
    return np.concatenate([_rows(sure), _rows(maybe)[: k - _count(sure)]])


def values_at(sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    return sum(((((s[word] >> bit) & np.uint64(1)).astype(np.int64) << i) for i, s in enumerate(sums)), np.zeros(len(rows), np.int64))


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, lows: np.ndarray, bits: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query_id, vec_id and score of the k best rows of a block for each query; ids ascend."""
    everyone = np.packbits(np.arange(bits.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    got = []
    for q, qid in zip(queries, query_ids):
        live = everyone
        lo, hi = np.searchsorted(ids, [qid, qid + 1]) if qid < np.iinfo(np.int64).max else (np.searchsorted(ids, qid), len(ids))
        if hi > lo:
            live = everyone.copy()
            own = np.arange(lo, hi)
            np.bitwise_and.at(live, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        sums, base = scores(q, lows, bits)
        rows = select(sums, live, k)
        got.append((np.full(len(rows), qid, np.int64), ids[rows], values_at(sums, rows) + base))
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _as_rows(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy()
    flat = batch.column(1).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return ids, np.asarray(flat.flatten()).reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k highest integer inner products.

    vectors and queries: vec_id and embedding. Components become floor(scale * x),
    x as double. A query isn't compared with rows of its own id; ties go to the
    smaller vec_id; if fewer rows remain, all are returned. Null vectors, those
    with null, NaN or infinite components and those with a null id take no part,
    and a query meets vectors of its own length only. Repeated rows of vectors all
    count and take a rank each. Each id asks once, however often it is repeated:
    with the smallest of its vectors. Other columns are ignored; no usable row
    gives no rows.

    The index, bit slices of blocks of about BLOCK_ROWS rows, is written once to
    the shared folder. Blocks are dealt by position and not by value, so that
    equal vectors are spread. Each block meets each block of queries once; k rows
    for each query come out of it, and the best of these are found with one
    shuffle by query.
    """
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))

    def dealt(df: DataFrame, rows: int, block: str) -> DataFrame:
        df = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        n = df.count()
        return df.select(F.col("vec_id").cast("long"), q.alias("q"), F.size("embedding").alias("dim"), F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-n // rows)))).cast("int").alias(block))

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, values = _as_rows(table.select(["vec_id", "q"]))
        lows, bits = slices(values.astype(np.int64))
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "ids": [ids.tobytes()], "lows": [lows.astype(np.int64).tobytes()], "bits": [bits.tobytes()], "words": pa.array([bits.shape[2]], pa.int32())})

    def asked(table: pa.Table) -> pa.Table:
        ids, values = _as_rows(table.select(["vec_id", "q"]))
        return pa.table({"dim": table.column("dim")[:1], "qids": [ids.tobytes()], "qs": [values.astype(np.int64).tobytes()]})

    blocks = cut(dealt(vectors, BLOCK_ROWS, "block").groupBy("dim", "block").applyInArrow(index, "dim int, block int, ids binary, lows binary, bits binary, words int"))
    queries = queries.where(usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asks = cut(dealt(queries, QUERIES, "ask").groupBy("dim", "ask").applyInArrow(asked, "dim int, qids binary, qs binary"))
    # every query block goes to every block of its length: an equi-join on (dim, block)
    where = blocks.groupBy("dim").agg(F.max("block").alias("last"))
    sent = asks.join(where, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    met = blocks.join(sent, ["dim", "block"]).select("dim", "words", "ids", "lows", "bits", "qids", "qs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, words, ids, lows, bits, qids, qs in zip(*(c.to_pylist() for c in batch.columns)):
                planes = np.frombuffer(bits, np.uint64).reshape(dim, -1, words)
                asked_for = np.frombuffer(qs, np.int64).reshape(-1, dim)
                found = top_of_block(asked_for, np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(lows, np.int64), planes, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP4_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM (SELECT vec_id, min(q) AS q FROM v GROUP BY vec_id) a JOIN v b ON a.vec_id % {EVERY} = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}
"""
