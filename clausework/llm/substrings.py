"""Substring deduplication by content-defined chunks of a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.common import MAX_LONG, cut, join_counted, read, stored

#: A boundary follows a byte whose hash is the highest of this many bytes on either side.
REACH = 24
#: Repeated spans of fewer words are left alone.
MIN_WORDS = 16
#: Bytes that are hashed at once.
PART = 1 << 22


def gear_table(seed: int = 0) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(seed).integers(1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + table[byte] (modulo 2**32) after each byte: that of the last 32 bytes.

    h over 2n bytes is h over the last n plus 2**n times h over the n before, so
    five doublings give all of them at once.
    """
    h = GEAR[data]
    for n in (1, 2, 4, 8, 16):
        before = h[:-n] << np.uint32(n)
        h[n:] += before
    return h


def _highest(x: np.ndarray, reach: int) -> np.ndarray:
    """The highest of x within reach on either side, by doubling windows."""
    width, w = 2 * reach + 1, 1
    top = np.concatenate([np.zeros(reach, x.dtype), x, np.zeros(reach, x.dtype)])
    while 2 * w <= width:
        top = np.maximum(top[:-w], top[w:])
        w *= 2
    if w < width:
        top = np.maximum(top[: len(top) - (width - w)], top[width - w :])
    return top


def _apart(ends: np.ndarray, reach: int) -> np.ndarray:
    """ends without those within reach of the one kept before."""
    keep, last = np.ones(len(ends), bool), 0
    for k in np.flatnonzero(np.diff(ends) <= reach).tolist():
        if keep[k]:
            last = ends[k]
        keep[k + 1] = ends[k + 1] - last > reach
    return ends[keep]


def boundaries(data: bytes, reach: int = REACH) -> np.ndarray:
    """Ends of chunks: after local maxima of the gear hash, and at the end.

    Whether a byte is a boundary depends on 32 bytes before it and `reach` on
    either side only, so an insertion moves no boundary further away. Equal maxima
    within `reach` stand in a passage that goes on repeating a few bytes (a run of
    one word): there the first of them counts, and then each next one beyond reach,
    so that such a passage has chunks as short as any other, alike wherever it
    begins. Chunks have more than `reach` bytes, but for the first and the last.
    """
    n, ends = len(data), []
    for at in range(0, n, PART):
        lo, hi = max(0, at - reach - 32), min(n, at + PART + reach)
        h = gear_hashes(np.frombuffer(data, np.uint8, hi - lo, lo).copy())
        h = h.astype(np.uint64) << np.uint64(1) | np.uint64(1)  # none is 0, which stands for the outside
        peak = np.flatnonzero(h == _highest(h, reach)) + lo
        ends.append(peak[(peak >= at) & (peak < at + PART)] + 1)
    found = _apart(np.concatenate(ends), reach) if n else np.zeros(0, np.int64)
    if n and (not len(found) or found[-1] != n):
        found = np.append(found, n)
    return found


def chunks(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, doc (which text), start, length (bytes of UTF-8), words, h1, h2 of the chunks of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                rows: list[np.ndarray] = []
                digests: list[bytes] = []
                for doc_id, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                    data = text.as_py()
                    if not data:
                        continue
                    ends = boundaries(data, reach)
                    starts = np.concatenate([[0], ends[:-1]])
                    raw = np.frombuffer(data, np.uint8)
                    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
                    first = ~blank & np.concatenate([[True], blank[:-1]])
                    words = np.add.reduceat(first, starts, dtype=np.int64)
                    rows.append(np.column_stack([np.full(len(ends), doc_id), np.full(len(ends), doc), starts, ends - starts, words]))
                    digests += [digest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                if rows:
                    cols = np.concatenate(rows)
                    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (cols[:, 0], cols[:, 1], cols[:, 2].astype(np.int32), cols[:, 3].astype(np.int32), cols[:, 4].astype(np.int32), h[:, 0], h[:, 1])], ["doc_id", "doc", "start", "length", "words", "h1", "h2"])

    used = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)), F.xxhash64("doc_id", "text"), "text")
    return used.mapInArrow(run, "doc_id long, doc long, start int, length int, words int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, reach: int = REACH, within: bool = False) -> DataFrame:
    """doc_id, start, length (bytes of UTF-8), words, first_doc_id, doc_key: spans that an earlier document has too.

    A chunk is a duplicate if the same bytes (128-bit digest) are a chunk of an
    earlier document; documents are in the order of doc_id and a hash of id and
    text, so the first one keeps it, and all later ones are reported. within: of
    a chunk that stands more than once in a text, all places but the first are
    duplicates as well. Adjacent duplicate chunks are one span; its first_doc_id
    is the smallest keeper of its chunks (its own doc_id, if it stands in its own
    text only); spans under `min_words` words are left out.
    Null and empty texts have no spans. Rows equal in doc_id and text are one
    document; texts that share a doc_id, or have none, are documents of their
    own. Null ids come after all others and are null in the result. doc_key is
    the hash of id and text. Other columns are ignored; an empty table gives no
    rows.

    The digests are made once and kept in the shared folder. First the chunks are
    counted by 64 bits of the digest; only what occurs more than once meets the
    rows again, and only there whole digests are compared. Where rows are joined,
    a chunk of very many texts is dealt over several tasks.
    """
    rows = stored(chunks(docs, reach))
    often = rows.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1")
    some = stored(join_counted(rows, cut(often), ["h1"], ["doc", "start"]).distinct())  # equal rows are one
    place = F.struct("doc_id", "doc", "start") if within else F.struct("doc_id", "doc")
    firsts = some.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    met = join_counted(some, cut(firsts), ["h1", "h2"], ["doc", "start"])
    dup = met.where(place != F.col("first")).withColumn("keeper", F.col("first.doc_id"))
    order = Window.partitionBy("doc_id", "doc").orderBy("start")
    new = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order) != F.col("start"), F.lit(True))
    spans = dup.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(order))
    found = spans.groupBy("doc_id", "doc", "span").agg(
        F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("words"), F.min("keeper").alias("first_doc_id")
    )
    real = lambda c: F.when(F.col(c) < MAX_LONG, F.col(c))
    return found.where(F.col("words") >= min_words).select(real("doc_id").alias("doc_id"), F.col("start").cast("long"), "length", "words", real("first_doc_id").alias("first_doc_id"), F.col("doc").alias("doc_key"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans of repeated_spans(docs) cut out of text; all rows and columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names[:-1]
            t, out = names.index("text"), []
            for text, cuts in zip(b.column(t).to_pylist(), b.column(len(names)).to_pylist()):
                if cuts and text is not None:
                    data = text.encode()
                    for start, length in sorted(((x["start"], x["length"]) for x in cuts), reverse=True):
                        data = data[:start] + data[start + length :]
                    text = data.decode(errors="ignore")  # a cut may part the bytes of one character
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == t else b.column(i) for i in range(len(names))], names)

    cuts = spans.groupBy("doc_key").agg(F.collect_set(F.struct("start", "length")).alias("_cuts"))
    met = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("doc_key")).join(cuts, "doc_key", "left")
    return met.select("row.*", F.col("_cuts").alias(" cuts")).mapInArrow(run, docs.schema)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents")).drop("doc_key")
