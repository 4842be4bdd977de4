"""Line deduplication by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from clausework.llm.common import MAX_LONG, cut, join_counted, read, stored

#: Lines that the rolling hash spans; a chunk ends at BOUNDARIES of EVERY of its values, and after MOST lines.
WINDOW = 2
BOUNDARIES, EVERY = 3, 4
MOST = 16
#: Repeated parts of fewer lines are left alone.
MIN_LINES = 2
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def line_chunks(lines: list[bytes], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk of a text.

    A hash rolls over the hashes of the last `window` lines; a chunk ends where
    its top bits fall into BOUNDARIES of EVERY parts, after MOST lines, and at the
    end of the text. So a boundary depends on `window` lines only, and inserted
    lines move no other.
    """
    found, first, rolled = [], 0, 0
    top = pow(_MULTIPLIER, window, 1 << 64)
    hashes = [xxhash.xxh64_intdigest(x) for x in lines]
    for i, h in enumerate(hashes):
        rolled = (rolled * _MULTIPLIER + h) & _MASK
        if i >= window:
            rolled = (rolled - hashes[i - window] * top) & _MASK
        if (rolled >> 32) % EVERY < BOUNDARIES or i + 1 - first == MOST:
            found.append((first, i + 1 - first))
            first = i + 1
    if first < len(lines):
        found.append((first, len(lines) - first))
    return found


def pieces(lines: list[bytes], min_lines: int = MIN_LINES) -> list[tuple[int, int]]:
    """(first line, number of lines) of the parts of a text that are looked up, all of `min_lines` lines or more.

    These are its chunks, their beginnings and their ends, and `min_lines` lines
    across each boundary. A run of lines that two texts share need not begin and
    end at boundaries: it is the end of a chunk, whole chunks, and the beginning
    of one, and where two of them meet there are the lines across.
    """
    found = set()
    chunks = line_chunks(lines)
    for at, n in chunks:
        found |= {(at, k) for k in range(min_lines, n + 1)}
        found |= {(at + n - k, k) for k in range(min_lines, n + 1)}
    for at, _ in chunks[1:]:
        found |= {(k, min_lines) for k in range(max(0, at - min_lines + 1), min(at, len(lines) - min_lines + 1))}
    return sorted(found)


def piece_rows(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """id, key (of the text), line, lines, h1, h2 of the pieces of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "line", "lines", "h1", "h2"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                rows: list[tuple] = []
                for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                    data = text.as_py()
                    if not data or b"\n" not in data:
                        continue
                    lines = data.split(b"\n")
                    for line, n in pieces(lines, min_lines):
                        h = xxhash.xxh3_128_intdigest(b"\n".join(lines[line : line + n]))
                        rows.append((doc_id, key, line, n, (h >> 64) - (1 << 63), (h & _MASK) - (1 << 63)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    used = docs.select(_id().alias("id"), _key().alias("key"), "text")
    return used.mapInArrow(run, "id long, key long, line int, lines int, h1 long, h2 long")


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def _packed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """id and key of docs, the columns `keep` as `row`, and the text's bytes, compressed: texts are most of what is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            at = b.num_columns - 1
            texts = [None if t is None else pack(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.binary())], [*b.schema.names[:at], "packed"])

    used = docs.select(_id().alias("id"), _key().alias("key"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col("text").cast("string").alias("packed"))
    out = StructType([*used.schema.fields[:-1], StructField("packed", BinaryType())])
    return used.mapInArrow(run, out)


def _lines_of(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b"\n")


def _bodies(docs: DataFrame, met: DataFrame) -> DataFrame:
    """met (id, key, line, lines, h1, h2) with `body`, the piece itself; one text for each id and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                rows: list[tuple] = []
                b = whole.slice(lo, 200)
                for doc_id, key, met, packed in zip(*(c.to_pylist() for c in b.columns)):
                    lines = _lines_of(packed)
                    rows += [(doc_id, key, m["line"], m["lines"], m["h1"], m["h2"], b"\n".join(lines[m["line"] : m["line"] + m["lines"]])) for m in met]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["id", "key", "line", "lines", "h1", "h2", "body"])

    wanted = met.groupBy("id", "key").agg(F.collect_set(F.struct("line", "lines", "h1", "h2")).alias("met"))
    texts = _packed(docs, ["doc_id"]).drop("row")
    return wanted.join(texts, ["id", "key"]).select("id", "key", "met", "packed").mapInArrow(run, "id long, key long, line int, lines int, h1 long, h2 long, body binary")


def repeated_pieces(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """id, key, line, lines, keeper of the pieces that an earlier piece repeats byte for byte.

    Pieces with the same bytes are kept once, at the smallest (doc_id, text key,
    line), and are repeated elsewhere, if they share no line with that place.
    Digests that occur once are dropped before any text moves; the bytes
    of the others are compared by their smallest and largest value for each
    digest, two partial aggregates. Digests whose bytes differ (none is known to
    exist) take the bytes themselves as their key. A piece of very many texts is
    dealt over several tasks wherever its rows are joined.
    """
    ids = ["h1", "h2"]
    place = F.struct("id", "key", "line")
    small = stored(piece_rows(docs, min_lines))
    often = cut(small.groupBy(*ids).agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    met = stored(join_counted(small, often, ids, ["id", "key"]).distinct())
    compared = _bodies(docs, met).groupBy(*ids).agg(F.min("body").alias("low"), F.max("body").alias("high"))
    odd = cut(compared.where("low <> high").select(*ids))
    if odd.isEmpty():
        return _after_first(met)
    others = _bodies(docs, met.join(odd, ids, "left_semi"))
    firsts = others.groupBy(*ids, "body").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    apart = join_counted(others, firsts, [*ids, "body"], ["id", "key"]).drop("body")
    return _after_first(met.join(odd, ids, "left_anti").unionByName(apart))


def _after_first(rows: DataFrame) -> DataFrame:
    """Of rows with the first place of their bytes, those elsewhere that share no line with it."""
    elsewhere = (F.col("id") != F.col("first.id")) | (F.col("key") != F.col("first.key")) | (F.col("line") >= F.col("first.line") + F.col("lines"))
    return rows.where(elsewhere).select("id", "key", "line", "lines", F.col("first.id").alias("keeper"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, stats: bool = False) -> DataFrame:
    """docs without the chunks and parts of chunks, of `min_lines` lines or more, that another place has already.

    Every row stays, with its columns; text loses the lines of all repeated
    pieces (see pieces()), and n_chars, if there is such a column, becomes the
    length of what is left. The place that keeps a piece is that of the smallest
    doc_id (of equal ids, the smallest hash of the text), and there the first;
    within a text the two may not overlap, so a line that stands four times in a
    row is left twice. Single lines are never removed. Null and empty texts are
    unchanged, a null doc_id comes after all others, and rows equal in doc_id and
    text are treated as one document; texts that share a doc_id, or have none, are
    documents of their own. stats adds n_lines, n_removed and first_doc_id (the
    smallest keeper; null if nothing was removed). An empty table gives no rows.
    """
    found = repeated_pieces(docs, min_lines)
    by_text = found.groupBy("id", "key").agg(F.collect_set(F.struct("line", "lines")).alias("cuts"), F.min("keeper").alias("keeper"))
    # the row's own columns stay apart from those used here, whatever they are called
    others = [c for c in docs.columns if c != "text"]
    met = _packed(docs, others).join(by_text, ["id", "key"], "left").select("row", "packed", "cuts", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                rows: list[tuple] = []
                for packed, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if packed is None:
                        rows.append((None, 0, 0))
                        continue
                    lines = _lines_of(packed)
                    gone = {i for c in cuts or () for i in range(c["line"], c["line"] + c["lines"])}
                    rows.append((b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode(), len(lines), len(gone)))
                text, n_lines, n_removed = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(n_lines, pa.int32()), pa.array(n_removed, pa.int32()), b.column(3)], ["row", "text", "n_lines", "n_removed", "keeper"])

    kinds = {"row": met.schema["row"].dataType, "text": StringType(), "n_lines": IntegerType(), "n_removed": IntegerType(), "keeper": met.schema["keeper"].dataType}
    done = met.mapInArrow(run, StructType([StructField(n, t) for n, t in kinds.items()]))
    out = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    if stats:
        out |= {"n_lines": F.col("n_lines"), "n_removed": F.col("n_removed"), "first_doc_id": F.when(F.col("keeper") < MAX_LONG, F.col("keeper"))}
    return done.select(*(c.alias(n) for n, c in out.items()))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = drop_repeated_lines(docs, stats=True)
    return done.select("doc_id", "n_lines", "n_removed", "first_doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
