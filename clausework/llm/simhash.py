"""Near-duplicate groups by 64-bit fingerprints and tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import cut, read
from clausework.llm.graph import components

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints of one tile at most; a comparison then needs 2 x 64 KB of input.
TILE = 8192
#: Rows and columns compared at once: 16 MB of exclusive-ors.
BLOCK = (1024, 2048)
#: Words whose shingles are held at once.
WORDS = 1 << 16
#: Digits of a tile's code: population counts 0 to 16 with room for the radius on both sides.
_BASE = 17 + 2 * RADIUS


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text: 0 for null or no words, all words if fewer than a shingle."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, WORDS):
        part = words[at : at + WORDS + shingle - 1]
        spans = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """keys and fp (the fingerprint as a signed long) of every row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], [*b.schema.names[:-1], "fp"])

    used = docs.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*keys).schema.fields)
    return used.mapInArrow(run, f"{schema}, fp long")


def _forest(hits: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what hits joins, at most one fewer than there are fingerprints."""
    rows, cols = np.nonzero(hits)
    if len(rows) <= len(a) + len(b):
        return list(zip(a[rows].tolist(), b[cols].tolist()))
    values, label, found = np.concatenate([a, b]), np.arange(len(a) + len(b)), []
    for i in np.unique(rows):
        seen = np.unique(np.append(label[len(a) + np.flatnonzero(hits[i])], label[i]))
        if len(seen) > 1:
            found += [(int(values[seen[0]]), int(values[x])) for x in seen[1:]]
            label[np.isin(label, seen[1:])] = seen[0]
    return found


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """A forest of the links between two tiles (or within one), by exclusive-or and bit counts."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    for i in range(0, len(a), BLOCK[0]):
        for j in range(0, len(b), BLOCK[1]):
            if same and j + BLOCK[1] <= i:
                continue
            hits = np.bitwise_count(x[i : i + BLOCK[0], None] ^ y[None, j : j + BLOCK[1]]) <= radius
            if same:
                hits &= np.arange(i, i + hits.shape[0])[:, None] < np.arange(j, j + hits.shape[1])[None]
            if hits.any():
                yield from _forest(hits, a[i : i + BLOCK[0]], b[j : j + BLOCK[1]])


def _steps(radius: int) -> list[int]:
    """Differences of tile codes within the radius, one of each pair of opposites."""
    near = (d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius)
    codes = (sum(x * _BASE**k for k, x in enumerate(d)) for d in near)
    return sorted(c for c in codes if c >= 0)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints within the radius of each other.

    A tile holds fingerprints whose four 16-bit quarters have the same population
    counts. Bits that differ change these counts by at least as much in sum, so
    tile pairs whose counts differ beyond the radius are skipped without loss.
    There are 17**4 tiles at most, however large the input: their sizes are the
    only thing that is broadcast (under 3 MB). Tiles over `tile` fingerprints are
    split, and each pair of parts is a task's row of bounded size.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) + radius for k in range(4)]
    coded = fps.select("fp", sum((q * _BASE**k for k, q in enumerate(quarters)), F.lit(0)).cast("int").alias("code"))
    sizes = cut(coded.groupBy("code").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    dealt = coded.join(F.broadcast(sizes), "code").select("code", "fp", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    tiles = cut(dealt.groupBy("code", "part").agg(F.collect_list("fp").alias("fps")))
    far = sizes.select(F.col("code").alias("code_b"), "parts")
    left = (
        tiles.select(F.col("code").alias("code_a"), F.col("part").alias("part_a"), F.col("fps").alias("fps_a"), F.explode(F.array(*map(F.lit, _steps(radius)))).alias("step"))
        .withColumn("code_b", (F.col("code_a") + F.col("step")).cast("int"))
        .join(F.broadcast(far), "code_b")
        .withColumn("part_b", F.explode(F.sequence(F.when(F.col("step") == 0, F.col("part_a")).otherwise(0), F.col("parts") - 1)))
    )
    right = tiles.select(F.col("code").alias("code_b"), F.col("part").alias("part_b"), F.col("fps").alias("fps_b"))
    pairs = left.join(right, ["code_b", "part_b"]).select("fps_a", "fps_b", ((F.col("step") == 0) & (F.col("part_a") == F.col("part_b"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            xs, ys = x.values.to_numpy(), y.values.to_numpy()
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            found: list[tuple[int, int]] = []
            for k, same in enumerate(batch.column(2).to_pylist()):
                found += tile_links(xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]], same, radius)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, grp): the group of every fingerprint in rows.fp that is linked to another one."""
    found = components(links(rows.select("fp").distinct(), radius), "a", "b")
    return found.select(F.col("node").alias("fp"), F.col("component").alias("grp"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row of docs.

    component_id is the smallest doc_id reachable over links of `radius` or fewer
    differing bits, itself included. Null and blank texts have fingerprint zero
    and link like any other; repeated rows share their fingerprint and so their
    component; a null doc_id takes no part in the minimum, and a component of
    nothing else has a null id. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, ["doc_id"], shingle=shingle))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = least.join(near_groups(rows, radius), "fp", "left").withColumn("grp", F.coalesce("grp", "fp"))
    smallest = grouped.groupBy("grp").agg(F.min("first").alias("component_id"))
    of = grouped.select("fp", "grp").join(smallest, "grp").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: the one with the smallest doc_id.

    Rows of a group that share this doc_id are told apart by a hash of all their
    columns; of rows equal in every column one stays. Null ids come last.
    """
    names = [f"`{c}`" for c in docs.columns]
    # the row's own columns stay apart from those used here, whatever they are called
    keyed = docs.select(F.struct(*names).alias("row"), F.xxhash64(*names).alias("_k1"), F.xxhash64(F.lit(1), *reversed(names)).alias("_k2"))
    rows = cut(fingerprints(keyed.select(F.col("row.doc_id").alias("_id"), "_k1", "_k2", F.col("row.text").alias("text")), ["_id", "_k1", "_k2"]))
    of = near_groups(rows, radius)
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_k1", "_k2")).alias("best")
    by_fp = rows.groupBy("fp").agg(best)
    grouped = by_fp.join(of, "fp", "left").withColumn("grp", F.coalesce("grp", "fp"))
    stay = grouped.groupBy("grp").agg(F.min("best").alias("best")).select("best._k1", "best._k2").distinct()
    return keyed.join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
