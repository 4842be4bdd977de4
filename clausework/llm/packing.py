"""Packing token sequences shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.llm.common import cut, read

LIMIT = 2048
END_ID = 1
#: Words whose ids a worker keeps; when full, the cache starts anew.
CACHE = 600_000
#: Letters at the start of a word, and below which character they count as Latin.
FIRST_LETTERS = re.compile(r"[^\W\d_]*")
LATIN = 0x250
#: Texts by which a worker checks that the shortcut below fits the tokenizer file.
PROBES = (
    "The quick, brown FOX. It's don't; a1b2 -- (x) [y] {z} #tag @name 3.14 1,000 https://a.b/c?d=e&f", "naïve café Straße ÉCOLE œuvre niño Ångström ŁÓDŹ ǅ ß ﬁ x\u0301 e\u0301t\u0301 İstanbul ΑΣ ΣΑΣ дом 漢字 日本 🙂 👍🏽 \u00ad \u200b",
    "  two  spaces\ttab\nline \x00 \x1f </s> <|endoftext|> [INST] ... !!! ??? _under_ snake_case camelCase ABC123def", "word" * 40 + " " + "é" * 50,
)
#: Pieces of one (length, bucket) group about; a hot length is spread over many.
BUCKET = 1 << 17

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the UTF-8 bytes of the characters below LATIN.

    Printable bytes stand for themselves; the others, in order, for the characters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(LATIN)}


class Words(dict):
    """Ids of blank-separated words as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins letters across it, nor
    letters with what isn't one, so the ids of a text are those of its words,
    and those of a word are those of its first letters and of the rest. Latin
    letters go to the vocabulary's merges directly, all else through the whole
    tokenizer. A file for which this doesn't hold is refused, by PROBES.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.stems: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}
        for probe in PROBES:
            if self.ids(probe.replace("\n", " ").split(" ")) != self.encode(probe):
                raise ValueError(f"{path} doesn't lower-case and split words as assumed here")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        for x in (self, self.stems, self.rests):
            if len(x) >= CACHE:
                x.clear()
        first = word.rstrip(".,")
        if not first.isalpha():
            first = word[: FIRST_LETTERS.match(word).end()]
        rest, stem = word[len(first) :], first.lower()
        # other scripts, and an accent that follows and would be joined with the last letter, go through whole
        if not (stem.isascii() or ord(max(stem)) < LATIN) or not first.isalpha() or not stem.isalpha() or not rest[:1].isascii():
            rest, stem = word, ""
        head = self.stems.get(stem)
        if head is None:
            letters = stem if stem.isascii() else stem.translate(self.letters)
            head = self.stems[stem] = array("I", [t.id for t in self.merge(letters)]).tobytes() if stem else b""
        if rest:
            tail = self.rests.get(rest)
            if tail is None:
                tail = self.rests[rest] = self.encode(rest)
            head += tail
        self[word] = head
        return head

    def ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


def tokenized(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Pieces of at most `limit` tokens: cuts at every multiple of it, the rest is the last piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(path)
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = known.ids((text or "").replace("\n", " ").split(" ")) + end
                    n = len(raw) // 4
                    for start in range(0, n, limit):
                        part = raw[4 * start : 4 * (start + limit)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """(count, lengths) of every packing pattern, from counts of lengths.

    Lengths are placed longest first, always into the packs that are shortest so
    far; what doesn't fit opens new packs, each filled before the next one. A whole class of equal packs takes a
    whole class of equal lengths at once, so the work depends on the number of
    different lengths and not on the number of documents.
    """
    open_: list[tuple[int, int]] = []  # (room, class), sorted
    classes: dict[int, tuple[int, tuple]] = {}
    made = 0

    def put(room: int, count: int, chain: tuple) -> None:
        nonlocal made
        classes[made] = (count, chain)
        insort(open_, (room, made))
        made += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_ and open_[-1][0] >= length:
            room, k = open_.pop()
            count, chain = classes.pop(k)
            n = min(left, count)
            put(room - length, n, (length, chain))
            if n < count:
                put(room, count - n, chain)
            left -= n
        # a new pack is the shortest until it is full of this length
        most = limit // length
        for count, times in ((left // most, most), (1, left % most)):
            if count and times:
                chain: tuple = ()
                for _ in range(times):
                    chain = (length, chain)
                put(limit - times * length, count, chain)
    patterns = []
    for count, chain in classes.values():
        lengths: list[int] = []
        while chain:
            length, chain = chain
            lengths.append(length)
        patterns.append((count, lengths[::-1]))
    return patterns


def _slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, count, first sequence, offset): ranks low to high of a length go to these sequences."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for count, lengths in patterns:
        at = 0
        while at < len(lengths):
            length = lengths[at]
            same = lengths.count(length)
            low = ranks.get(length, 0)
            ranks[length] = low + count * same
            rows.append((length, low, ranks[length], count, first, sum(lengths[:at])))
            at += same
        first += count
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, from 0, among those of equal length.

    A length is dealt over buckets of bounded size; the rank in the bucket is
    added to the number of pieces in the buckets before it. Only these counts
    (at most lengths x buckets) are summed in order.
    """
    n = pieces.count()
    buckets = max(8, min(1024, -(-n // BUCKET)))
    dealt = pieces.withColumn("_id", F.monotonically_increasing_id()).withColumn("_bucket", F.pmod("_id", F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_id")) - 1
    return dealt.withColumn("_inside", inside).join(sizes, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_id", "_bucket", "_before", "_inside")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document's ids are those of the tokenizer file and then END_ID; a null or
    empty text has END_ID alone. Longer documents are cut at multiples of
    `limit`. Repeated rows and null ids are packed like any other row. Other
    columns are ignored; an empty table gives no rows.

    The histogram has at most `limit` rows; the packing plan that comes back to
    the workers has at most a few slots for each of its patterns, whose number
    depends on `limit` and not on the documents.
    """
    pieces = cut(tokenized(docs, tokenizer, limit))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(shortest_pack_first(histogram, limit))
    plan = docs.sparkSession.createDataFrame(slots, "length long, _low long, _high long, _count long, _first long, _at long")
    fits = [F.col("p.length") == F.col("s.length"), F.col("p.rank") >= F.col("s._low"), F.col("p.rank") < F.col("s._high")]
    met = ranked(pieces).alias("p").join(F.broadcast(plan).alias("s"), fits[0] & fits[1] & fits[2])
    nth = F.col("p.rank") - F.col("s._low")
    return met.select(
        "p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens",
        (F.col("s._first") + nth % F.col("s._count")).alias("sequence_id"),
        (F.col("s._at") + F.floor(nth / F.col("s._count")) * F.col("p.length")).cast("long").alias("offset"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
