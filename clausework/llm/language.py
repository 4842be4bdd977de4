"""Language identification by known words, backing off to shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import held_out, read

WORD = re.compile(r"[^\W\d_]+")
#: Longest character n-grams first; a word is wrapped in these marks.
ORDERS = (5, 4, 3, 2, 1)
MARK = "\x02%s\x03"
#: What is learned from: about so many documents of each language, whole texts.
SAMPLE = 4000
#: What is kept: the most frequent words and n-grams of each order.
MOST_WORDS = 100_000
MOST_GRAMS = 40_000
#: A word seen less often than this counts as unseen.
LEAST = 3
#: Weight of an n-gram's evidence against a whole word's.
BACKOFF = 0.4
#: Texts, and about how many words, that are scored together.
TEXTS = 512
TOKENS = 200_000
#: More values of lang than this are refused: each has its column of counts.
MOST_LANGS = 500
HELD_OUT = (5, 0)
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    w = MARK % word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Log relative frequencies by language: (features, languages) for words and each n-gram order."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[int, dict[str, int]]
    gram_logs: dict[int, np.ndarray]
    #: Features that were seen often enough but are beyond MOST_WORDS (0) or MOST_GRAMS (by order).
    dropped: dict[int, int] = field(default_factory=dict)


def _logs(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """log p(feature | language), smoothed by half a count, less the mean over languages."""
    logs = np.log(counts + 0.5) - np.log(totals + 0.5 * max(1, len(counts)))
    return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from doc_id, text and lang of docs; rows with null text or lang are left out.

    About `sample` documents of each language are read, those of the smallest
    hashes; of their words and n-grams, MOST_WORDS and MOST_GRAMS of each order
    are kept; the model says how many more there were. Both bounds hold however
    large docs is. Counting is distributed; what comes back to the driver is the
    model. More than MOST_LANGS languages are an error.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(n) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(n)
    if not langs:
        return Model([], {}, np.zeros((0, 0), np.float32), {k: {} for k in ORDERS}, {k: np.zeros((0, 0), np.float32) for k in ORDERS})
    # a hash in 0..2**30 decides; a language's share of it is its part of the sample
    h = F.pmod(F.xxhash64(F.lit(2), "doc_id", "text"), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, int(min(1.0, sample / n[k]) * (1 << 30))))), F.col("lang"))
    chosen = rows.where(h < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in seen.items():
            found = {0: c} | {n: Counter() for n in ORDERS}
            for w, k in c.items():
                for n in ORDERS:
                    for g in grams_of(w, n):
                        found[n][g] += k
            for n, f in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(f), pa.int32()), pa.array(f.keys(), pa.string()), pa.array([lang] * len(f), pa.string()), pa.array(f.values(), pa.int64())], ["n", "f", "lang", "k"])

    counted = chosen.mapInArrow(count, "n int, f string, lang string, k long")
    by = counted.groupBy("n", "f").agg(*(F.sum(F.when(F.col("lang") == x, F.col("k")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(langs)), F.sum("k").alias("k"))
    by = by.where((F.col("n") > 0) | (F.col("k") >= LEAST)).persist()
    kept: dict[int, list] = {}
    seen = {r["n"]: r["count"] for r in by.groupBy("n").count().collect()}  # a row for each order
    for n in (0, *ORDERS):
        of = by.where(F.col("n") == n)
        kept[n] = of.orderBy(F.desc("k"), "f").limit(MOST_GRAMS if n else MOST_WORDS).drop("n", "k").collect()
    by.unpersist()
    totals = {n: np.array([[r[1:] for r in rows]], np.float64).reshape(-1, len(langs)).sum(axis=0) for n, rows in kept.items()}
    logs = {n: _logs(np.array([r[1:] for r in rows], np.float64).reshape(-1, len(langs)), totals[n]) for n, rows in kept.items()}
    names = {n: {r["f"]: i for i, r in enumerate(rows)} for n, rows in kept.items()}
    dropped = {n: seen[n] - len(rows) for n, rows in kept.items() if seen.get(n, 0) > len(rows)}
    return Model(langs, names[0], logs[0], {n: names[n] for n in ORDERS}, {n: logs[n] for n in ORDERS}, dropped)


class Grams:
    """Known n-grams of one order as sorted codes of their characters, and their logs.

    A code is a number to the base of the alphabet, modulo 2**64: exact while
    base**order fits, and beyond that a fingerprint of 64 bits.
    """

    def __init__(self, names: dict[str, int], logs: np.ndarray, number: np.ndarray, base: int):
        self.number, self.base = number, np.uint64(base)
        n = len(next(iter(names), ""))
        codes = self.codes(np.frombuffer("".join(names).encode("utf-32-le"), np.uint32), n)[:: max(1, n)]
        order = np.argsort(codes)
        self.known, self.logs = codes[order], logs[order]

    def codes(self, chars: np.ndarray, n: int) -> np.ndarray:
        """The code of the n characters that begin at each place."""
        x = self.number[chars]
        out = np.zeros(max(0, len(x) - n + 1), np.uint64)
        for k in range(n):
            out = out * self.base + x[k : k + len(out)]
        return out


class Scorer:
    """What words say for languages. It keeps nothing but the model, so a prediction depends on its text alone."""

    def __init__(self, model: Model):
        self.model = model
        letters = sorted({c for of in model.grams.values() for g in of for c in g})
        self.number = np.zeros(0x110000, np.uint64)  # of each character; 0 is in no known n-gram
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.grams = {n: Grams(of, model.gram_logs[n], self.number, len(letters) + 1) for n, of in model.grams.items() if of}

    def evidence(self, words: list[str]) -> np.ndarray:
        """For each unseen word the mean logs of its n-grams of the longest order that knows any, weighted down order by order."""
        out = np.zeros((len(words), len(self.model.langs)), np.float32)
        chars = np.frombuffer("".join(MARK % w for w in words).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        left, weight = np.arange(len(words)), BACKOFF
        for n in ORDERS:
            if not len(left):
                break
            if n in self.grams:
                g = self.grams[n]
                word = np.repeat(np.arange(len(left)), sizes)
                ends = np.repeat(np.cumsum(sizes), sizes)
                starts = np.flatnonzero(np.arange(len(chars)) + n <= ends)
                codes = g.codes(chars, n)[starts]
                at = np.searchsorted(g.known, codes)
                at[at == len(g.known)] = 0
                hit = g.known[at] == codes
                of, at = word[starts[hit]], at[hit]
                met, first, hits = np.unique(of, return_index=True, return_counts=True)
                if len(met):
                    out[left[met]] = np.add.reduceat(g.logs[at], first, axis=0, dtype=np.float64) / hits[:, None] * weight
                    rest = np.ones(len(left), bool)
                    rest[met] = False
                    chars, left, sizes = chars[rest[word]], left[rest], sizes[rest]
            weight *= BACKOFF
        return out

    def totals(self, words: list[list[str]]) -> np.ndarray:
        """The sum of what its words say, for each text."""
        m = self.model
        out = np.zeros((len(words), len(m.langs)))
        flat = list(chain.from_iterable(words))
        at = np.fromiter(map(m.words.get, flat, repeat(-1)), np.int64, len(flat))
        said = m.word_logs[at] if len(m.word_logs) else np.zeros((len(flat), len(m.langs)), np.float32)
        unseen: dict[str, int] = {}
        where = np.flatnonzero(at < 0)
        which = np.array([unseen.setdefault(flat[i], len(unseen)) for i in where.tolist()], np.int64)
        if len(where):
            said[where] = self.evidence(list(unseen))[which]
        sizes = np.array([len(w) for w in words], np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(said, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior; UNKNOWN without letters or without a model."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """predict() of each text; about TOKENS words are scored together."""
        langs, out = self.model.langs, []
        if not langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        part: list[list[str]] = []
        for k, text in enumerate(texts):
            part.append(words_of(text))
            if sum(map(len, part)) < TOKENS and k + 1 < len(texts):
                continue
            for words, total in zip(part, self.totals(part)):
                if not any(c.isalpha() for w in words for c in w):
                    out.append((UNKNOWN, 0.0))
                    continue
                p = np.exp(total - total.max())
                best = int(p.argmax())
                out.append((langs[best], float(p[best] / p.sum())))
            part = []
        return out


#: The scorer of a worker, which serves all tasks of one model.
_kept: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row, from its whole text alone.

    A null text, or one without letters, is UNKNOWN with score 0; languages that
    are equally likely give the first in the alphabet. Every row of docs gives
    one row, repeated and null ids included; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_WORDS and MOST_GRAMS
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from clausework.llm import language

        if number not in language._kept:
            language._kept.clear()
            language._kept[number] = Scorer(shared.value)
        scorer = language._kept[number]
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                b = whole.slice(lo, TEXTS)
                got = scorer.predict_all(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), *HELD_OUT)))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "lang_pred", "score")
