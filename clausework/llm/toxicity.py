"""Toxicity by weak supervision: many voters, a label model, a linear classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import held_out, read

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents to learn from, about; whole texts.
SAMPLE = 20_000
#: Lexicon voters at most, words and word beginnings.
MOST_VOTERS = 500
#: Lengths of word beginnings that can vote, and how many different words of a text must share one.
STEMS = (4, 5, 6, 7, 8, 9)
LEVELS = (1, 2, 3)
#: Signals that a worker counts before it hands them on.
COUNTED = 150_000
#: A lexicon voter's share of toxic documents must be this high; of all that are chosen so many may be there by chance.
PRECISION = 0.8
FALSE_FINDS = 0.05
#: Voters whose errors agree more than this count as correlated.
CORRELATED = 0.3
EM_ROUNDS = 25
THRESHOLD = 0.3
HELD_OUT = (4, 2)
#: Patterns that may vote: (name, from how many finds on). What each counts is in patterns_of().
PATTERNS = (("shouting", 3), ("capitals", 5), ("masked", 1), ("second person", 3))
SHOUTING = re.compile(r"!{2,}")
CAPITALS = re.compile(r"\b[A-Z]{4,}\b")
MASKED = re.compile(r"\b\w+[*@#$]+\w+\b")
SECOND_PERSON = frozenset("you your du dein tu ton usted vous".split())


def has_capitals(text: str) -> bool:
    """Four letters A-Z in a row, somewhere."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    big = (raw >= 65) & (raw <= 90)
    pair = big[1:] & big[:-1]
    return bool((pair[2:] & pair[:-2]).any())


def patterns_of(text: str, words: list[str], different: set[str]) -> list[float]:
    """Whether each of PATTERNS is found often enough; most texts need no search for what isn't there."""
    counts = (
        len(SHOUTING.findall(text)) if "!!" in text else 0,
        len(CAPITALS.findall(text)) if has_capitals(text) else 0,
        len(MASKED.findall(text)) if any(c in text for c in "*@#$") else 0,
        sum(map(SECOND_PERSON.__contains__, words)) if not SECOND_PERSON.isdisjoint(different) else 0,
    )
    return [float(n >= least) for n, (_, least) in zip(counts, PATTERNS)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def stems_of(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEMS if len(word) >= n]


def signals_of(words: set[str]) -> set[str]:
    """What lexicon voters look for: words, and beginnings (marked with *) that 1, 2 or 3 different words share."""
    stems = Counter(s for w in words for s in stems_of(w))
    return words | {f"{s}{level}" for s, n in stems.items() for level in LEVELS if n >= level}


@dataclass
class Model:
    """Lexicon and pattern voters with the weights of the linear classifier."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS) + 2))
    bias: float = -10.0
    #: Signals beyond MOST_VOTERS that would have voted as well.
    dropped: int = 0


class Voters:
    """Finds the entries of a lexicon in texts."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.stems = {s[: s.index("*") + 1] for s in lexicon if "*" in s}
        # a word that matches begins like an entry
        self.heads = {s.partition("*")[0][: STEMS[0]] for s in lexicon}

    def matches(self, word: str) -> tuple[str, ...]:
        """The lexicon's beginnings of a word, and the word if it is in the lexicon."""
        return tuple(s for s in stems_of(word) if s in self.stems) + ((word,) if word in self.lexicon else ())

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        """Lexicon entries that vote, and the dense features: patterns, number of different matching words, their share."""
        words = words_of(text)
        different, heads, n = set(words), self.heads, STEMS[0]
        met = {w: m for w in different if w[:n] in heads and (m := self.matches(w))}
        shared = Counter(m for of in met.values() for m in of)
        named = {f"{m}{level}" for m, k in shared.items() if m[-1] == "*" for level in LEVELS if k >= level} | {m for m in shared if m[-1] != "*"}
        found = sorted(self.lexicon[m] for m in named if m in self.lexicon)
        hits = sum(map(met.__contains__, words)) if met else 0
        return found, [*patterns_of(text or "", words, different), math.log1p(len(met)), hits / (1 + len(words))]


def _tail(k: int, n: int, p: float) -> float:
    """Upper bound of the chance of k or more of n at rate p (Chernoff)."""
    q = k / n
    if q <= p:
        return 1.0
    kl = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return math.exp(-n * kl)


def choose_lexicon(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Signals that speak for toxicity beyond chance, from (signal, toxic, clean) document counts, the most frequent first.

    A longer beginning is left out if a shorter one of the same level was found
    that is at least as precise and as frequent.
    """
    if not n_toxic or not n_clean:
        return []
    rate = n_toxic / (n_toxic + n_clean)
    good = sorted((_tail(t, t + c, rate), -t, s, t / (t + c)) for s, t, c in counts if t / (t + c) >= max(PRECISION, rate))
    m = max(1, len(counts))
    last = max((k for k, (p, *_) in enumerate(good, 1) if p <= FALSE_FINDS * k / m), default=0)  # Benjamini and Hochberg
    found = {s: (p, -minus) for _, minus, s, p in good[:last]}

    def shorter(s: str) -> list[str]:
        stem, star, level = s.partition("*")
        return [stem[:n] + "*" + (level or "1") for n in STEMS if n < len(stem) or (not star and n <= len(stem))]

    kept = [s for s, x in found.items() if not any(z in found and found[z] >= x for z in shorter(s))]
    return sorted(kept, key=lambda s: (-found[s][1], s))


def label_model(votes: np.ndarray, prior: float, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, hit rates, weights) of voters, by expectation maximisation.

    votes: documents x voters, 1 for a vote and 0 for none. The latent label
    starts from seed, the given labels, which are one more voter that can err;
    each voter has a rate of voting in either class. Voters whose votes still agree beyond their class rates are
    correlated; the weight of each is divided by how many it stands for, so that
    a word and its own beginning don't count as two witnesses.
    """
    # most documents have no votes at all: equal rows are taken once, with their number
    given = np.column_stack([votes, seed.astype(votes.dtype)])
    votes, which, times = np.unique(given, axis=0, return_inverse=True, return_counts=True)
    which, times = which.ravel(), times.astype(np.float64)
    y = votes[:, -1].astype(np.float64)
    n, m = times.sum(), votes.shape[1]
    w = np.ones(m)
    rates = np.zeros((2, m))
    for _ in range(EM_ROUNDS):
        pos, neg = max(times @ y, 1e-9), max(times @ (1 - y), 1e-9)
        voted = (votes.T @ (np.column_stack([1 - y, y]) * times[:, None]).astype(votes.dtype)).astype(np.float64)
        rates[0], rates[1] = (voted[:, 0] + 1e-2) / (neg + 2e-2), (voted[:, 1] + 1e-2) / (pos + 2e-2)
        rates[:, -1] = np.clip(rates[:, -1], 0.02, 0.98)  # however well they fit
        # correlations given the label, as it is believed in this round
        r = votes - (y[:, None] * rates[1] + (1 - y)[:, None] * rates[0]).astype(votes.dtype)
        each = r * times[:, None].astype(votes.dtype)
        sd = np.sqrt((r * each).sum(axis=0) / n) + 1e-9
        corr = (r.T @ each) / n / np.outer(sd, sd)
        corr[-1, :-1] = corr[:-1, -1] = 0.0  # the given labels don't stand for voters
        w = 1.0 / np.maximum(1.0, np.where(np.abs(corr) > CORRELATED, np.abs(corr), 0).sum(axis=1))
        absent = w * np.log((1 - rates[1]) / (1 - rates[0]))
        logit = math.log(prior / (1 - prior)) + absent.sum() + votes @ (w * np.log(rates[1] / rates[0]) - absent).astype(votes.dtype)
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        done = np.abs(new - y).max() < 1e-4
        y = new
        if done:
            break
    return y[which], rates[:, :-1], w[:-1]


def _fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum."""
    # most documents have no votes at all: equal rows are fitted once, with their number and mean label
    x, where = np.unique(np.asarray(x, np.float32), axis=0, return_inverse=True)
    n = np.bincount(where.ravel())
    mean, share = (np.bincount(where.ravel(), y) / n).astype(np.float32), (n / n.sum()).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        off = (1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -50, 50))) - mean) * share
        vw = np.float32(0.9) * vw + x.T @ off + np.float32(l2) * w
        vb = 0.9 * vb + float(off.sum())
        w, b = w - np.float32(2) * vw, b - 2.0 * vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from doc_id, text of docs and doc_id, toxic of labels.

    About `sample` labelled documents, those of the smallest hashes of their id,
    are read; this bound holds however large the tables are. Equal texts count
    once, and of texts that share a labelled doc_id that of the smallest hash.
    Candidate words and beginnings are counted on the cluster; votes of the
    sample, about `sample` short rows, come back to the driver. Null texts,
    labels and ids are left out; without both classes nothing is toxic. The model
    says how many signals are beyond MOST_VOTERS.
    """
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = given.count()
    if not n:
        return Model()
    h = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30))
    given = given.where(h < int(min(1.0, sample / n) * (1 << 30)))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(given), "doc_id")  # at most about `sample` ids
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("t.text", "toxic")
    texts = texts.dropDuplicates(["text"]).persist()
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}

        def counted() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))], ["s", "t", "c"])
            seen[0].clear()
            seen[1].clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[int(toxic > 0)].update(signals_of(set(words_of(text))))
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield counted()
        yield counted()

    counted = texts.select("text", "toxic").mapInArrow(signals, "s string, t long, c long").groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = counted.where("t + c >= 3").persist()
    tried = counted.count()
    rows = counted.where((F.col("t") >= 3) & (F.col("t") / (F.col("t") + F.col("c")) >= PRECISION)).orderBy(F.desc("t"), "s").limit(20 * MOST_VOTERS).collect()
    counted.unpersist()
    rows = [(r["s"], r["t"], r["c"]) for r in rows]
    chosen = choose_lexicon(rows + [("", 1, 10**9)] * (tried - len(rows)), n_toxic, n_clean)
    lexicon = {s: i for i, s in enumerate(sorted(chosen[:MOST_VOTERS]))}
    dropped = max(0, len(chosen) - MOST_VOTERS)
    shape = texts.select("text", "toxic")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for b in batches:
            got = [voters.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array([y for _, y in got], pa.list_(pa.float64()))], ["toxic", "hits", "dense"])

    votes = shape.mapInArrow(vote, "toxic int, hits array<long>, dense array<double>").collect()
    texts.unpersist()
    if not votes or not n_toxic or not n_clean:
        return Model(lexicon, dropped=dropped)
    seed = np.array([float(r["toxic"] > 0) for r in votes])
    x = np.zeros((len(votes), len(lexicon)), np.float32)  # 40 MB at most
    for i, r in enumerate(votes):
        x[i, r["hits"]] = 1.0
    dense = np.array([r["dense"] for r in votes], np.float32)
    silent = (x.sum(axis=1) == 0).astype(np.float32)  # the voter that speaks for clean
    voters = np.column_stack([x, dense[:, : len(PATTERNS)], silent])
    prior = min(0.99, max(0.001, seed.mean()))
    posterior, _, _ = label_model(voters, prior, seed)
    weights, bias = _fit_linear(np.column_stack([x, dense]), posterior)
    return Model(lexicon, weights, bias, dropped)


def score_of(model: Model, hits: list[int], dense: list[float]) -> float:
    k = len(model.lexicon)
    logit = model.bias + sum(float(model.weights[i]) for i in hits) + sum(float(w) * v for w, v in zip(model.weights[k:], dense))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))


def toxicity(docs: DataFrame, model: Model, keys: list[str] | None = None) -> DataFrame:
    """keys (doc_id), score (0 to 1) and predicted (1 from THRESHOLD on) of every row, from its whole text.

    A null or empty text has the score of a text without votes. Every row gives
    one row, repeated and null ids included; other columns are ignored unless
    they are among keys.
    """
    names = keys or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_VOTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        voters = Voters(m.lexicon)
        for b in batches:
            scores = [score_of(m, *voters.features(t.as_py())) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    used = docs.select(*names, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*names).schema.fields)
    scored = used.mapInArrow(run, f"{schema}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that toxicity() doesn't predict to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_VOTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        voters = Voters(m.lexicon)
        for b in batches:
            clean = [score_of(m, *voters.features(t.as_py())) < THRESHOLD for t in b.column(b.schema.get_field_index("text"))]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """A model of docs and the labels beside them, learned from rows that aren't held out."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"), *HELD_OUT)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), "score", "predicted")
