"""Benchmark decontamination by random-walk embeddings and bit-sampling hashing."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import read

WORD = re.compile(r"\w+")
#: Windows are leaks from this share of equal words on: at most a fifth of an item's words edited.
SIMILARITY = 0.8
#: Chance to find a window with so many edits, over the items of a class, and that of each item at least.
RECALL = 0.95
LEAST = 0.9
#: Sampled positions of the embedding in each hash, and hashes at most.
SAMPLED = 3
MOST_TABLES = 64
WALKS = 4
#: In place of a walk's number: every step moves on.
ALL = -1
#: Steps that the sampled positions of one hash lie within; the spans lie anywhere on an item's walk.
SPAN = 15
#: Random edits of each item, and edits in one place, by which the chance of a shared hash is measured; items that are measured together.
TRIALS = 20
TRIED = 100
#: Words whose numbers a worker remembers; words of a text that are walked at once.
CACHE = 500_000
PART = 1 << 17
#: Texts that are searched together.
TEXTS = 256
#: Items are sent to every task; a benchmark beyond this many words is refused.
MOST_WORDS = 20_000_000


def words_of(text: str | None) -> list[str]:
    """Letters, digits and underscores in lower case; all else separates."""
    return WORD.findall(text.lower()) if text else []


def walk_bits(symbols: int, walks: int, seed: int = 0) -> np.ndarray:
    """For each walk and symbol 64 random bits: whether step j moves on from this symbol."""
    return np.random.default_rng(seed).integers(0, 1 << 63, size=(walks, symbols), dtype=np.uint64) * np.uint64(2) + np.random.default_rng(seed + 1).integers(0, 2, size=(walks, symbols), dtype=np.uint64)


def embed(symbols: np.ndarray, bits: np.ndarray, steps: int, end: int) -> np.ndarray:
    """The random-walk embedding: at each step the symbol under the pointer, which then stays or moves on.

    Whether it moves is a random bit of (step, symbol), so two strings walk alike
    until an edit and, after it, soon fall into step again: few edits give few
    differing positions. Behind the end there is the symbol `end`.
    """
    out, at = np.full(steps, end, np.int64), _pointers(symbols, bits, steps)
    inside = at < len(symbols)
    out[inside] = symbols[at[inside]]
    return out


def _pointers(symbols: np.ndarray, bits: np.ndarray, steps: int) -> np.ndarray:
    """Where the walk stands at each step; bits are of 64 steps, or have a row for each 64."""
    bits, at = np.atleast_2d(bits), 0
    out = np.full(steps, len(symbols), np.int64)
    for j in range(steps):
        if at >= len(symbols):
            break
        out[j] = at
        at += int(bits[j >> 6, symbols[at]] >> np.uint64(j & 63) & np.uint64(1))
    return out


@dataclass
class Table:
    """A hash: its walk and sampled steps, and for each of its items the symbols there and where the first one stands."""

    walk: int
    steps: list[int]
    items: np.ndarray
    keys: np.ndarray
    at: np.ndarray


@dataclass
class Index:
    """What a task needs: words, items and the hash tables of their embeddings.

    bits are of (walk, 64 steps, symbol). The last two symbols stand around the texts: `wall` ends
    a walk, `pad` is before a text, so that walks enter its first word at all times.
    """

    words: dict[str, int]
    items: list[np.ndarray]
    ids: list[int]
    bits: np.ndarray
    tables: list[Table] = field(default_factory=list)

    @property
    def most(self) -> int:
        return max((len(x) for x in self.items), default=0)

    @property
    def wall(self) -> int:
        return len(self.words) + 1

    @property
    def pad(self) -> int:
        return len(self.words) + 2


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int(math.floor((1 - similarity) * n + 1e-9))


def _edited(symbols: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """symbols with random replacements, insertions and deletions; 0 stands for any other word."""
    x = symbols.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(x)))
        if kind == 0:
            x[at] = 0
        elif kind == 1:
            x.insert(at, 0)
        elif len(x) > 1:
            del x[at]
    return np.array(x, np.int64)


def _gathered(symbols: np.ndarray, edits: int, kind: int) -> np.ndarray:
    """symbols with all edits in one place: dropped or replaced at the head, in the middle or at the tail."""
    at = (0, (len(symbols) - edits) // 2, len(symbols) - edits)[kind % 3]
    return np.concatenate([symbols[:at], np.zeros(edits * (kind // 3), np.int64), symbols[at + edits :]])


def length_class(n: int) -> int:
    """Items of one class differ by less than a quarter in length, and walk as many steps."""
    return int(math.log(n) / math.log(1.25) + 1e-9)


def build(items: list[tuple[int, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = 0) -> Index:
    """Hash tables until every item, with all edits allowed, is found with the target chance.

    Items of a length class have hashes of their own, whose steps are sampled all along their
    walk: each hash has its steps within SPAN of each other, and the spans lie anywhere. The
    chance is measured: TRIALS random edits of each item, and as many with all edits at the head,
    in the middle or at the tail, stand between other words and are searched, and hashes are
    added to a class until the share of trials that meet their item in some hash is `recall` for
    the random edits and for each place, and LEAST for each item. A class that MOST_TABLES
    don't bring so far, and items too short for any edit, are looked up by pieces, which miss nothing.
    """
    rng = np.random.default_rng(seed)
    words: dict[str, int] = {}
    texts = [(i, words_of(t)) for i, t in items]
    texts = [(i, w) for i, w in texts if w]
    if sum(len(w) for _, w in texts) > MOST_WORDS:
        raise ValueError(f"the benchmark has more than {MOST_WORDS} words; split it and run each part")
    numbered = [np.array([words.setdefault(x, len(words) + 1) for x in w], np.int64) for _, w in texts]
    classes: dict[int, list[int]] = {}
    whole: list[int] = []  # items of pieces
    for k, x in enumerate(numbered):
        (classes.setdefault(length_class(len(x)), []) if edits_allowed(len(x), similarity) else whole).append(k)
    # half of the steps move on, so a walk over n words has about 2n steps
    reach = {c: max(SAMPLED, 2 * min(len(numbered[k]) for k in ks)) for c, ks in classes.items()}
    blocks = (max(reach.values(), default=1) + 63) // 64
    bits = np.stack([walk_bits(len(words) + 3, WALKS, seed + 2 * b) for b in range(blocks)], axis=1)
    index = Index(words, numbered, [i for i, _ in texts], bits)
    for c, ks in sorted(classes.items()):
        tables = _tables(index, ks, reach[c], rng)
        met, kinds = _met(index, ks, tables, similarity, rng)
        share = lambda n, of: np.array([m.mean() for m in of(met[:, :, :n].any(axis=2))])
        for n in range(1, len(tables) + 1):
            places = share(n, lambda m: [m[:, kinds == k] for k in np.unique(kinds)])
            if places.min() >= recall and share(n, list).min() >= min(LEAST, recall):
                break
        else:
            whole += ks
        index.tables += tables[:n]
    index.tables += _pieces(index, whole, similarity)
    return index


def _pieces(index: Index, items: list[int], similarity: float) -> list[Table]:
    """Tables of pieces of items, one more than edits are allowed: some piece of a leak has no edit. Their walk always moves on."""
    of_size: dict[int, list[tuple[int, int]]] = {}
    for k in items:
        n = len(index.items[k])
        cuts = np.linspace(0, n, edits_allowed(n, similarity) + 2).astype(np.int64).tolist()
        for a, z in zip(cuts, cuts[1:]):
            of_size.setdefault(z - a, []).append((k, a))
    found = []
    for size, pieces in sorted(of_size.items()):
        of, at = (np.array(c, np.int64) for c in zip(*pieces))
        keys = np.array([index.items[k][a : a + size] for k, a in pieces], np.int64)
        found.append(Table(ALL, list(range(size)), of, keys, at))
    return found


def _tables(index: Index, items: list[int], reach: int, rng: np.random.Generator) -> list[Table]:
    own = [[_pointers(index.items[k], b, reach) for k in items] for b in index.bits]
    found = []
    for t in range(MOST_TABLES):
        walk, span = t % WALKS, min(SPAN, reach)
        steps = (rng.integers(reach - span + 1) + np.sort(rng.choice(span, size=SAMPLED, replace=False))).tolist()
        # a walk that is past its item has nothing to compare
        inside = [n for n, k in enumerate(items) if own[walk][n][steps[-1]] < len(index.items[k])]
        at = np.array([own[walk][n][steps] for n in inside], np.int64).reshape(-1, SAMPLED)
        keys = np.array([index.items[items[n]][p] for n, p in zip(inside, at)], np.int64).reshape(-1, SAMPLED)
        found.append(Table(walk, steps, np.array([items[n] for n in inside], np.int64), keys, at[:, 0]))
    return found


def _met(index: Index, items: list[int], tables: list[Table], similarity: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Whether (item, trial, table) has a hash in common, and the kind of each trial: 0 for random edits, then head, middle, tail."""
    kinds = np.array([0] * TRIALS + [1 + n % 3 for n in range(TRIALS)])
    met = np.zeros((len(items), 2 * TRIALS, len(tables)), bool)
    for lo in range(0, len(items), TRIED):
        part, owner, origin = [], [], []
        for n, k in enumerate(items[lo : lo + TRIED], lo):
            x = index.items[k]
            edits = edits_allowed(len(x), similarity)
            for t in range(2 * TRIALS):
                y = _edited(x, edits, rng) if t < TRIALS else _gathered(x, edits, (t - TRIALS) % 6)
                before, after = (rng.integers(1, len(index.words) + 1, 2 * edits + 2) for _ in range(2))
                part.append(np.concatenate([before, y, after, [index.wall]]))
                owner.append((n, t))
                origin.append(len(before))
        owners, begin = np.array(owner), np.cumsum([0, *map(len, part)])
        symbols, origins = np.concatenate(part), begin[:-1] + origin
        for t, starts, found in Walker(index, tables).hits(symbols):
            trial = np.searchsorted(begin, np.maximum(starts, 0), side="right") - 1
            ok = trial < len(owners)
            trial, starts, found = trial[ok], starts[ok], found[ok]
            allowed = np.array([edits_allowed(len(index.items[k]), similarity) for k in items])[owners[trial, 0]]
            # scattered edits count only near their start, so the recall is more than is measured
            near = np.where(owners[trial, 1] < TRIALS, np.minimum(allowed, 2), allowed)
            ok = (np.array(items)[owners[trial, 0]] == found) & (abs(starts - origins[trial]) <= near)
            met[owners[trial[ok], 0], owners[trial[ok], 1], t] = True
    return met, kinds


class Walker:
    """Walks all windows of a text at once and looks them up in hash tables."""

    def __init__(self, index: Index, tables: list[Table]):
        self.index = index
        self.size = len(index.words) + 3
        self.of_walk: dict[int, list[tuple]] = {}
        for t, x in enumerate(tables):
            if not len(x.items):
                continue
            prefix, levels = np.zeros(len(x.keys), np.int64), []
            for d, j in enumerate(x.steps):
                code = prefix * self.size + x.keys[:, d]
                known, prefix = np.unique(code, return_inverse=True)
                levels.append((j, known))
            order = np.argsort(prefix, kind="stable")
            ends = np.searchsorted(prefix[order], np.arange(prefix.max() + 2))
            seen, where = np.zeros(self.size, bool), np.zeros(self.size, np.int64)
            seen[levels[0][1]] = True
            where[levels[0][1]] = np.arange(len(levels[0][1]))
            self.of_walk.setdefault(x.walk, []).append((x.steps[0], t, seen, where, levels[1:], x.items[order], x.at[order], ends))
        for found in self.of_walk.values():
            found.sort(key=lambda x: x[:2])

    def hits(self, symbols: np.ndarray, begin: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, starts, items): where an item would begin whose hash some window shares.

        Walks begin at all symbols, or at those that `begin` lists. Walks that meet stay together, so only the places where walks stand are kept, which
        soon are few. At a table's first step those go on that stand on some item's symbol.
        """
        padded = np.append(symbols, self.index.wall).astype(np.int64)
        for walk, tables in self.of_walk.items():
            blocks: dict[int, np.ndarray] = {}

            def moved(at: np.ndarray, step: int) -> np.ndarray:
                if walk == ALL:
                    return np.minimum(at + 1, len(symbols))
                if step >> 6 not in blocks:
                    bits = self.index.bits[walk, step >> 6].copy()
                    bits[self.index.wall] = 0
                    blocks[step >> 6] = bits[padded]
                go = blocks[step >> 6].take(at)
                go >>= np.uint64(step & 63)
                go &= np.uint64(1)
                return at + go.view(np.int64)

            at, step = np.arange(len(symbols)) if begin is None else begin, 0
            for first, t, seen, where, levels, items, stands, ends in tables:
                while step < first:
                    at = moved(at, step)
                    step += 1
                    if step % 2 == 0:
                        at = at[np.append(True, at[1:] != at[:-1])]
                here = padded[at]
                hit = np.flatnonzero(seen[here])
                begun, pos, code, now = at[hit], at[hit], where[here[hit]], step
                for j, known in levels:
                    while now < j and len(pos):
                        pos, now = moved(pos, now), now + 1
                    full = code * self.size + padded[pos]
                    k = np.searchsorted(known, full)
                    k[k == len(known)] = 0
                    ok = known[k] == full
                    begun, pos, code = begun[ok], pos[ok], k[ok]
                if len(begun):
                    n = ends[code + 1] - ends[code]
                    which = np.repeat(ends[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield t, np.repeat(begun, n) - stands[which], items[which]


class Pattern:
    """An item's words as bit masks, for edit distances by bit-parallel columns."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.masks: dict[int, int] = {}
        self.back: dict[int, int] = {}
        for i, x in enumerate(symbols.tolist()):
            self.masks[x] = self.masks.get(x, 0) | 1 << i
            self.back[x] = self.back.get(x, 0) | 1 << (self.size - 1 - i)

    def from_each(self, text: list[int]) -> list[int]:
        """For each word of text the distance of the closest part that begins there: one pass from the end."""
        full, last = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        out = []
        for x in reversed(text):
            eq = self.back.get(x, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            right = down | (full & ~(diagonal | up))
            left = up & diagonal
            if right & last:
                score += 1
            elif left & last:
                score -= 1
            right <<= 1  # a part may end at any word
            up = (left << 1 | ~(diagonal | right)) & full
            down = right & diagonal & full
            out.append(score)
        return out[::-1]

    def distance(self, text: list[int], most: int) -> tuple[int, int]:
        """(distance, length of the best prefix of text), exact up to `most`, else more than it.

        Each bit of up and down says that the column of the distance table grows
        or falls by one there, so a word of text costs a few operations on
        integers. A prefix that is shorter wins a tie.
        """
        full, last = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        best, length = score, 0
        for k, x in enumerate(text, 1):
            eq = self.masks.get(x, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            right = down | (full & ~(diagonal | up))
            left = up & diagonal
            if right & last:
                score += 1
            elif left & last:
                score -= 1
            right = right << 1 | 1
            up = (left << 1 | ~(diagonal | right)) & full
            down = right & diagonal & full
            if score < best:
                best, length = score, k
            elif score - (len(text) - k) > most and best > most:
                break
        return best, length


class Numbers(dict):
    """Blank-separated words -> numbers of their normalised words, as bytes: 0 if no item has it."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words
        self.same: dict[bytes, bytes] = {}  # most words are in no item, and share one object

    def __missing__(self, raw: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self.same.clear()
        found = array("i", [self.words.get(w, 0) for w in WORD.findall(raw.lower())]).tobytes()
        found = self.same.setdefault(found, found)
        self[raw] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.int32) if text else np.zeros(0, np.int32)


class Finder:
    """Leaks of an index's items in texts."""

    def __init__(self, index: Index, similarity: float = SIMILARITY):
        self.index = index
        self.similarity = similarity
        self.numbers = Numbers(index.words)
        #: Marks of the pairs of neighbouring words of every item, with the item; pairs that share a mark only let more through.
        self.shift = np.uint64(64 - min(24, max(10, 4 + sum(map(len, index.items)).bit_length())))
        self.pair_marks = np.zeros(1 << (64 - int(self.shift)), bool)
        for k, x in enumerate(index.items):
            self.pair_marks[self.pairs(np.full(len(x) - 1, k), x[:-1], x[1:])] = True
        self.lengths = np.array([len(x) for x in index.items], np.int64)
        self.allowed = np.array([edits_allowed(n, similarity) for n in self.lengths], np.int64)
        self.patterns = [Pattern(x) for x in index.items]
        self.walker = Walker(index, index.tables)
        #: Words before a text, by which walks come to its first word at all times; words that a search needs on both sides.
        self.before = 2 * int(self.allowed.max(initial=0)) + 2
        self.around = 4 * index.most + self.before

    def pairs(self, items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The mark of a pair of words of an item: the top bits of a multiplicative hash."""
        size = np.uint64(len(self.index.words) + 3)
        codes = (items.astype(np.uint64) * size + a.astype(np.uint64)) * size + b.astype(np.uint64)
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def dense(self, known: np.ndarray) -> np.ndarray:
        """The symbols at which walks may begin that come into a leak; known: how many words of items there are before each symbol.

        A leak of n words with e edits lies in some window of n + e symbols, of
        which n - e or more are words of items. All other parts of a text, such
        as those in another language, have no leak and need no walk.
        """
        size = len(known) - 1
        marks = np.zeros(size + 1, np.int64)
        for e in np.unique(self.allowed):
            n = self.lengths[self.allowed == e]
            wide = min(int(n.max() + e), size)
            s = np.flatnonzero(known[wide:] - known[: size + 1 - wide] >= n.min() - e)
            marks += np.bincount(np.maximum(s - self.before, 0), minlength=size + 1)
            marks -= np.bincount(np.minimum(s + wide, size), minlength=size + 1)
        return np.flatnonzero(np.cumsum(marks)[:size] > 0)

    def candidates(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item): where items would begin of which some window has a hash."""
        found = [starts * len(self.index.items) + items for _, starts, items in self.walker.hits(symbols, begin)] if len(begin) else []
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.index.items), both % len(self.index.items)

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, words, distance) of leaks; of overlapping windows of an item the best counts.

        The words of all texts stand in one array, behind symbols that no item has; a window
        stays in its text. A candidate says where an item would begin if nothing
        was inserted or dropped before the hash, so windows that begin up to the
        allowed edits around it are aligned.
        """
        index = self.index
        if not index.items:
            return []
        gap = np.array([index.wall, *[index.pad] * self.before], np.int32)
        parts = [x for t in texts for x in (gap, self.numbers.of(t))]
        symbols = np.concatenate(parts) if parts else gap[:0]
        ends = np.cumsum([len(x) for x in parts])[1::2]  # of the texts
        from_ = np.cumsum([len(x) for x in parts])[::2]
        known = np.concatenate([[0], np.cumsum((symbols > 0) & (symbols < index.wall))])
        begin = self.dense(known)
        windows: dict[tuple[int, int], list[list[int]]] = {}
        for lo in range(0, len(symbols), PART):
            first = max(0, lo - self.around)
            last = min(lo + PART + self.around, len(symbols))
            starts, items = self.candidates(symbols[first:last], begin[(begin >= first) & (begin < last)] - first)
            starts = starts + first
            # a start before the symbols of the part is left to the part before it, if there is one
            ok = (starts < lo + PART) & ((starts >= lo) | (lo == 0))
            starts, items = starts[ok], items[ok]
            # the text in which the item would end: its start may lie before the text
            doc = np.minimum(np.searchsorted(ends, starts + self.allowed[items], side="right"), len(ends) - 1)
            since = np.maximum(starts - self.allowed[items], from_[doc])
            upto = np.minimum(starts + self.lengths[items] + 2 * self.allowed[items], ends[doc])
            need = self.lengths[items] - self.allowed[items]
            # an edit parts two pairs of neighbouring words at most
            need_pairs = self.lengths[items] - 1 - 2 * self.allowed[items]
            # without enough words of any item, and then pairs of this item, in the window there is no need to align
            ok = np.flatnonzero((upto > since) & (known[np.maximum(upto, since)] - known[since] >= need))
            for at in range(0, len(ok), 1 << 13):
                k = ok[at : at + (1 << 13)]
                inside = since[k][:, None] + np.arange(int((upto[k] - since[k]).max()))
                near = symbols[np.minimum(inside, len(symbols) - 1)]
                hit = self.pair_marks[self.pairs(items[k][:, None], near[:, :-1], near[:, 1:])] & (inside[:, 1:] < upto[k][:, None])
                for n in k[hit.sum(axis=1) >= need_pairs[k]].tolist():
                    spans = windows.setdefault((int(doc[n]), int(items[n])), [])
                    s, stop = int(since[n]), min(int(starts[n] + self.allowed[items[n]]) + 1, int(ends[doc[n]]))
                    if spans and s <= spans[-1][1]:  # they come in the order of their starts
                        spans[-1][1] = max(spans[-1][1], stop)
                    else:
                        spans.append([s, stop])
        found = []
        for (k, i), spans in windows.items():
            taken: list[tuple[int, int]] = []
            most = int(self.allowed[i])
            tried: dict[int, int] = {}
            for s, stop in spans:
                far = min(stop + len(index.items[i]) + most, int(ends[k]))
                tried.update(zip(range(s, stop), self.patterns[i].from_each(symbols[s:far].tolist())))
            for d, s in sorted((d, s) for s, d in tried.items() if d <= most):
                if any(a <= s < z for a, z in taken):
                    continue
                length = self.patterns[i].distance(symbols[s : min(s + len(index.items[i]) + most, int(ends[k]))].tolist(), most)[1]
                if all(s + length <= a or s >= z for a, z in taken):
                    taken.append((s, s + length))
                    found.append((k, index.ids[i], int(s - from_[k]), length, d))
        return sorted(found)


def items_of(benchmark: DataFrame) -> list[tuple[int, str]]:
    """The benchmark's distinct items; its size is checked before it is brought to the driver."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > 8 * MOST_WORDS:
        raise ValueError(f"the benchmark has {size} characters; split it and run each part")
    return sorted((r["item_id"], r["text"]) for r in rows.collect())


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """keys (doc_id), item_id, start_word, words, distance: passages of docs that are benchmark items.

    A passage is a leak if at most a fifth of an item's words need to be edited
    (replaced, inserted, deleted; words compared in lower case, without
    punctuation). Windows that share a hash with an item are found at the target
    recall for the most edits allowed, and nearly always for fewer; each is then
    verified by its exact edit distance, so nothing else is reported. Of
    overlapping windows of one item the closest is returned, ties to the
    earlier. Null and empty texts and items have no leaks; equal items of
    different ids are each reported; repeated rows are reported each. Other
    columns are ignored. The benchmark's size is checked before it goes to all
    tasks; it doesn't grow with docs.
    """
    index = build(items_of(benchmark), similarity, recall)
    names = keys or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MOST_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, similarity)
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                found = finder.leaks(part.column(b.num_columns - 1).to_pylist())
                if found:
                    rows, *cols = zip(*found)
                    kept = part.take(pa.array(rows, pa.int64()))
                    cols = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *cols], [*b.schema.names[:-1], "item_id", "start_word", "words", "distance"])

    used = docs.select(*names, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*names).schema.fields)
    return used.mapInArrow(run, f"{schema}, item_id long, start_word long, words int, distance int")


def drop_leaky(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs, all columns, in whose text find_leaks() finds nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(build(items_of(benchmark), similarity, recall))  # bounded by MOST_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, similarity)
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                clean = [True] * part.num_rows
                for k, *_ in finder.leaks(part.column(part.schema.get_field_index("text")).to_pylist()):
                    clean[k] = False
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
