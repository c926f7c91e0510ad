"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Kernel: two strings are compared by their subsequences of ORDER characters, each occurrence weighted by
DECAY to its span, so gaps and inserted characters lower a match instead of breaking it; normalised to 0..1,
and cut to 0 below SUPPORT.  A sentence is compared with a landmark by its best-matching string: its words,
words with their punctuation removed ("i.d.i-o.t"), and joined runs of single characters ("i d i o t").

Landmarks are the words that set toxic training documents apart most, and the clean words most like them.  The
Nystroem map K(landmarks)^(-1/2), of the same cut kernel, makes the kernel linear; a squared-hinge SVM is trained
on sentences, where a toxic document's sentences are relabelled in turns (only some of them need be toxic), together
with virtual examples that have a foreign character put into the words.  A document's score is a logistic function
of its highest sentence margin, the number of sentences with a positive margin, and length.

The classifier is fitted on at most SAMPLE labelled documents, those of least id hash; held-out documents
(crc32 of the id as text, mod 5 = 0) are never among them.  Their words are counted, and their sentences compared
with the landmarks, on executors; what reaches the driver is the landmarks and the distinct sentence rows.  Scoring
makes one pass over all whole texts; each distinct word is compared once per worker while it stays in a memory
bounded in words and characters, and most by an upper bound only.

Edge cases: null texts count as empty; an empty text has the score of a document without any match; without
labelled documents of both classes every score is the share of toxic ones, or 0.0 without any; an id whose
label rows differ is toxic; an empty table gives no rows; rows that repeat get equal rows, and count once in
training; words that tie as landmarks are taken alphabetically; very long texts are whole, and taken in slices of
bounded rows and bytes; extra columns, of any name, are ignored by the query and kept by the filter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, claim, numbered_columns, slices, table

ORDER, DECAY, SUPPORT = 3, 0.6, 0.5
LONGEST = 20
LANDMARKS, CONTRAST = 96, 24
SAMPLE = 6000
VIRTUAL = 0.15  # weight of the virtual examples together, against that of the toxic sentences
REMEMBERED, REMEMBERED_CHARS = 60_000, 600_000
DENSE = 100  # characters in landmarks up to which a table of all their triples is held
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
WORD = re.compile(r"[^\W_]+")
CELLS = 100_000  # subsequences compared at once
EDGES = ".,;:!?-_*'\"()"  # stripped from a token that may be a single character
FOREIGN = "\0"  # a character of no word


@cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Index triples of an n-character string, their weights, and a lower bound of any such string's norm."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    w = DECAY ** (at[:, -1] - at[:, 0] + 1).astype(np.float64)
    return at, w, float(np.sqrt((w * w).sum()))


def codes(word: str) -> np.ndarray:
    """The characters' code points, of 21 bits."""
    return np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def _keys(rows: np.ndarray, base: int = 1 << 21) -> np.ndarray:
    """The subsequences' numbers of equally long strings' codes, all below ``base``: (strings, triples)."""
    at = _places(rows.shape[1])[0]
    return (rows[:, at[:, 0]] * base + rows[:, at[:, 1]]) * base + rows[:, at[:, 2]]


def vector(word: str) -> dict[int, float]:
    """The explicit features of a word, normalised."""
    c = codes(word)[None]
    out: dict[int, float] = {}
    if c.shape[1] >= ORDER:
        for k, w in zip(_keys(c)[0].tolist(), _places(c.shape[1])[1].tolist(), strict=True):
            out[k] = out.get(k, 0.0) + w
    norm = sum(x * x for x in out.values()) ** 0.5
    return {k: x / norm for k, x in out.items()}


def kernel(a: str, b: str) -> float:
    """The normalised kernel of two words, without the cut at SUPPORT."""
    x, y = vector(a), vector(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def _norms(wide: np.ndarray) -> np.ndarray:
    """The norms of equally long strings' explicit features."""
    keys = _keys(wide)
    order = np.argsort(keys, axis=1)
    keys, weights = np.take_along_axis(keys, order, 1), _places(wide.shape[1])[1][order]
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(weights.ravel(), starts)
    return np.sqrt(np.bincount(starts // keys.shape[1], weights=sums * sums, minlength=len(keys))).astype(np.float32)


class Landmarks:
    """Kernel values of words with all landmarks."""

    def __init__(self, words: list[str]):
        self.words = words
        rows = [vector(w) for w in words]
        keys = sorted({k for r in rows for k in r})
        row_of = {k: at for at, k in enumerate(keys, 1)}  # row 0: in no landmark
        self.weights = np.zeros((len(keys) + 1, len(words)), np.float32)
        for j, r in enumerate(rows):
            for k, x in r.items():
                self.weights[row_of[k], j] = x
        # The landmarks' own characters are numbered from 1; every other one is 0, and no triple with it is a landmark's.
        letters = np.unique(codes("".join(words)))
        self.letter = np.zeros(1 << 21, np.int16)
        self.letter[letters] = np.arange(1, len(letters) + 1)
        self.base = len(letters) + 1
        wide = np.array(keys, np.int64)
        triples = [self.letter[(wide >> s) & ((1 << 21) - 1)].astype(np.int64) for s in (42, 21, 0)]
        self.known = (triples[0] * self.base + triples[1]) * self.base + triples[2]  # rises with the key
        self.most = self.weights.max(1) if words else np.zeros(1, np.float32)
        self.place = None
        if self.base <= DENSE:
            self.place = np.zeros(self.base**ORDER, np.int32)
            self.place[self.known] = np.arange(1, len(keys) + 1)
            self.most_of = self.most[self.place]

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The keys' rows in ``weights``."""
        if self.place is not None:
            return self.place[keys]
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, at + 1, 0)

    def matrix(self) -> np.ndarray:
        """The landmarks' kernel with each other, with the cut."""
        full = self.weights.T.astype(np.float64) @ self.weights
        return np.where(full >= SUPPORT, full, 0.0)

    def values(self, words: list[str]) -> dict[str, np.ndarray]:
        """The kernel row of each word that reaches SUPPORT with some landmark."""
        by: dict[int, list[str]] = {}
        for w in words:
            if ORDER <= len(w) <= LONGEST:
                by.setdefault(len(w), []).append(w)
        out: dict[str, np.ndarray] = {}
        for n, group in by.items() if self.words else ():
            _, weight, least = _places(n)
            some = max(32, CELLS // len(weight))
            for start in range(0, len(group), some):
                part = group[start : start + some]
                wide = codes("".join(part)).reshape(len(part), n)
                keys = _keys(self.letter[wide].astype(np.int32 if self.place is not None else np.int64), self.base)
                # No landmark's value can exceed this, so most words end here.
                most = self.most_of[keys] if self.place is not None else self.most[self.rows(keys)]
                may = np.flatnonzero(most @ weight.astype(np.float32) >= SUPPORT * least * (1 - 1e-5))
                # Nor this, a landmark at a time; the norm itself is left for those that remain.
                sums = np.zeros((len(may), len(self.words)), np.float32)
                at = self.rows(keys[may])
                row, col = np.nonzero(at)
                if len(row):
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    sums[row[first]] = np.add.reduceat(self.weights[at[row, col]] * weight[col, None].astype(np.float32), first, axis=0)
                left = np.flatnonzero(sums.max(1) >= SUPPORT * least * (1 - 1e-5))
                if len(left):
                    values = sums[left] / _norms(wide[may[left]])[:, None]
                    high = np.flatnonzero(values.max(1) >= SUPPORT)
                    values = np.where(values >= SUPPORT, values, np.float32(0))
                    out |= {part[may[left[r]]]: values[r] for r in high}
        return out


def strings(token: str) -> list[str]:
    """What a white-space token holds: its words, all of it without punctuation, and windows of long ones."""
    parts = WORD.findall(token)
    if len(parts) > 1:
        parts.append("".join(parts))
    out = []
    for p in parts:
        if len(p) <= LONGEST:
            out.append(p)
        else:
            half = LONGEST // 2
            out += [p[k : k + LONGEST] for k in range(0, len(p) - half, half)]
    return out


def spelled(tokens: list[str]) -> list[str]:
    """Joined runs of three or more single characters, in windows of at most LONGEST."""
    out, run = [], []
    for t in [*tokens, ""]:
        core = t.strip(EDGES)
        if len(core) == 1:
            run.append(core)
            continue
        if len(run) >= ORDER:
            out += strings("".join(run))
        run = []
    return out


class Matcher:
    """Finds the tokens of texts that resemble a landmark; remembers those seen.

    Tokens without a resemblance are remembered in two generations: a full one becomes the old one, whose tokens come
    back when they are met again, so that a flood of unique tokens doesn't wash out the common ones.
    """

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.cold: set[str] = set()
        self.aged: set[str] = set()
        self.hot: dict[str, np.ndarray] = {}
        self.singles: set[str] = set()  # tokens that ``spelled`` takes for a single character
        self.chars = 0

    def fresh(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that must be learnt.  Memories are emptied before, so that none of the tokens gets lost."""
        if len(self.cold) > REMEMBERED // 2 or self.chars > REMEMBERED_CHARS // 2:
            self.aged, self.cold, self.chars = self.cold, set(), 0
            self.singles &= self.aged
        if len(self.hot) > REMEMBERED // 10:
            self.hot.clear()
        back = tokens & self.aged
        self.cold |= back
        self.aged -= back
        self.chars += sum(map(len, back))
        return tokens.difference(self.cold, self.hot)

    def learn(self, tokens: set[str]) -> None:
        plain = {t for t in tokens if t.isalnum() and len(t) <= LONGEST}  # these are their only string
        held = {t: strings(t) for t in tokens.difference(plain)}
        found = self.landmarks.values(list({s for x in held.values() for s in x}.union(t for t in plain if len(t) >= ORDER)))
        for t, x in held.items():
            if rows := [found[s] for s in x if s in found]:
                self.hot[t] = np.max(rows, axis=0)
        self.hot |= {s: row for s, row in found.items() if s in plain}
        cold = tokens.difference(self.hot)
        self.cold |= cold
        self.chars += sum(map(len, cold))
        self.singles |= {t for t in plain if len(t) == 1}
        self.singles |= {t for t in held if len(t.strip(EDGES)) == 1}

    def pieces(self, text: str) -> list[list[str]]:
        """The sentences' tokens; between two single characters no sentence ends ("i. d. i. o. t.")."""
        out: list[list[str]] = []
        for sentence in SENTENCE.split(text):
            parts = sentence.split()
            if parts and out and parts[0] in self.singles and out[-1][-1] in self.singles:
                out[-1] += parts
            elif parts:
                out.append(parts)
        return out

    def sentences(self, texts: list[str]) -> list[tuple[list[np.ndarray], int]]:
        """For each text the rows of its sentences that resemble a landmark, and its number of tokens."""
        lows = [t.lower() for t in texts]
        tokens = [t.split() for t in lows]
        distinct = [set(t) for t in tokens]
        if fresh := self.fresh(set().union(*distinct)):
            self.learn(fresh)
        out = []
        for low, all_tokens, own in zip(lows, tokens, distinct, strict=True):
            rows: list[np.ndarray] = []
            # The test of ``spelled`` on the whole text: ORDER tokens in a row with one character each.
            single = b"\1" * ORDER in bytes(map(self.singles.__contains__, all_tokens))
            if single or not own.isdisjoint(self.hot):
                for parts in self.pieces(low) if single else map(str.split, SENTENCE.split(low)):
                    got = [self.hot[t] for t in set(parts) if t in self.hot]
                    if single and (joined := spelled(parts)):
                        got += self.landmarks.values(joined).values()
                    if got:
                        rows.append(np.max(got, axis=0))
            out.append((rows, len(all_tokens)))
        return out


@dataclass
class Model:
    """A fitted classifier; small enough to be sent with a task."""

    words: list[str] = field(default_factory=list)
    map: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    logit: np.ndarray | None = None
    constant: float = 0.0

    def margins(self, rows: list[np.ndarray] | np.ndarray) -> np.ndarray:
        return np.asarray(rows) @ (self.map @ self.weights) + self.bias if len(rows) else np.zeros(0)

    def signals(self, rows: list[np.ndarray], tokens: int) -> list[float]:
        m = np.concatenate([self.margins(rows), [self.bias]])
        m.sort()
        return [1.0, m[-1], float(np.log1p((m > 0).sum())), float(np.log1p(max(tokens, 30)))]

    def score(self, rows: list[np.ndarray], tokens: int) -> float:
        if self.logit is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.signals(rows, tokens), self.logit), -30, 30))))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, n: float, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows inside the margin; ``cost`` is each row's, of ``n`` sentences."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.full(x1.shape[1], ridge * cost.sum() / n * 10)
    reg[-1] = 1e-6
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        xi, ci = x1[inside], cost[inside]
        fresh = np.linalg.solve((xi * ci[:, None]).T @ xi + np.diag(reg), xi.T @ (ci * y[inside]))
        if np.abs(fresh - w).max() < 1e-8:
            break
        w = fresh
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (y - p) - reg * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def inserted(word: str) -> list[str]:
    """The word with a foreign character put in at each of two places."""
    n = len(word)
    return [word[:k] + FOREIGN + word[k:] for k in (n // 3 + 1, n - n // 3)]


def found(text: str) -> set[str]:
    """The strings of a text that may be landmarks."""
    return {s for t in set(text.lower().split()) for s in strings(t) if len(s) >= ORDER}


def is_surplus(toxic: Column, clean: Column, n1: int, n0: int) -> tuple[Column, Column]:
    """How significant a word's surplus in toxic texts is, and whether it is one."""
    share, other, pooled = toxic / n1, clean / n0, (toxic + clean) / (n1 + n0)
    z = (share - other) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    return z, (toxic >= 3) & (share > 3 * other) & (z > 4)


def choose_landmarks(counts: DataFrame, n1: int, n0: int) -> tuple[list[str], int]:
    """Words with the most significant surplus in toxic texts, then the clean words most like them; and how many the
    former are.  ``counts`` has (word, toxic, clean): the numbers of ``n1`` toxic and ``n0`` clean texts that hold a word."""
    z, good = is_surplus(F.col("toxic"), F.col("clean"), n1, n0)
    chosen = [r.word for r in counts.where(good).orderBy(z.desc(), "word").select("word").limit(LANDMARKS).collect()]
    if not chosen:
        return [], 0

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", _HELD.clear)
        landmarks = Landmarks(chosen)
        for batch in batches:
            n = dict(zip(batch.column("word").to_pylist(), batch.column("clean").to_pylist(), strict=True))
            like = landmarks.values(list(n))
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(like), pa.string()), "near": pa.array([float(x.max() * np.log1p(n[w]) * (len(w) > 5)) for w, x in like.items()], pa.float64())})

    usual = counts.where((F.col("clean") > 0) & (F.col("toxic") / n1 <= 3 * F.col("clean") / n0) & ~F.col("word").isin(chosen))
    near = usual.select("word", "clean").mapInArrow(alike, "word string, near double").orderBy(F.desc("near"), "word").limit(CONTRAST).collect()
    return chosen + [r.word for r in near], len(chosen)


@dataclass
class Bags:
    """Training texts by their distinct sentence rows: text ``of[i]`` has ``count[i]`` sentences with row ``row[i]``."""

    rows: np.ndarray
    of: np.ndarray
    row: np.ndarray
    count: np.ndarray
    y: np.ndarray
    tokens: np.ndarray


def fit(words: list[str], surplus: int, bags: Bags) -> Model:
    """A model from the landmarks, of which the first ``surplus`` mark toxic texts, and the training texts' rows.

    Equal rows with equal marks are one row of the solver, so its size is that of the distinct rows.
    """
    landmarks = Landmarks(words)
    values, vectors = np.linalg.eigh(landmarks.matrix())
    good = values > 1e-3 * values.max()
    model = Model(words, vectors[:, good] / np.sqrt(values[good]))
    # Virtual examples: the surplus words with a character put in, as sentences of their own.
    virtual = list(landmarks.values([v for w in words[:surplus] for v in inserted(w)]).values())
    rows = np.concatenate([bags.rows, np.zeros((1, len(words)), np.float32), np.array(virtual, np.float32).reshape(-1, len(words))]) @ model.map
    n = len(bags.rows)
    of, row, count = np.append(bags.of, len(bags.y)), np.append(bags.row, n), np.append(bags.count, 1).astype(np.float64)
    toxic = np.append(bags.y, 0)[of] == 1
    mark = toxic.copy()
    for _ in range(4):  # a toxic document's sentences below the margin turn clean, but for its best one
        total = np.zeros((2, len(rows)))
        np.add.at(total, (mark.astype(int), row), count)
        clean, dirty = total[0].sum(), total[1].sum() + len(virtual)
        both = (clean + dirty) / 2
        # The classes weigh the same; the virtual examples weigh VIRTUAL of the toxic class beside it.
        total[0] *= both / max(1.0, clean)
        total[1] *= both / max(1.0, dirty)
        total[1, n + 1 :] = both / max(1.0, dirty) * VIRTUAL * dirty / max(1, len(virtual))
        sign, at = np.nonzero(total)
        model.weights, model.bias = _svm(rows[at], 2.0 * sign - 1, total[sign, at], clean + dirty)
        f = (rows @ model.weights + model.bias)[row]
        best = np.full(len(bags.y) + 1, -np.inf)
        np.maximum.at(best, of, f)
        fresh = toxic & ((f > 0) | (f >= best[of]))
        if (fresh == mark).all():
            break
        mark = fresh
    # The signals of the whole texts; a text without any row has the bias as its margin.
    f = model.margins(bags.rows)[bags.row]
    highest, above = np.full(len(bags.y), model.bias), np.full(len(bags.y), float(model.bias > 0))
    np.maximum.at(highest, bags.of, f)
    np.add.at(above, bags.of, bags.count * (f > 0))
    model.logit = _logistic(np.column_stack([np.ones(len(bags.y)), highest, np.log1p(above), np.log1p(np.maximum(bags.tokens, 30))]), bags.y.astype(float))
    return model


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("toxicity", _HELD.clear)
    by = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list({**by[0], **by[1]})
        out = {"word": pa.array(words, pa.string()), "toxic": pa.array([by[1][w] for w in words], pa.int64()), "clean": pa.array([by[0][w] for w in words], pa.int64())}
        for c in by:
            c.clear()
        return pa.RecordBatch.from_pydict(out)

    for batch in slices(batches, "text", 64, 1 << 20):
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by[y].update(found(text))
        if len(by[0]) + len(by[1]) > 50_000:
            yield flush()
    yield flush()


def train_on(texts: DataFrame, scratch: Scratch) -> Model:
    """A model from rows (text, y), written to ``scratch`` on the way; y is 0 or 1."""
    sample = scratch.save(texts.select("text", F.col("y").cast("int").alias("y")))
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(constant=float(bool(n1)))
    counts = sample.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = scratch.save(counts.where("toxic >= 3 OR clean >= 1"))
    words, surplus = choose_landmarks(counts, n1, n0)
    if not words:
        return Model(constant=n1 / (n1 + n0))

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(words)
        for batch in slices(batches, "text", 64, 1 << 20):
            made = matcher.sentences(batch.column("text").to_pylist())
            rows = [Counter(np.asarray(r, np.float32).tobytes() for r in rows) for rows, _ in made]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "tokens": pa.array([t for _, t in made], pa.int64()), "rows": pa.array([list(c) for c in rows], pa.list_(pa.binary())), "n": pa.array([list(c.values()) for c in rows], pa.list_(pa.int64()))})

    made = scratch.save(sample.mapInArrow(bags, "y int, tokens long, rows array<binary>, n array<long>"))
    # Distinct rows come once; a text comes with their hashes.
    distinct = made.select(F.explode("rows").alias("row")).distinct().select(F.xxhash64("row").alias("h"), "row").collect()
    place = {r.h: at for at, r in enumerate(sorted(distinct, key=lambda r: bytes(r.row)))}
    rows = np.frombuffer(b"".join(sorted(bytes(r.row) for r in distinct)), np.float32).reshape(len(distinct), len(words))
    del distinct
    texts = sorted((r.y, r.tokens, sorted((place[h], n) for h, n in zip(r.h, r.n, strict=True))) for r in made.select("y", "tokens", F.transform("rows", lambda x: F.xxhash64(x)).alias("h"), "n").collect())
    flat = [(k, at, n) for k, (_, _, x) in enumerate(texts) for at, n in x]
    of, row, count = (np.array([x[j] for x in flat], np.int64) for j in range(3))
    return fit(words, surplus, Bags(rows, of, row, count, np.array([y for y, _, _ in texts], np.int64), np.array([t for _, t, _ in texts], np.int64)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out; no text comes to the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    spark = docs.sparkSession
    picked = spark.createDataFrame([(r.id, int(r.y)) for r in some.collect()], "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    scratch = Scratch(spark, "toxicity-training")
    model = train_on(texts.distinct(), scratch)
    scratch.keep()
    return model


_HELD: dict[int, Matcher] = {}


def _matcher(words: list[str]) -> Matcher:
    """The worker's matcher of these landmarks, with what it remembers."""
    claim("toxicity", _HELD.clear)
    key = hash(tuple(words))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Matcher(Landmarks(words))
    return _HELD[key]


def _scores(model: Model, texts: list[str]) -> list[float]:
    if model.logit is None:
        return [model.constant] * len(texts)
    matcher, out = _matcher(model.words), []
    for at in range(0, len(texts), 256):
        out += [model.score(rows, n) for rows, n in matcher.sentences(texts[at : at + 256])]
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = _scores(sent.value, [x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    docs, names, (text,) = numbered_columns(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            s = _scores(sent.value, [x or "" for x in batch.column(text).to_pylist()])
            yield batch.filter(pa.array([x < 0.5 for x in s], pa.bool_()))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
