"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as squeezed bytes: UTF-8 with A-Z lower-cased and without ASCII white space and
punctuation.  An item of m such bytes may differ from a passage by k = floor(RATE * m) edits.  Cut into k + 1
pieces, a passage within k edits holds at least one piece unchanged, and shifted by at most k.  At a rate of 1 in 20
every piece has at least GRAM bytes, so a piece is found by GRAM of its bytes in a sorted array of all pieces' bytes,
behind a table of hashes that most places of a text don't pass; its first and last GRAM bytes must agree too.  The
window that a hit allows is verified with Myers' bit-parallel edit distance (the item's bits in one integer), which
finds the least distance.  Of a piece's possible bytes those are taken that the fewest pieces share.

Items of fewer than LEAST bytes would be found by chance; they match a text only that is nothing else.  Items travel to
the executors in blocks of at most BLOCK_BYTES of text, one pass over the documents a block; a block takes some 60 bytes
of memory a piece beside its text.

Edge cases: null or empty texts match nothing; items without a letter or digit, and null items, match nothing;
item rows that repeat count once; items of equal text are all reported; of equally good places the first counts;
document rows that repeat are reported each; empty tables give no rows; very long texts are whole, and taken in slices
of bounded rows and bytes; extra columns, of any name, are ignored by the query and kept by the filter.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered_columns, slices, table

RATE = 0.05
GRAM, LEAST = 8, 12
BLOCK_BYTES = 64 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_DROPPED = (string.whitespace + string.punctuation).encode()


def squeeze(text: str | None) -> str:
    """The compared form, each byte as one character."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER, _DROPPED).decode("latin-1")


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed for an item of m bytes; so few that each piece has GRAM bytes."""
    return max(0, min(int(rate * m), m // GRAM - 1))


def cut(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces as even as can be."""
    n, m = k + 1, len(item)
    edges = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """Myers' matcher of one item."""

    def __init__(self, text: str):
        self.m = len(text)
        self.mask = (1 << self.m) - 1
        self.top = 1 << (self.m - 1)
        self.bits: dict[str, int] = {}
        for at, c in enumerate(text):
            self.bits[c] = self.bits.get(c, 0) | 1 << at

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the item to any substring of ``text``, and the first end where it is met."""
        mask, top, get = self.mask, self.top, self.bits.get
        pv, mv, score, least, end = mask, 0, self.m, self.m, 0
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, end = score, at
            ph = ph << 1 & mask
            mh = mh << 1 & mask
            pv = mh | (~(xv | ph) & mask)
            mv = ph & xv
        return least, end


def _grams(raw: bytes) -> np.ndarray:
    """The GRAM bytes at each place, as one number."""
    return np.ndarray((max(0, len(raw) - GRAM + 1),), "<u8", raw, strides=(1,))


class Matcher:
    """All items of a block."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float = RATE):
        ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if form := squeeze(text):
                ids.setdefault(form, []).append(item_id)
        self.short = {form: sorted(set(x)) for form, x in ids.items() if len(form) < LEAST}
        self.items = [(sorted(set(x)), form, budget(len(form), rate)) for form, x in ids.items() if len(form) >= LEAST]
        self.patterns: dict[int, Pattern] = {}
        item, first, last, base = [], [], [], 0
        for n, (_, form, k) in enumerate(self.items):
            for offset, piece in cut(form, k):
                item.append(n)
                first.append(base + offset)
                last.append(base + offset + len(piece) - GRAM)
            base += len(form)
        raw = "".join(form for _, form, _ in self.items).encode("latin-1")
        grams, first, last = _grams(raw), np.array(first, np.int64), np.array(last, np.int64)
        # The places from which a piece may be found; the one with the rarest bytes is taken.
        places = np.stack([first, (first + last) // 2, last])
        found, at, count = np.unique(grams[places], return_inverse=True, return_counts=True)
        best = count[at.reshape(places.shape)].argmin(0)
        place = np.take_along_axis(places, best[None], 0)[0]
        order = np.argsort(grams[place], kind="stable")
        place, first, last = place[order], first[order], last[order]
        self.item = np.array(item, np.int32)[order]
        self.gram, self.head, self.tail = grams[place], grams[first], grams[last]
        self.to_head, self.to_tail = (first - place).astype(np.int32), (last - place).astype(np.int32)
        starts = np.cumsum([0] + [len(form) for _, form, _ in self.items])
        self.inside = place - starts[self.item]  # in the item
        bits = min(27, max(12, int(16 * len(place)).bit_length()))
        self.shift, self.some = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.some[(self.gram * _SPREAD) >> self.shift] = True

    def starts(self, raw: bytes) -> dict[int, list[int]]:
        """Where the items would start by the pieces that the text holds."""
        grams, out = _grams(raw), {}
        for low in range(0, len(grams), 1 << 18):
            part = grams[low : low + (1 << 18)]
            at = np.flatnonzero(self.some[(part * _SPREAD) >> self.shift])
            a, b = (np.searchsorted(self.gram, part[at], side) for side in ("left", "right"))
            n = b - a
            if not n.any():
                continue
            pos = np.repeat(at + low, n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            for to, gram in ((self.to_head, self.head), (self.to_tail, self.tail)):
                there = pos + to[piece]
                same = (there >= 0) & (there < len(grams))
                same[same] = grams[there[same]] == gram[piece[same]]
                pos, piece = pos[same], piece[same]
            for n, start in zip(self.item[piece].tolist(), (pos - self.inside[piece]).tolist(), strict=True):
                out.setdefault(n, set()).add(start)
        return {n: sorted(x) for n, x in out.items()}

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, least distance, end in the squeezed text, edits allowed), one an item found."""
        form = squeeze(text)
        out = [(x, 0, len(form), 0) for x in self.short.get(form, ())]
        if form and self.items:
            for n, at in self.starts(form.encode("latin-1")).items():
                ids, item, k = self.items[n]
                if best := self._verify(n, item, k, at, form):
                    out += [(x, *best, k) for x in ids]
        return out

    def _verify(self, n: int, item: str, k: int, at: list[int], form: str) -> tuple[int, int] | None:
        if any(a >= 0 and form.startswith(item, a) for a in at):
            return 0, next(a for a in at if a >= 0 and form.startswith(item, a)) + len(item)
        if (pattern := self.patterns.get(n)) is None:
            pattern = self.patterns[n] = Pattern(item)
        best, pos = None, 0
        while pos < len(at):  # starts whose windows touch are verified together
            last = pos
            while last + 1 < len(at) and at[last + 1] - at[last] <= 2 * k:
                last += 1
            low = max(0, at[pos] - k)
            distance, end = pattern.best(form[low : at[last] + len(item) + k])
            if distance <= k and (best is None or (distance, low + end) < best):
                best = distance, low + end
            pos = last + 1
        return best


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """The distinct items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and held + len(row.t) > size:
            yield tuple(block)
            block, held = [], 0
        block.append((row.i, row.t))
        held += len(row.t)
    if block:
        yield tuple(block)


HITS = "doc_id long, item_id long, distance int, end_at long, allowed int"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end_at, allowed): every document and item within the item's edits."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], HITS)
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(tuple(sorted(block, key=lambda x: (x[0] is None, x))))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, rate)
            for batch in slices(batches, "text"):
                found = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for x in matcher.find(t.as_py())]
                cols = list(zip(*found, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "end_at", "allowed"])

        out = out.unionByName(rows.mapInArrow(run, HITS))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns are kept."""
    docs, names, (text,) = numbered_columns(docs, text_col)
    spark = docs.sparkSession
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(tuple(sorted(block, key=lambda x: (x[0] is None, x))))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent.value, rate)
            for batch in slices(batches, text):
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(text)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
