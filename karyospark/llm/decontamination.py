"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Texts and items are lower-cased and each run of white space is one blank. An item of m characters that occurs with at
most k edits keeps m - q + 1 - k*q of its q-grams, all within k diagonals (Jokinen and Ukkonen, "Two algorithms for
approximate string matching in static texts", 1991). So a text's q-grams that an item has are counted in diagonal
bands of twice k + 1, laid twice so that they overlap by half; a band below the bound cannot hold the item. Bands that reach
it are verified: the item is aligned to that part of the text within the band.

The items are sent to the tasks in blocks of bounded size; texts are scanned where they lie, and nothing is
shuffled. An item's budget is ``edit_share`` of its length, less where the lemma would prove nothing for short items;
items shorter than q must occur exactly.

Defined results: null or empty items and texts match nothing; repeated rows are reported each; null ids are kept; items
of equal text are reported each; an empty table gives no rows; other columns are never read. Texts of any length are
scanned whole. Of overlapping places of one item in one text the one with fewest edits, then the first, is reported.
Places count characters of the normalised text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common

Q, EDIT_SHARE, TABLE_BITS = 8, 0.10, 22
#: Characters of items that one pass over the texts looks for.
BLOCK_CHARS = 4_000_000
LEAKS = "doc_id long, item_id long, start long, length long, edits int, item_chars int"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text with single blanks."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of Q = 8 code points, by doubling."""
    h, n = codes.astype(np.uint64) + np.uint64(1), 1
    if len(h) < Q:
        return h[:0]
    step = int(_STEP)
    while n < Q:
        h = h[:-n] * np.uint64(pow(step, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class ItemIndex:
    """Items of one block by q-gram."""

    items: list[tuple[int | None, np.ndarray]]
    edit_share: float = EDIT_SHARE

    def __post_init__(self):
        size = np.array([len(c) for _, c in self.items], np.int64)
        self.budget = np.minimum((size * self.edit_share).astype(np.int64), np.maximum(0, (size - Q) // Q))
        self.bound = size - Q + 1 - self.budget * Q
        self.band = 2 * (self.budget + 1)
        grams = [qgrams(c) for _, c in self.items]
        flat = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.grams, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.short = [(k, c.tobytes()) for k, (_, c) in enumerate(self.items) if 0 < len(c) < Q]

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, diagonal and place in the item of every shared q-gram."""
        h = qgrams(codes)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, h[at]), max(0, len(self.grams) - 1))
        if not len(self.grams):
            return at[:0], at[:0], at[:0]
        same = self.grams[k] == h[at]
        at, k = at[same], k[same]
        n = self.count[k]
        posting = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.item[posting], np.repeat(at, n) - self.place[posting], self.place[posting]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of every band that reaches the bound."""
        item, diagonal, place = self.hits(codes)
        out = set()
        if len(item):
            width, base = self.band[item], int(self.band.max()) * 2 + len(codes) + int(max(len(c) for _, c in self.items))
            for shift in (0, 1):
                band = (diagonal + shift * (width // 2)) // width
                key = item * (2 * base) + band + base
                order = np.argsort(key, kind="stable")
                key, where, its = key[order], place[order], diagonal[order] + place[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                count = np.diff(np.append(first, len(key)))
                for a, n in zip(first[enough := count >= self.bound[key[first] // (2 * base)]].tolist(), count[enough].tolist(), strict=True):
                    i = int(key[a]) // (2 * base)
                    # a q-gram that comes several times in the band counts once on either side
                    if min(len(np.unique(where[a:a + n])), len(np.unique(its[a:a + n]))) >= self.bound[i]:
                        low = (int(key[a]) % (2 * base) - base) * int(self.band[i]) - shift * (int(self.band[i]) // 2)
                        out.add((i, low, low + int(self.band[i]) - 1))
        return sorted(out)

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, length, edits) of every verified place."""
        codes = normalise(text)
        found: list[tuple[int, int, int, int]] = []
        for i, low, high in self.regions(codes):
            got = align(self.items[i][1], codes, low, high, int(self.budget[i]))
            if got:
                found.append((i, *got))
        if self.short and len(codes):
            raw = codes.tobytes()
            for i, item in self.short:
                at = raw.find(item)
                while at >= 0:
                    if at % 4 == 0:
                        found.append((i, at // 4, len(item) // 4, 0))
                    at = raw.find(item, at + (4 if at % 4 == 0 else 1))
        kept: list[tuple[int, int, int, int]] = []
        for i, start, length, edits in sorted(set(found), key=lambda x: (x[0], x[3], x[1])):
            if all(i != k or start >= s + n or s >= start + length for k, s, n, _ in kept):
                kept.append((i, start, length, edits))
        return sorted(kept, key=lambda x: (x[1], x[0]))


def _rows(item: np.ndarray, window: np.ndarray, width: int, begins: np.ndarray) -> np.ndarray:
    """Edits of aligning all of ``item`` to ``window``, for each end diagonal 0..width; ``begins``: cost of each begin."""
    offset, d, padded = np.arange(width + 1), begins.astype(np.int64), np.concatenate((window, np.full(width + len(item) + 1, 0xFFFFFFFF, np.uint32)))
    d = np.minimum.accumulate(d - offset) + offset
    up = np.empty_like(d)
    for i, c in enumerate(item):
        up[:-1], up[-1] = d[1:] + 1, 1 << 40
        d = np.minimum(d + (padded[i:i + width + 1] != c), up)
        d = np.minimum.accumulate(d - offset) + offset
    return d


def align(item: np.ndarray, codes: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(start, length, edits) of the best alignment of ``item`` that starts on diagonals ``low``..``high``, or None."""
    low, high = max(0, low - budget), min(len(codes), high + budget)
    if high < low:
        return None
    window = codes[low:high + len(item) + budget]
    at = window.tobytes().find(item.tobytes())
    if at >= 0 and at % 4 == 0:
        return low + at // 4, len(item), 0
    width = high - low + 2 * budget
    d = _rows(item, window, width, np.zeros(width + 1))
    ends = np.arange(width + 1) + len(item)
    d = np.where(ends <= len(window), d, 1 << 40)
    edits = int(d.min())
    if edits > budget:
        return None
    end = int(ends[int(d.argmin())])
    back = window[:end][::-1]
    free = np.full(2 * budget + 1, 1 << 20)
    free[budget] = 0  # the alignment ends there; starts lie within the budget to either side
    padded = np.concatenate((np.full(budget, 0xFFFFFFFE, np.uint32), back))
    starts = _rows(item[::-1], padded, 2 * budget, free)
    lengths = np.arange(2 * budget + 1) + len(item) - budget
    starts = np.where(lengths <= end, starts, 1 << 40)
    length = int(lengths[int(starts.argmin())])
    return low + end - length, length, edits


def _scan(index: ItemIndex):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for i, start, length, edits in index.leaks(text) if text else ():
                    item_id, codes = index.items[i]
                    for column, v in zip(out, (doc_id, item_id, start, length, edits, len(codes)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.int32()] * 2, strict=True)],
                                             ["doc_id", "item_id", "start", "length", "edits", "item_chars"])
    return run


def item_blocks(benchmark: DataFrame, edit_share: float, block_chars: int) -> Iterator[ItemIndex]:
    """The items, as many at a time as ``block_chars`` allows."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield ItemIndex([(r.item_id, c) for r in rows if len(c := normalise(r.text))], edit_share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every verified place of a benchmark item in a document, one row each."""
    texts = common.in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [texts.mapInArrow(_scan(index), LEAKS) for index in item_blocks(benchmark, edit_share, block_chars)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    def clean(index: ItemIndex):
        return lambda texts: [not index.leaks(t) for t in texts]

    for index in item_blocks(benchmark, edit_share, block_chars):
        docs = common.kept(docs, clean(index))
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
