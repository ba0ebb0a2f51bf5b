"""Packing of tokenised examples into training sequences: vector bin packing with a dot-product heuristic.

An example has three demands: tokens, one segment, and loss-bearing tokens. A sequence has a capacity of each. A
sequence is filled by taking, again and again, the example with the largest dot product of its demands and the
sequence's free capacities, each divided by the capacity (Panigrahy et al., "Heuristics for vector bin packing",
2011), so that long examples are met by short ones before the segments run out. Examples longer than a sequence are
cut first; when nothing whole fits, the best example is cut to fill the gap.

Each task packs its own rows, so nothing is shuffled and no group can be hot. A task reads windows of bounded size;
what doesn't fill a sequence moves on to the next window. The last sequences of a task are cut at powers of two, so
they need no padding if lengths are padded to a power of two.

Defined results: a null or empty text still has its end id; equal rows are packed as separate examples; a null id is
kept; an empty table gives no sequence; other columns are ignored. Each id of an example lies in exactly one piece.
A sequence's number is its task's number and a counter, the same whenever the same input is read the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common, tokens

#: Words whose ids a worker remembers.
WORD_MEMORY = 500_000
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, segment int, loss_tokens long")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; ``window`` is the number of examples placed at a time by one task."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    window: int = 1500
    window_tokens: int = 2_000_000


@dataclass
class Example:
    """A run of ids of one document: its place there, the ids, and the running count of loss-bearing ids."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray  # loss[i]: loss-bearing ids among the first i
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, at: int) -> tuple[Example, Example]:
        return (Example(self.doc_id, self.start, self.ids[:at], self.loss[: at + 1], self.doc_tokens),
                Example(self.doc_id, self.start + at, self.ids[at:], self.loss[at:] - self.loss[at], self.doc_tokens))

    def fitting(self, room: int, loss: int) -> int:
        """The longest prefix within ``room`` ids and ``loss`` loss-bearing ids."""
        return min(room, len(self), int(np.searchsorted(self.loss, loss, side="right")) - 1)


def fill(pool: list[Example], limits: Limits, last: bool) -> tuple[list[list[Example]], list[Example]]:
    """Full sequences made from ``pool``, and the examples that are left; with ``last`` nothing is left."""
    items: list[Example] = []
    for e in pool:
        while (at := e.fitting(limits.tokens, limits.loss)) < len(e):
            head, e = e.cut(max(at, 1))
            items.append(head)
        items.append(e)
    capacity = np.array([limits.tokens, limits.segments, limits.loss], float)
    need = np.array([(len(e), 1, e.loss[-1]) for e in items], float).reshape(-1, 3)
    weight = need / capacity
    alive, done = np.ones(len(items), bool), []
    while alive.any():
        if not last and (need[alive].sum(0) < capacity)[[0, 2]].all() and alive.sum() < limits.segments:
            break
        free, chosen = capacity.copy(), []
        while free[1] >= 1 and free[0] >= 1 and alive.any():
            value = weight @ (free / capacity)
            fits = alive & (need <= free).all(1)
            if fits.any():
                k = int(np.argmax(np.where(fits, value, -1)))
                if free[1] == 1 and need[k, 0] < free[0] and (alive & ~fits).any():
                    k = -1  # the last segment: rather fill the gap with a cut
            else:
                k = -1
            if k < 0:
                k = int(np.argmax(np.where(alive & ~fits, value, -1)))
                at = items[k].fitting(int(free[0]), int(free[2]))
                if at < 1:
                    break
                head, items[k] = items[k].cut(at)
                need[k] = (len(items[k]), 1, items[k].loss[-1])
                weight[k] = need[k] / capacity
                chosen.append(head)
                free -= (len(head), 1, head.loss[-1])
            else:
                alive[k] = False
                chosen.append(items[k])
                free -= need[k]
        if not chosen:
            break
        if not last and free[0] >= 1 and free[1] >= 1 and free[2] >= 1:
            return done, [*chosen, *(e for e, a in zip(items, alive, strict=True) if a)]
        done.append(chosen)
    return done, [e for e, a in zip(items, alive, strict=True) if a]


def at_powers_of_two(sequence: list[Example], full: int) -> list[list[Example]]:
    """The sequence, cut so that each part's length is a power of two or ``full``."""
    total = sum(map(len, sequence))
    if total == full or total & (total - 1) == 0:
        return [sequence]
    out, rest = [], list(sequence)
    while rest:
        size, part = 1 << (total.bit_length() - 1), []
        total -= size
        while size:
            e = rest.pop(0)
            if len(e) > size:
                e, tail = e.cut(size)
                rest.insert(0, tail)
            size -= len(e)
            part.append(e)
        out.append(part)
    return out


class _Packer:
    """Packs a task's examples window by window and gives out rows of PIECES."""

    def __init__(self, limits: Limits):
        self.limits, self.pool, self.size = limits, [], 0
        ctx = TaskContext.get()
        self.number = (ctx.partitionId() if ctx else 0) << 33

    def add(self, e: Example) -> bool:
        self.pool.append(e)
        self.size += len(e)
        return len(self.pool) >= self.limits.window or self.size >= self.limits.window_tokens

    def rows(self, last: bool = False) -> pa.RecordBatch:
        done, self.pool = fill(self.pool, self.limits, last)
        self.size = sum(map(len, self.pool))
        cols: list[list] = [[] for _ in range(9)]
        for whole in done:
            for sequence in at_powers_of_two(whole, self.limits.tokens):
                offset = 0
                for segment, e in enumerate(sequence):
                    row = (e.doc_id, e.start, len(e), zlib.crc32(e.ids.astype("<u4")), e.doc_tokens, self.number, offset, segment, int(e.loss[-1]))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    offset += len(e)
                self.number += 1
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                          [x.split()[0] for x in PIECES.split(", ")])


def _pack(path: str, end_id: int, limits: Limits):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = tokens.encoder(path, WORD_MEMORY), _Packer(limits)
        for b in common.batches(it, 500, 8 << 20):
            ids, parts = b.column("doc_id").to_pylist(), b.column("parts").to_pylist()
            flat = [p["text"] or "" for ps in parts for p in ps]
            got = iter(enc.encode(flat))
            for doc_id, ps in zip(ids, parts, strict=True):
                runs = [next(got) for _ in ps]
                whole = np.concatenate([*runs, np.array([end_id], enc.kind)])
                bears = np.repeat([*(bool(p["loss"]) for p in ps), bool(ps and ps[-1]["loss"])], [*map(len, runs), 1])
                loss = np.concatenate(([0], np.cumsum(bears)))
                if packer.add(Example(doc_id, 0, whole, loss, len(whole))):
                    yield packer.rows()
        yield packer.rows(last=True)
    return run


def pack(examples: DataFrame, vocabulary: str, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Pieces of packed sequences, from ``doc_id`` and ``parts``: array<struct<text, loss>> in order.

    A part's ids bear loss if ``loss`` is true; the end id takes after the last part.
    """
    return common.in_batches(examples.select("doc_id", "parts")).mapInArrow(_pack(vocabulary, end_id, limits), PIECES)


def document_examples(docs: DataFrame) -> DataFrame:
    """A document as an example of one part, all of it loss-bearing."""
    part = F.struct(F.col("text").alias("text"), F.lit(True).alias("loss"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(part).alias("parts"))


def conversation_examples(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """A conversation as an example: its turns in order, loss on the turns of ``loss_role``.

    Turns of one number are ordered by role and text. A conversation must fit a task's memory.
    """
    turn = F.struct("turn", "role", "text")
    parts = F.transform(F.array_sort(F.collect_list(turn)),
                        lambda t: F.struct(t["text"].alias("text"), F.coalesce(t["role"] == loss_role, F.lit(False)).alias("loss")))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(parts.alias("parts"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pack(document_examples(docs), tokens.vocabulary_path("word_bpe_49k.json"))
