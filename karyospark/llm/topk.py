"""Exact top-k search by inner product: an impact-ordered index, processed score at a time.

Vectors are dealt to blocks by a hash of their id. A block's index has, for each dimension, a posting segment per
quantised impact: the vectors whose component falls into that step. For a query, a segment's impact is the step's
least contribution (query component times component, counted from the smallest possible one), and segments are
processed by descending impact, adding it to the scores of their vectors (Anh and Moffat, "Pruned query evaluation
using pre-computed impacts", 2006). What a vector can still gain is bounded by the next segments and by the width of
the steps. Processing stops only when this bound proves that few vectors can be among the best; all those
are rescored exactly. The bound is checked at steps, and if it never prunes, every segment is processed and
every possible member is rescored: the result is exact in each case.

Queries travel in blocks too, each to every block of vectors, so no task holds all of either.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do empty ones and
rows without an id; a query meets only vectors of its own length and none with its own id; equal query rows give
one result, equal candidate rows count each; ties go to the smaller id. An empty table gives no rows. Components
must lie within 2^24 after scaling, else the job fails with a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karyospark.llm import common

BLOCK, QUERY_BLOCK, STEPS = 8192, 512, 16
_PACKED = "block long, dim int, ids binary, matrix binary, keys binary"


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, steps: int = STEPS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = self.vectors.min(0), self.vectors.max(0)
        self.width = np.maximum(1, -(-(self.high - self.low + 1) // steps))
        self.steps = steps
        level = (self.vectors - self.low) // self.width
        self.segments: list[list[np.ndarray]] = []
        for d in range(self.vectors.shape[1]):
            by = np.argsort(level[:, d], kind="stable")
            cuts = np.searchsorted(level[by, d], np.arange(steps + 1))
            self.segments.append([by[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)])

    def plan(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dimension and step of each segment in processing order, and its least contribution from the smallest possible."""
        steps = np.arange(self.steps)
        size = np.abs(query)[:, None]
        top = np.maximum(0, self.high - self.low)[:, None]
        up = size * np.minimum(steps * self.width[:, None], top)
        down = size * np.maximum(0, top - ((steps + 1) * self.width[:, None] - 1))
        impact = np.where(query[:, None] >= 0, up, down)
        filled = np.array([[len(s) > 0 for s in segments] for segments in self.segments]) & (size > 0)
        d, s = np.nonzero(filled)
        order = np.lexsort((s, d, -impact[d, s]))
        return d[order], s[order], impact[d, s][order]

    def search(self, query: np.ndarray, own: int, k: int, few: int = 64, stride: int = 128) -> tuple[np.ndarray, np.ndarray, int]:
        """The best ``k`` ids and scores, and how many segments were processed."""
        n = len(self.ids)
        dims, steps, impact = self.plan(query)
        error = np.abs(query) * (self.width - 1)
        slack = np.abs(query) * (self.high - self.low)
        score, taken = np.zeros(n, np.int64), 0
        mine = self.ids == own
        possible = np.flatnonzero(~mine)
        while taken < len(dims) and len(possible) > max(few, 2 * k):
            end = min(taken + stride, len(dims))
            for d, s, add in zip(dims[taken:end].tolist(), steps[taken:end].tolist(), impact[taken:end].tolist(), strict=True):
                if add:
                    score[self.segments[d][s]] += add
            taken = end
            # what is left in a dimension: its next segment, whole, or the rounding of one that was processed
            rest = error.copy()
            d, first = np.unique(dims[taken:], return_index=True)
            rest[d] = np.minimum(slack[d], impact[taken:][first] + error[d])
            rest = np.maximum(rest, np.minimum(error, slack))
            if len(possible) > k:
                least = np.partition(score[possible], len(possible) - k)[len(possible) - k]
                possible = possible[score[possible] + int(rest.sum()) >= least]
        exact = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][best], exact[best], taken


def integer_vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, vector: array<bigint>, of the rows that take part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0)).where(~bad)
    return usable.select(F.col(key).cast("long").alias("vec_id"),
                         F.transform(column, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def _pack(group: pa.Table) -> pa.Table:
    flat = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() > 1 << 24:
        raise ValueError("a component is beyond 2^24 after scaling")
    one = {"block": [group.column("block")[0].as_py()], "dim": [group.column("dim")[0].as_py()],
           "ids": [group.column("vec_id").to_numpy().astype("<i8").tobytes()], "matrix": [flat.astype("<i4").tobytes()],
           "keys": [group.column("vector_hash").to_numpy().astype("<i8").tobytes()]}
    return pa.table(one, pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("keys", pa.binary())]))


def packed(vectors: DataFrame, rows: int, size: int) -> DataFrame:
    """Blocks of about ``size`` vectors of one length, each a single row."""
    blocks = max(1, -(-rows // size))
    keyed = vectors.select("vec_id", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("vector_hash"),
                           F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).alias("block"))
    return keyed.groupBy("block", "dim").applyInArrow(_pack, _PACKED)


def _search(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for b in it:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                shape = (-1, row["dim"])
                if (row["block"], row["dim"]) != last:
                    last = (row["block"], row["dim"])
                    index = ImpactIndex(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["matrix"], "<i4").reshape(shape).astype(np.int64))
                ids, keys = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_keys"], "<i8")
                queries = np.frombuffer(row["q_matrix"], "<i4").reshape(shape).astype(np.int64)
                out: list[list] = [[], [], [], []]
                for q, key, vector in zip(ids.tolist(), keys.tolist(), queries, strict=True):
                    found, scores, _ = index.search(vector, q, k)
                    for column, values in zip(out, ([q] * len(found), [key] * len(found), found.tolist(), scores.tolist()), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "query_hash", "vec_id", "score"])
    return run


def search(vectors: DataFrame, is_query: Column, k: int, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` holds for, its ``k`` best among all other rows."""
    rows = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    candidates = packed(vectors, rows.n, block)
    blocks = max(1, -(-rows.n // block))
    queries = packed(vectors.where(is_query).dropDuplicates(["vec_id", "vector"]), rows.q, query_block)
    sent = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "dim",
                          F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("keys").alias("q_keys"))
    met = candidates.select("block", "dim", "ids", "matrix").join(sent.hint("shuffle_merge"), ["block", "dim"])
    found = met.mapInArrow(_search(k), "query_id long, query_hash long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(common.table(spark, sf_dir, "embeddings"))
    return search(vectors, F.pmod("vec_id", F.lit(50)) == 0, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
long AS (SELECT r, vec_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM long q JOIN long c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5
"""
