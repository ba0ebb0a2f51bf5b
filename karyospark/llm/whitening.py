"""Embedding whitening by Chebyshev-filtered subspace iteration; the matrix is only ever touched by distributed passes.

1. Every vector becomes integers, floor(scale * entry). `distinct_blocks` keeps each distinct vector once and packs
   them into blocks of a few thousand, written to the shared folder.
2. `moments` sums the blocks exactly. A centred entry is the integer part (entry less the floor of the mean) less the
   mean's fraction, so nothing is lost to cancellation however large the common offset.
3. `product` is one pass: every task sums Xᵀ(XQ) of its blocks for a thin matrix Q, partial sums of many tasks are
   added in groups, and the driver gets a bounded number of thin matrices. Neither X nor XᵀX is ever formed.
4. `fit`: a few Lanczos steps bound the spectrum from below. Then a block of vectors is filtered by the Chebyshev recurrence (one pass
   a degree) that damps all eigenvalues below the block's least Ritz value, orthonormalised by QR and rotated by
   Rayleigh-Ritz (Zhou, Saad et al., "Self-consistent-field calculations using Chebyshev-filtered subspace iteration",
   2006). The degree is held back where the leading eigenvalue would drown the others. It ends when the residuals
   certify the leading components: under 1e-14 of the largest eigenvalue, or no longer falling and under 1e-10 (rounding level); else it raises.
5. `whiten` projects every row that takes part, repeated ones too.

Defined results: vectors that are null, hold null or non-finite entries, or entries over 7e16 (no exact long) take no
part, nor do empty ones and those whose length is not the commonest (ties: the longer). A row without an id keeps its
null id. Equal vectors get equal results. Directions without variance (under 1e-12 of the trace) are no components, so few or
equal vectors give fewer or no rows; an empty table gives none. Equal eigenvalues: any basis, the same for all rows. A
deviation beyond a long is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common

SCALE, COMPONENTS = 64, 16
#: Rows of a block; groups of partial sums that reach the driver; steps of the spectrum's bound; largest filter degree; iterations.
BLOCK_ROWS, FAN, LANCZOS, DEGREE, ROUNDS = 4096, 64, 12, 10, 60
_BLOCK = "rows long, width int, matrix binary"


@dataclass(frozen=True)
class Moments:
    """Of the distinct vectors: how many, and per dimension the floor of the mean and the rest of the sum above it."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest / self.n


@dataclass(frozen=True)
class Whitening:
    """A fitted model: unit eigenvectors as columns, their eigenvalues, and the proof of the fit."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def usable(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, vector: array<double>, of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= 7e16), F.lit(False)))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(good)
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (length.d if length else 0))


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat).astype(np.int64).reshape(len(column), -1)


def _keys(scale: int):
    """Each vector as bytes of its integers, 2 or 8 each: equal vectors have equal bytes."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = _integers(b.column("vector"), scale)
            narrow = (x.min(1, initial=0) >= -32768) & (x.max(1, initial=0) < 32768)
            keys = [row.astype("<i2").tobytes() if n else row.astype("<i8").tobytes() for row, n in zip(x, narrow.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([common.binary(keys), pa.array(np.where(narrow, 2, 8), pa.int32())], ["x", "width"])
    return run


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        keys, widths = b.column("x").to_pylist(), b.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            own = [keys[k] for k in np.flatnonzero(widths == width)]
            parts = [own[at:at + BLOCK_ROWS] for at in range(0, len(own), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int64()), pa.array([width] * len(parts), pa.int32()),
                                              common.binary([b"".join(p) for p in parts])], ["rows", "width", "matrix"])


def distinct_blocks(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """A written table of packed blocks that hold each distinct integer vector once."""
    keys = vectors.select("vector").mapInArrow(_keys(scale), "x binary, width int")
    return common.written(keys.distinct().mapInArrow(_pack, _BLOCK), "whitening-blocks")


def _matrices(it: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in it:
        for width, matrix in zip(b.column("width").to_pylist(), b.column("matrix").to_pylist(), strict=True):
            yield np.frombuffer(matrix, f"<i{width}").reshape(-1, d).astype(np.int64)


def moments(blocks: DataFrame, d: int) -> Moments | None:
    """Exact sums: entries are added as their upper and lower 32 bits, which cannot overflow."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _matrices(it, d):
            n, upper, lower = n + len(x), upper + (x >> 32).sum(0), lower + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(upper), pa.array(lower)],
                                         ["dim", "n", "upper", "lower"])

    sums = blocks.mapInArrow(run, "dim int, n long, upper long, lower long").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "upper", "lower")))
    by = {r.dim: r for r in sums.collect()}  # a row per dimension
    if not by or not by[0].n:
        return None
    n, total = by[0].n, [(by[k].upper << 32) + by[k].lower for k in range(d)]
    return Moments(n, np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64))


def _added(group: pa.Table) -> pa.Table:
    order = np.argsort(group.column("part").to_numpy())
    sums = [np.frombuffer(group.column("sums")[int(k)].as_py()) for k in order]
    return pa.table({"part": pa.array([group.column("part")[0].as_py() % FAN], pa.int64()), "sums": common.binary([np.sum(sums, 0).tobytes()])})


def product(blocks: DataFrame, m: Moments, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V q, trace of V) for the covariance V of the blocks' vectors: one distributed pass."""
    d, k = q.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, trace, ctx = np.zeros((d, k)), 0.0, TaskContext.get()
        for x in _matrices(it, d):
            c = m.centred(x)
            sums += c.T @ (c @ q)
            trace += float((c * c).sum())
        both = np.append(sums.ravel(), trace)
        yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId() if ctx else 0], pa.int64()), common.binary([both.tobytes()])], ["part", "sums"])

    sums = blocks.mapInArrow(run, "part long, sums binary")
    if blocks.rdd.getNumPartitions() > FAN:
        sums = sums.groupBy(F.pmod("part", F.lit(FAN))).applyInArrow(_added, "part long, sums binary")
    rows = sorted(sums.collect(), key=lambda r: r.part)  # at most FAN thin matrices
    both = np.sum([np.frombuffer(r.sums) for r in rows], 0) / m.n
    return both[:-1].reshape(d, k), float(both[-1])


def _lower_bound(times, d: int, steps: int, rng: np.random.Generator) -> float:
    """A value the spectrum is not far below: the least Ritz value of some Lanczos steps less its residual."""
    q, basis, alpha, beta = rng.standard_normal(d), [], [], []
    for _ in range(min(steps, d)):
        basis.append(q / np.linalg.norm(q))
        q = times(basis[-1][:, None])[:, 0]
        alpha.append(float(q @ basis[-1]))
        for _ in range(2):
            q = q - np.array(basis).T @ (np.array(basis) @ q)
        beta.append(float(np.linalg.norm(q)))
        if beta[-1] <= 1e-12 * max(map(abs, alpha)):
            break
    value, vector = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(value[0] - beta[-1] * abs(vector[-1, 0])))


def _filtered(times, q: np.ndarray, vq: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on q that is small over [low, high] and one at ``top``; vq = V q is known."""
    half, centre = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * after / half * (times(now) - centre * now) - sigma * after * before
        sigma = after
    return now


def fit(blocks: DataFrame, d: int, components: int = COMPONENTS, guard: int | None = None, seed: int = 7) -> Whitening | None:
    """The leading components; ``guard`` further vectors make the block wider (default: as many again). None without vectors."""
    m = moments(blocks, d)
    if m is None:
        return None
    rng, passes, trace, k = np.random.default_rng(seed), 0, 0.0, min(components, d)

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes, trace
        passes += 1
        y, trace = product(blocks, m, q)
        return y

    width = min(d, k + (k if guard is None else guard))
    low = _lower_bound(times, d, LANCZOS, rng) if width < d else 0.0
    q, best = rng.standard_normal((d, width)), np.inf
    for _ in range(ROUNDS):
        q = np.linalg.qr(q)[0]
        vq = times(q)
        h = q.T @ vq
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        scale = max(float(value[0]), 0.0)
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * value[:k], axis=0).max())
        if width == d or residual <= 1e-14 * scale or residual <= 1e-10 * scale and residual > best / 2:
            break
        best, high = min(best, residual), float(value[-1])
        low = min(low, 0.98 * high)
        reach = (2 * scale - high - low) / (high - low) if high > low else np.inf
        # the leading direction may outgrow the last one by 1e8 in a round, else rounding drowns that one
        degree = max(1, min(DEGREE, int(18.4 / np.log(reach + np.sqrt(reach * reach - 1))))) if np.isfinite(reach) and reach > 1 else 1
        q = _filtered(times, q, vq, degree, low, high, scale) if np.isfinite(reach) and reach > 1 else vq + 1e-30
    else:
        raise RuntimeError(f"no certificate after {ROUNDS} rounds: residual {residual:.2e} of {scale:.2e}")
    real = min(k, int((value > 1e-12 * trace).sum())) if trace > 0 else 0
    vectors, values = q[:, :real], value[:real]
    error = 0.0
    if real:
        scaled = vectors / np.sqrt(values)
        error = float(np.abs(scaled.T @ times(scaled) - np.eye(real)).max())
    return Whitening(m, vectors, values, trace, residual, error, passes)


def _deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sums of (n * entry - sum)^2, exact; null beyond a long."""
    shifted = x - m.base
    reach = m.n * (int(np.abs(shifted).max(initial=0)) + 1)
    if reach * reach * x.shape[1] < 1 << 63:
        z = shifted * m.n - m.rest
        return (z * z).sum(1).tolist()
    rest = m.rest.tolist()
    exact = (sum((v * m.n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in shifted.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening, scale: int = SCALE) -> DataFrame:
    """vec_id, deviation, whitened: array<double> with one entry per component, of every row."""
    project = model.vectors / np.sqrt(model.values)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it, 4096):
            x = _integers(b.column("vector"), scale)
            w = model.moments.centred(x) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(_deviations(x, model.moments), pa.int64()), lists],
                                             ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def train(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, guard: int | None = None) -> Whitening | None:
    first = vectors.select(F.size("vector").alias("d")).first()
    return fit(distinct_blocks(vectors, scale), first.d, components, guard) if first else None


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(common.table(spark, sf_dir, "embeddings"))
    model = train(vectors)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if model is None or not len(model.values):
        return vectors.where("false").selectExpr("vec_id", "1 as component", "0L as n", "0L as deviation", "0D as whitened", "0D as explained", "0D as identity_error")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    return rows.withColumns({"component": F.col("at") + 1, "n": F.lit(model.moments.n).cast("long"), "explained": F.get(explained, F.col("at")),
                             "identity_error": F.lit(model.identity_error)}).select(*names)
