"""Sequence bias of read counts: covariates from prefix-count tiles, regression on counted cells, expected counts.

The sequence travels in tiles with a halo. In Python tiles become two arrays, letter codes and running G+C counts, so a window of any
length is two array reads and nothing is ever unfolded into a row per base. Training rows are
counted once by covariate cell; each step of a fit is one pass over the cells that sums normal equations of a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, StructField, StructType

from karyospark.session import materialise, spread

LETTERS = "GCT"
#: Inner knots of the GC spline, as shares of the GC range that the fit saw.
KNOTS = (0.2, 0.4, 0.6, 0.8)
TILE = 65536
_STEP_ROWS = 20_000
#: Bytes of sequence whose positions are worked out in one go.
_RUN_BYTES = 250_000


# --- sequence around positions -------------------------------------------------------------------

def sequence_tiles(chunks: DataFrame, tile: int, halo: int) -> DataFrame:
    """chrom, tile, lo, seq: sequence of each tile with `halo` more bases on both sides."""
    n = F.length("seq").cast("bigint")
    first = F.floor(F.greatest(F.col("offset") - halo, F.lit(0)) / tile)
    last = F.floor((F.col("offset") + n - 1 + halo) / tile)
    p = chunks.filter(n > 0).withColumn("tile", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("offset"), F.col("tile") * tile - halo)
    hi = F.least(F.col("offset") + n, (F.col("tile") + 1) * tile + halo)
    part = F.substring(F.col("seq"), (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    p = p.filter(hi > lo).select("chrom", "tile", F.struct(lo.alias("lo"), part.alias("s")).alias("p"))
    agg = p.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return agg.select("chrom", "tile", F.col("ps")[0]["lo"].alias("lo"),
                      F.array_join(F.transform("ps", lambda x: x["s"]), "").alias("seq"))


def _letter_table() -> np.ndarray:
    """1, 2, 3 for G, C, T in either case, 0 for every other byte; letters beyond ASCII count by their first byte."""
    table = np.zeros(256, np.int8)
    for k, letter in enumerate(LETTERS, 1):
        table[[ord(letter), ord(letter.lower())]] = k
    return table


def _codes(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of some sequences in one array, and where each of them starts (and the end)."""
    kind = "<i8" if pa.types.is_large_string(seqs.type) else "<i4"
    _, where, data = seqs.buffers()
    heads = np.frombuffer(where, kind, len(seqs) + 1, seqs.offset * np.dtype(kind).itemsize).astype(np.int64)
    text = np.frombuffer(data, np.uint8)[heads[0]:heads[-1]] if data is not None else np.zeros(0, np.uint8)
    codes, heads = np.take(_letter_table(), text), heads - heads[0]
    letter = text.view(np.int8) >= -64  # all but the bytes that continue a letter
    if letter.all():
        return codes, heads
    return codes[letter], np.concatenate(([0], np.cumsum(letter)))[heads]


def _running_gc(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.int32)
    np.cumsum((codes == 1) | (codes == 2), dtype=np.int32, out=out[1:])
    return out


def _some_tiles(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of a batch's tiles with their codes side by side: enough that calls cost little, few enough that arrays stay small."""
    size = np.cumsum(pc.binary_length(b.column("seq")).to_numpy())
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _RUN_BYTES, "right")))
        part = b.slice(at, end - at)
        yield part, *_codes(part.column("seq"))
        at = end


def _each_tile(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, np.ndarray]]:
    for part, codes, heads in _some_tiles(b):
        for r, (chrom, tile, lo) in enumerate(zip(*(part.column(c).to_pylist() for c in ("chrom", "tile", "lo")))):
            yield chrom, tile, lo, codes[heads[r]:heads[r + 1]]


def read_offsets(flank: int, read_length: int | None = None, whole_read: bool = False) -> list[int]:
    """Bases that count, from the read's start: around its first end, around both ends, or along the whole read."""
    if whole_read:
        return list(range(-flank, (read_length or 0) + flank))
    first = list(range(-flank, flank))
    return first if read_length is None else first + [k + read_length for k in first]


def window_halo(fragment: int, offsets: list[int]) -> int:
    """Bases on both sides of a position that its covariates look at."""
    return max(fragment, *(abs(k) for k in offsets), 0)


def covariates(positions: DataFrame, chunks: DataFrame, fragment: int, offsets: list[int], tile: int = TILE,
               tiles: DataFrame | None = None) -> DataFrame:
    """Positions with gc_count of the 2*fragment+1 bases around and `letters`, the codes at `offsets`.

    Positions whose window leaves the sequence are skipped. Tiles and positions come in one stream, each tile before its
    positions, so the sequence is sent once and no row carries it. `tiles` may be given where they are written already.
    """
    halo, fields = window_halo(fragment, offsets), positions.schema.names
    tiles = sequence_tiles(chunks, tile, halo) if tiles is None else tiles
    row = F.struct(*fields)
    asked = positions.filter(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).select(
        "chrom", F.floor(F.col("pos") / tile).alias("tile"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("string").alias("seq"),
        F.col("pos").cast("bigint").alias("_pos"), row.alias("_row"))
    held = tiles.filter(F.col("chrom").isNotNull()).select(
        "chrom", F.col("tile").cast("bigint").alias("tile"), "lo", "seq", F.lit(None).cast("bigint").alias("_pos"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    schema = StructType([*positions.schema.fields, StructField("gc_count", IntegerType()), StructField("letters", ArrayType(ByteType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, heads, lo = None, np.zeros(0, np.int8), np.zeros(1, np.int64), np.zeros(0, np.int64)
        for b in it:
            is_tile = pc.is_valid(b.column("lo")).to_numpy(zero_copy_only=False)
            fresh = b.filter(pa.array(is_tile))
            # The last tile so far may have positions in this batch too.
            new_codes, new_heads = _codes(fresh.column("seq")) if fresh.num_rows else (np.zeros(0, np.int8), np.zeros(1, np.int64))
            last = 1 if keys is not None else 0
            codes, heads = np.concatenate((codes, new_codes)), np.concatenate((heads[:last], new_heads + len(codes)))
            lo = np.concatenate((lo, fresh.column("lo").to_numpy()))
            names = pa.RecordBatch.from_arrays([fresh.column("chrom"), fresh.column("tile")], ["chrom", "tile"])
            names = pa.Table.from_batches([*([keys] if last else []), names]).combine_chunks()
            owner = np.cumsum(is_tile) - 1 + last
            rows = np.flatnonzero(~is_tile & (owner >= 0))
            if len(rows):
                mine, seqs = b.take(pa.array(rows)), pa.array(owner[rows])
                same = pc.and_(pc.equal(mine.column("chrom"), names.column("chrom").take(seqs)), pc.equal(mine.column("tile"), names.column("tile").take(seqs)))
                whose = owner[rows]
                at = mine.column("_pos").to_numpy() - lo[whose]
                ok = np.asarray(same) & (at >= halo) & (at + halo < heads[whose + 1] - heads[whose])
                if ok.any():
                    spot = (at + heads[whose])[ok]
                    running = _running_gc(codes)
                    letters = codes[spot[:, None] + np.array(offsets, np.int64)]
                    cuts = pa.array(np.arange(len(spot) + 1, dtype=np.int32) * len(offsets))
                    held_rows = mine.column("_row").filter(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([*held_rows.flatten(), pa.array(running[spot + fragment + 1] - running[spot - fragment]),
                                                      pa.ListArray.from_arrays(cuts, pa.array(letters.ravel()))], schema.names)
            if names.num_rows:
                keys = names.slice(names.num_rows - 1).to_batches()[0]
                codes, lo = codes[heads[-2]:], lo[-1:]
                heads = np.array([0, len(codes)])

    stream = held.unionByName(asked).repartition("chrom", "tile").sortWithinPartitions("chrom", "tile", F.col("lo").isNull())
    return stream.mapInArrow(run, schema)


def training_covariates(positions: DataFrame, chunks: DataFrame, fragment: int = 300, flank: int = 5, tile: int = TILE,
                        read_length: int | None = None, whole_read: bool = False) -> DataFrame:
    """GC share around each position and one-hot G, C, T at each offset, as columns G-5, C-5, T-5, G-4, …"""
    offsets = read_offsets(flank, read_length, whole_read)
    df = covariates(positions, chunks, fragment, offsets, tile)
    hot = {f"{letter}{k}": F.when(F.get("letters", F.lit(i)) == code, 1).otherwise(0)
           for i, k in enumerate(offsets) for code, letter in enumerate(LETTERS, 1)}
    return df.withColumn("gc", F.col("gc_count") / F.lit(float(2 * fragment + 1))).withColumns(hot).drop("gc_count", "letters")


def gc_window_tiles(chunks: DataFrame, half: int, tile: int = TILE) -> DataFrame:
    """chrom, first, counts: G+C in the 2*half+1 bases around the positions from `first` on that have a full window."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for chrom, number, lo, codes in _each_tile(b):
                a, z = max(lo + half, number * tile), min(lo + len(codes) - half, (number + 1) * tile)
                if z > a:
                    g, at = _running_gc(codes), np.arange(a - lo, z - lo)
                    yield pa.RecordBatch.from_pydict({"chrom": [chrom], "first": pa.array([a], pa.int64()),
                                                      "counts": pa.array([g[at + half + 1] - g[at - half]], pa.list_(pa.int32()))})
    return sequence_tiles(chunks, tile, half).mapInArrow(run, "chrom string, first bigint, counts array<int>")


def gc_window(chunks: DataFrame, half: int, tile: int = TILE) -> DataFrame:
    """The same with a row per position: chrom, pos, gc_count."""
    t = gc_window_tiles(chunks, half, tile).select("chrom", "first", F.posexplode("counts").alias("i", "gc_count"))
    return t.select("chrom", (F.col("first") + F.col("i")).alias("pos"), F.col("gc_count").cast("bigint").alias("gc_count"))


# --- regression on cells ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Spline:
    """Cubic spline of GC over the range that a fit saw; beyond it the curve stays at its ends."""

    low: float
    high: float
    knots: tuple[float, ...] = KNOTS

    @property
    def size(self) -> int:
        return 3 + len(self.knots)

    def basis(self, gc: np.ndarray) -> np.ndarray:
        t = np.clip((gc - self.low) / max(self.high - self.low, 1e-12), 0.0, 1.0)
        u = 2 * t - 1
        return np.stack([u, u * u, u**3, *(np.maximum(t - k, 0.0) ** 3 for k in self.knots)], 1)

    def column(self, gc: Column, coefficients: list[float]) -> Column:
        t = F.greatest(F.least((gc - self.low) / max(self.high - self.low, 1e-12), F.lit(1.0)), F.lit(0.0))
        u = 2 * t - 1
        parts = [u, u * u, u * u * u, *(F.pow(F.greatest(t - k, F.lit(0.0)), F.lit(3.0)) for k in self.knots)]
        out = F.lit(0.0)
        for c, p in zip(coefficients, parts, strict=True):
            out = out + F.lit(float(c)) * p
        return out


@dataclass(frozen=True)
class BiasModel:
    """log rate = intercept + spline(GC) + coefficient of the letter at each offset (+ refine curve of GC)."""

    fragment: int
    offsets: list[int]
    spline: Spline
    intercept: float
    gc: list[float]
    letters: np.ndarray  # offsets x 3
    theta: float = 10.0
    refine: tuple[Spline, float, list[float]] | None = None
    steps: int = field(default=0, compare=False)

    def gc_curve(self) -> np.ndarray:
        """The GC part of the log rate for each count of G+C in a window, refine curve included."""
        share = np.arange(2 * self.fragment + 2) / (2 * self.fragment + 1)
        out = self.intercept + self.spline.basis(share) @ np.array(self.gc)
        if self.refine:
            spline, intercept, coefficients = self.refine
            out = out + intercept + spline.basis(share) @ np.array(coefficients)
        return out

    def rate(self) -> Column:
        """Expected count of a row with `gc_count` and `letters`; the fitted numbers become literals of the plan."""
        share = F.col("gc_count") / F.lit(float(2 * self.fragment + 1))
        log_rate = F.lit(float(self.intercept)) + self.spline.column(share, self.gc)
        if self.refine:
            spline, intercept, coefficients = self.refine
            log_rate = log_rate + F.lit(float(intercept)) + spline.column(share, coefficients)
        for i in range(len(self.offsets)):
            table = F.array(F.lit(0.0), *(F.lit(float(c)) for c in self.letters[i]))
            log_rate = log_rate + F.get(table, F.get("letters", F.lit(i)).cast("int"))
        return F.exp(log_rate)


def _tallies() -> list[Column]:
    n = F.col("n").cast("double")
    return [F.count("*").alias("positions"), F.sum(n).alias("reads"), F.sum(n * n).alias("squares")]


def spots(positions: DataFrame) -> DataFrame:
    """A written table of the distinct (chrom, pos) with `positions`, the number of rows, `reads` and squared reads of them.

    Few rows are alike, so counting before the exchange would only fill memory, and left to itself the planner folds the small rows into few tasks.
    """
    return materialise(spread(positions.select("chrom", "pos", "n"), "chrom", "pos").groupBy("chrom", "pos").agg(*_tallies()), "spots")


def covariate_cells(rows: DataFrame) -> DataFrame:
    """A written table of the covariate cells (gc_count, letters): positions, reads and squared reads, of rows or of `spots`."""
    sums = [F.sum(c).alias(c) for c in ("positions", "reads", "squares")] if "squares" in rows.columns else _tallies()
    return materialise(rows.groupBy("gc_count", "letters").agg(*sums), "covariate-cells")


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """Element-wise sums of the arrays that `run` makes of each task's rows."""
    parts = df.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # `size` numbers, whatever the rows
        out[r["i"]] = r["x"]
    return out


def _array(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"sums": pa.array([values], pa.list_(pa.float64()))})


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Least-norm solution of scaled normal equations; directions that the data don't determine stay at zero."""
    d = 1 / np.sqrt(np.maximum(np.diag(h), 1e-300))
    d[np.diag(h) <= 0] = 0.0
    value, vector = np.linalg.eigh(h * d[:, None] * d)
    keep = value > 1e-13 * max(value[-1], 1e-300)
    return d * (vector[:, keep] @ ((vector[:, keep].T @ (d * g)) / value[keep]))


def design(spline: Spline, fragment: int, gc_count: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Columns: one, GC spline, then G, C, T of each offset."""
    hot = [letters[:, [i]] == np.arange(1, 4) for i in range(letters.shape[1])]
    return np.concatenate([np.ones((len(gc_count), 1)), spline.basis(gc_count / (2 * fragment + 1)), *hot], 1)


def fit_bias(cells: DataFrame, fragment: int, offsets: list[int], knots: tuple[float, ...] = KNOTS, negative_binomial: bool = False,
             rounds: int = 4, steps: int = 40) -> BiasModel:
    """Poisson regression of the reads of covariate cells by Newton steps, each one pass over the cells.

    The negative-binomial form solves its score equations by the Poisson fit with weights 1 / (1 + rate / theta) of the
    round before. Without reads the rate is zero.
    """
    edge = cells.agg(F.min("gc_count").alias("a"), F.max("gc_count").alias("z"), F.sum("reads").alias("n"), F.sum("positions").alias("m")).first()
    width, k = 2 * fragment + 1, len(offsets)
    if not edge.m or not edge.n:
        return BiasModel(fragment, offsets, Spline(0.0, 1.0, knots), -math.inf, [0.0] * (3 + len(knots)), np.zeros((k, 3)))
    spline = Spline(edge.a / width, edge.z / width, knots)
    p = 1 + spline.size + 3 * k

    def sums(beta: np.ndarray, weighting: tuple[np.ndarray, float] | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood, score, information, and what the dispersion needs."""
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p * p + p + 6)
            for whole in it:
                for at in range(0, whole.num_rows, _STEP_ROWS):
                    b = whole.slice(at, _STEP_ROWS)
                    letters = b.column("letters").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
                    x = design(spline, fragment, b.column("gc_count").to_numpy(), letters)
                    m, n, n2 = (b.column(c).to_numpy().astype(float) for c in ("positions", "reads", "squares"))
                    eta = np.clip(x @ beta, -500, 50)
                    mu = np.exp(eta)
                    w = 1 / (1 + np.exp(np.clip(x @ weighting[0], -500, 50)) / weighting[1]) if weighting else np.ones(len(m))
                    total[p * p:p * p + p] += x.T @ (w * (n - m * mu))
                    x *= np.sqrt(w * m * mu)[:, None]
                    total[:p * p] += (x.T @ x).ravel()
                    total[-6:] += [(w * (n * eta - m * mu)).sum(), m.sum(), (n / mu).sum(), (n2 / mu**2).sum(), (m * mu).sum(), (m * mu * mu).sum()]
            yield _array(total)
        s = _summed(cells, run, p * p + p + 6)
        return s[-6], s[p * p:p * p + p], s[:p * p].reshape(p, p), s[-5:]

    taken = 0

    def newton(beta: np.ndarray, weighting) -> tuple[np.ndarray, np.ndarray]:
        nonlocal taken
        best, step, old = -math.inf, np.zeros(p), beta
        for _ in range(steps):
            taken += 1
            likelihood, g, h, rest = sums(beta, weighting)
            if not likelihood >= best - 1e-9 * abs(best) and np.abs(step).max() > 1e-12:
                step = step / 2
                beta = old + step
                continue
            scaled = np.abs(g) / np.sqrt(np.maximum(np.diag(h), 1e-300))
            if scaled[np.diag(h) > 0].max() < 1e-9 * math.sqrt(edge.n):
                break
            best, old, step = likelihood, beta, _solve(h, g)
            beta = old + step
        return beta, rest

    def dispersion(rest: np.ndarray) -> float:
        m, ratio, ratio2, rate, rate2 = rest
        variance = (ratio2 - ratio * ratio / m) / max(m - 1, 1)
        return 1.0 / max((variance * rate2 / m - rate / m) / (rate / m) ** 2, 0.1)

    beta = np.zeros(p)
    beta[0] = math.log(edge.n / edge.m)
    beta, rest = newton(beta, None)
    theta = dispersion(rest)
    for _ in range(rounds if negative_binomial else 0):
        beta, rest = newton(beta, (beta, theta))
        theta = dispersion(rest)
    q = 1 + spline.size
    return BiasModel(fragment, offsets, spline, float(beta[0]), beta[1:q].tolist(), beta[q:].reshape(k, 3), theta, None, taken)


def fit_refine_curve(bins: DataFrame, knots: tuple[float, ...] = KNOTS) -> tuple[Spline, float, list[float]]:
    """Least-squares GC spline of `log_ratio` over `gc`, from one sum of normal equations."""
    rows = bins.select("gc", "log_ratio").where("gc IS NOT NULL AND log_ratio IS NOT NULL")
    edge = rows.agg(F.min("gc").alias("a"), F.max("gc").alias("z")).first()
    if edge.a is None:
        return Spline(0.0, 1.0, knots), 0.0, [0.0] * (3 + len(knots))
    spline = Spline(float(edge.a), float(edge.z), knots)
    p = 1 + spline.size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p * p + p)
        for b in it:
            x = np.concatenate([np.ones((b.num_rows, 1)), spline.basis(b.column("gc").to_numpy())], 1)
            total[:p * p] += (x.T @ x).ravel()
            total[p * p:] += x.T @ b.column("log_ratio").to_numpy()
        yield _array(total)

    s = _summed(rows, run, p * p + p)
    beta = _solve(s[:p * p].reshape(p, p), s[p * p:])
    return spline, float(beta[0]), beta[1:].tolist()


# --- expected counts ------------------------------------------------------------------------------------

def _word_tables(offsets: list[int], letters: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(first offset, length, table): sums of the coefficients of up to five bases side by side, by their codes as one number."""
    out, at = [], 0
    while at < len(offsets):
        end = at + 1
        while end < len(offsets) and end - at < 5 and offsets[end] == offsets[end - 1] + 1:
            end += 1
        word = np.arange(4 ** (end - at))
        table = sum(np.concatenate(([0.0], letters[i]))[(word >> 2 * (i - at)) & 3] for i in range(at, end))
        out.append((offsets[at], end - at, table))
        at = end
    return out


def _words(codes: np.ndarray, length: int) -> np.ndarray:
    """The codes of `length` bases from each base on as one number; the last bases have none."""
    out = codes[:len(codes) - length + 1].astype(np.int16)
    for j in range(1, length):
        out |= codes[j:len(codes) - length + 1 + j].astype(np.int16) << 2 * j
    return out


def bin_rates(chunks: DataFrame, model: BiasModel, bin_size: int, tile: int = TILE, tiles: DataFrame | None = None) -> DataFrame:
    """chrom, bin, positions, expected, var, gc: over all positions whose window lies in the sequence.

    Tiles work out their own positions as arrays, many short tiles at once, and give one row per bin; var is the negative-binomial
    variance, gc the mean share. `tiles` may be given where they are written already.
    """
    halo, f = window_halo(model.fragment, model.offsets), model.fragment
    curve, words = model.gc_curve(), _word_tables(model.offsets, model.letters)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, codes, heads in _some_tiles(b):
                lo, number = part.column("lo").to_numpy(), part.column("tile").to_numpy()
                first, last = np.maximum(lo + halo, number * tile), np.minimum(lo + np.diff(heads) - halo, (number + 1) * tile)
                has = np.flatnonzero(last > first)
                if not len(has):
                    continue
                # Every base is judged, also those next to a seam between two tiles, which belong to no bin; one more ends the last bin.
                n = len(codes) - 2 * halo
                g, count, rate, term = _running_gc(codes), np.zeros(n + 1, np.int32), np.zeros(n + 1), np.empty(n + 1)
                np.subtract(g[halo + f + 1:halo + f + 1 + n], g[halo - f:halo - f + n], out=count[:n])
                np.take(curve, count[:n], out=rate[:n], mode="clip")
                cached = {length: _words(codes, length) for length in {length for _, length, _ in words}}
                for offset, length, table in words:
                    rate[:n] += np.take(table, cached[length][halo + offset:halo + offset + n], out=term[:n], mode="clip")
                np.exp(rate[:n], out=rate[:n])
                number_of = (last[has] - 1) // bin_size - first[has] // bin_size + 1
                t = np.repeat(has, number_of)
                bins = first[t] // bin_size + np.arange(len(t)) - np.repeat(np.cumsum(number_of) - number_of, number_of)
                a, z = np.maximum(bins * bin_size, first[t]), np.minimum((bins + 1) * bin_size, last[t])
                edges = (np.stack([a, z], 1) + (heads[t] - lo[t] - halo)[:, None]).ravel()
                expected, share = np.add.reduceat(rate, edges)[::2], np.add.reduceat(count, edges, dtype=np.int64)[::2] / (2 * f + 1)
                squares = np.add.reduceat(np.multiply(rate, rate, out=term), edges)[::2]
                yield pa.RecordBatch.from_pydict({"chrom": part.column("chrom").take(pa.array(t)), "bin": pa.array(bins, pa.int64()), "positions": pa.array(z - a),
                                                  "expected": expected, "var": expected + squares / model.theta, "gc": share})

    tiles = sequence_tiles(chunks, tile, halo) if tiles is None else tiles
    parts = tiles.mapInArrow(run, "chrom string, bin bigint, positions bigint, expected double, var double, gc double")
    return parts.groupBy("chrom", "bin").agg(F.sum("positions").alias("positions"), F.sum("expected").alias("expected"), F.sum("var").alias("var"),
                                             (F.sum("gc") / F.sum("positions")).alias("gc"))


def observed_bins(expected: DataFrame, positions: DataFrame, bin_size: int) -> DataFrame:
    """The bins of `expected` with `obs`, the reads of `positions` (chrom, pos, n); 0 where there are none."""
    obs = positions.groupBy("chrom", F.floor(F.col("pos") / bin_size).alias("bin")).agg(F.sum("n").cast("double").alias("obs"))
    return expected.join(obs, ["chrom", "bin"], "left").withColumn("obs", F.coalesce("obs", F.lit(0.0)))
