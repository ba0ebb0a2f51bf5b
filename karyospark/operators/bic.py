"""Read-position statistics, bias models and segment statistics of the BIC track.

Everything at position level is keyed or blocked by genome stretch, so no chromosome is one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from karyospark.operators.intervals import positions_outside, track_overlap_sum
from karyospark.operators.quantiles import exact_quantiles
from karyospark.operators.running import BLOCK, carry_forward, running_totals
from karyospark.session import spread

EPS = 1e-10


# --- positions -------------------------------------------------------------------------------

def position_counts(reads: DataFrame) -> DataFrame:
    """Reads per start position."""
    return reads.groupBy("sample", "chrom", "pos").agg(F.count("*").alias("n"))


def disjoint_pieces(intervals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Union of half-open intervals as disjoint pieces, cut at block edges.

    Cutting first makes each (keys, block) independent of the rest of the chromosome.
    """
    b = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))
    cut = (intervals.filter("end > start").select(*keys, "start", "end", b.alias("_b"))
           .select(*keys, "_b", F.greatest("start", F.col("_b") * block).alias("start"),
                   F.least("end", (F.col("_b") + 1) * block).alias("end"))
           .groupBy(*keys, "_b", "start").agg(F.max("end").alias("end")))
    w = Window.partitionBy(*keys, "_b").orderBy("start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = cut.withColumn("_new", F.when(F.coalesce(F.col("start") > before, F.lit(True)), 1).otherwise(0))
    df = df.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_b", "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_id")


def ranked_pieces(intervals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Disjoint pieces with `before`: how many covered positions precede each piece."""
    p = disjoint_pieces(intervals, keys, block).withColumn("len", F.col("end") - F.col("start"))
    return carry_forward(p, keys, "_b", ["start"], ["len"]).select(
        *keys, "_b", "start", "end", (F.col("run_len") - F.col("len")).alias("before"))


def position_rank(counts: DataFrame, pieces: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Counts on covered positions with the rank of the position among all covered ones."""
    c = counts.withColumn("_b", F.floor(F.col("pos") / block))
    s = pieces.select(*keys, "_b", F.col("start").alias("_x"), F.struct("start", "end", "before").alias("_p"))
    p = c.select(*keys, "_b", F.col("pos").alias("_x")).distinct()
    both = s.withColumn("_k", F.lit(0)).unionByName(
        p.withColumn("_p", F.lit(None).cast(s.schema["_p"].dataType)).withColumn("_k", F.lit(1)))
    w = Window.partitionBy(*keys, "_b").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    at = (both.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).filter("_k = 1 AND _x < _p.end")
          .select(*keys, F.col("_x").alias("pos"), (F.col("_p.before") + F.col("_x") - F.col("_p.start")).alias("rank")))
    return counts.join(at, [*keys, "pos"])


def mappable_totals(counts: DataFrame, mappable: DataFrame) -> DataFrame:
    """Per sample and chromosome: reads on mappable positions, mappable positions, adaptive bin size."""
    size = disjoint_pieces(mappable, ["chrom"]).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("positions"))
    outside = positions_outside(counts, mappable.withColumn("end", F.col("end") - 1), ["chrom"])
    inside = counts.groupBy("sample", "chrom").agg(F.sum("n").alias("all_n")).join(
        outside.groupBy("sample", "chrom").agg(F.sum("n").alias("out_n")), ["sample", "chrom"], "left")
    df = inside.withColumn("reads", F.col("all_n") - F.coalesce("out_n", F.lit(0))).join(size, "chrom")
    return df.select("sample", "chrom", "reads", "positions")


def adaptive_bin_size(totals: DataFrame, by: list[str]) -> DataFrame:
    """max(1000, ceil(1000 / reads per mappable position))."""
    agg = totals.groupBy(*by).agg(F.sum("reads").alias("reads"), F.sum("positions").alias("positions"))
    size = F.ceil(F.lit(1000.0) * F.col("positions") / F.col("reads"))
    return agg.withColumn("bin_size", F.when(F.col("reads") > 0, F.greatest(F.lit(1000).cast("bigint"), size)))


def equal_mappability_bins(pieces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Bins of `width` consecutive covered positions; the last one takes the remainder."""
    n = F.col("end") - F.col("start")
    total = pieces.groupBy(*keys).agg(F.sum(n).alias("_n"))
    last = F.greatest(F.floor(F.col("_n") / width) - 1, F.lit(0).cast("bigint"))
    df = pieces.join(total, keys).withColumn("_last", last)
    k = F.explode(F.sequence(F.least(F.floor(F.col("before") / width), F.col("_last")),
                             F.least(F.floor((F.col("before") + n - 1) / width), F.col("_last"))))
    df = df.withColumn("bin", k)
    lo = F.greatest(F.col("before"), F.col("bin") * width)
    hi = F.least(F.col("before") + n, F.when(F.col("bin") == F.col("_last"), F.col("_n")).otherwise((F.col("bin") + 1) * width))
    shift = F.col("start") - F.col("before")
    return df.groupBy(*keys, "bin").agg(F.min(lo + shift).alias("start"), F.max(hi + shift - 1).alias("end"),
                                        F.sum(hi - lo).alias("positions"))


def fixed_bins(counts: DataFrame, width: int) -> DataFrame:
    """Bin of a 1-based position: floor((pos-1)/width)."""
    return counts.withColumn("bin", F.floor((F.col("pos") - 1) / width))


def bin_expectation(positions: DataFrame, by: list[str], theta: float) -> DataFrame:
    """Observed count, expected count and negative-binomial variance per bin."""
    m = F.col("rate")
    return positions.groupBy(*by).agg(F.sum("n").alias("obs"), F.sum(m).alias("expected"),
                                      F.sum(m + m * m / theta).alias("var"))


def sliding_quantile(values: np.ndarray, first: np.ndarray, last: np.ndarray, q: float) -> np.ndarray:
    """The ceil(q * size)-th smallest of values[first:last] for many windows at once.

    A wavelet matrix: the levels of the values are split bit by bit, and each window follows the half that holds its
    wanted rank by counting zeros before its ends. No window is ever listed or sorted.
    """
    levels, code = np.unique(values, return_inverse=True)
    a, z = first.copy(), last.copy()
    k = np.ceil((last - first) * q).astype(np.int64) - 1
    found = np.zeros(len(first), np.int64)
    for bit in reversed(range(max(1, int(len(levels) - 1).bit_length()))):
        one = (code >> bit) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        za, zz = zeros[a], zeros[z]
        low = k < zz - za
        found |= np.where(low, 0, 1 << bit)
        k = np.where(low, k, k - (zz - za))
        a, z = np.where(low, za, zeros[-1] + a - za), np.where(low, zz, zeros[-1] + z - zz)
        code = np.concatenate((code[~one], code[one]))
    return levels[found]


def cap_outliers(counts: DataFrame, window: int = 200, q: float = 0.95, multiple: float = 5.0,
                 block: int = 100_000) -> DataFrame:
    """Cap each count at `multiple` times the q-quantile of the `window` covered positions around it.

    Positions get their rank by block-wise counting; each block of ranks carries a halo of one
    window on both sides, so blocks are independent and bounded. Near chromosome ends the first or last full
    window is used; a chromosome too short for one uses what each window reaches.
    """
    keys = ["sample", "chrom"]
    left = (window - 1) // 2
    df = carry_forward(counts.select(*keys, "pos", F.col("n").cast("bigint").alias("n"), F.lit(1).alias("_one"),
                                     F.floor(F.col("pos") / BLOCK).alias("_g")), keys, "_g", ["pos"], ["_one"])
    size = counts.groupBy(*keys).agg(F.count("*").alias("_size"))
    df = df.select(*keys, "pos", "n", (F.col("run__one") - 1).alias("rank")).join(size, keys)
    copies = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor((F.col("rank") + window) / block))
    df = df.withColumn("_b", F.explode(copies))

    def capped(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        rank, n = (group.column(c).to_numpy() for c in ("rank", "n"))
        size, number = group.column("_size")[0].as_py(), group.column("_b")[0].as_py()
        home = np.flatnonzero(rank // block == number)
        centre = np.clip(rank[home], left, max(size - (window - left), left))
        centre = np.where(centre < size, centre, rank[home])
        first = np.maximum(centre - left, 0) - rank[0]
        last = np.minimum(centre - left + window, size) - rank[0]
        limit = (sliding_quantile(n, first, last, q) * multiple).astype(np.int64)
        out = group.select([*keys, "pos"]).take(pa.array(home))
        return out.append_column("n", pa.array(np.minimum(n[home], limit)))

    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, "pos"]), "n bigint"])
    return df.groupBy(*keys, "_b").applyInArrow(capped, schema)


def mappable_runs(counts: DataFrame, pieces: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, start, end, n: every covered position as a run of one with its count, the empty stretches between as runs with 0.

    `pieces` are those of `disjoint_pieces`, `counts` has one row per (keys, pos). The runs tile the pieces; one sweep of piece starts and positions
    inside a block makes them, so an empty position is never a row.
    """
    c = counts.select(*keys, F.floor(F.col("pos") / block).alias("_b"), F.col("pos").alias("_x"), F.col("n").cast("bigint").alias("n"))
    s = pieces.select(*keys, "_b", F.col("start").alias("_x"), F.lit(None).cast("bigint").alias("n"), F.col("end").alias("_end"))
    w = Window.partitionBy(*keys, "_b").orderBy("_x", F.col("n").isNotNull())
    sweep = s.unionByName(c.withColumn("_end", F.lit(None).cast("bigint")))
    sweep = sweep.withColumn("_end", F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sweep = sweep.withColumn("_next", F.least(F.coalesce(F.lead("_x").over(w), F.col("_end")), F.col("_end"))).where("_x < _end")
    after = F.col("_x") + F.when(F.col("n").isNull(), 0).otherwise(1)
    run = F.filter(F.array(F.struct(F.col("_x").alias("start"), after.alias("end"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")),
                           F.struct(after.alias("start"), F.col("_next").alias("end"), F.lit(0).cast("bigint").alias("n"))),
                   lambda r: r["end"] > r["start"])
    return sweep.select(*keys, F.explode(run).alias("r")).select(*keys, "r.start", "r.end", "r.n")


def far_from_gaps(positions: DataFrame, gaps: DataFrame, distance: int = 1_000_000) -> DataFrame:
    """Positions farther than `distance` from every gap of their chromosome."""
    padded = gaps.select("chrom", (F.col("start") - distance).alias("start"), (F.col("end") + distance).alias("end"))
    return positions_outside(positions, padded, ["chrom"])


def gap_distance(points: DataFrame, gaps: DataFrame, block: int = 1 << 24) -> DataFrame:
    """Distance in kb to the nearest gap, 0 inside one, NULL without gaps.

    Last end before and first start after a position come from block-wise running extremes.
    """
    x = F.explode(F.array(F.struct(F.col("start").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("c")),
                          F.struct(F.col("end").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("c"))))
    ev = gaps.select("chrom", x.alias("e")).select("chrom", "e.*").unionByName(
        points.select("chrom", F.col("pos").alias("x"), F.lit(0).alias("o"), F.lit(0).alias("c")))
    run = running_totals(ev, ["chrom"], "x", ["o", "c"], block)
    run = run.withColumn("_b", F.floor(F.col("x") / block))
    run = run.withColumn("_end", F.when(F.col("c") > 0, F.col("x"))).withColumn("_start", F.when(F.col("o") > 0, F.col("x")))
    per = run.groupBy("chrom", "_b").agg(F.max("_end").alias("_e"), F.min("_start").alias("_s"))
    wb = Window.partitionBy("chrom").orderBy("_b")
    per = per.select("chrom", "_b", F.max("_e").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_pe"),
                     F.min("_s").over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_ns"))
    # Both extremes run from the first row of their order: a frame that shrinks to the end is summed anew for every row.
    w = Window.partitionBy("chrom", "_b").rowsBetween(Window.unboundedPreceding, 0)
    run = (run.withColumn("_le", F.max("_end").over(w.orderBy("x")))
           .withColumn("_fs", F.min("_start").over(w.orderBy(F.desc("x")))).join(per, ["chrom", "_b"]))
    before = F.col("x") - F.coalesce("_le", "_pe")
    after = F.coalesce("_fs", "_ns") - F.col("x")
    # Between a start and its end every position is inside; run_c counts ends at or before x.
    inside = F.col("run_o") - F.col("run_c") > 0
    d = F.when(inside, F.lit(0)).otherwise(F.least(before, after)) / F.lit(1000.0)
    return points.join(run.select("chrom", F.col("x").alias("pos"), d.alias("distance_kb")), ["chrom", "pos"])


def combine_aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two files side by side; `aligned` is false where one of them lacks the bin."""
    left, right = a.withColumnRenamed(value, f"{value}_a"), b.withColumnRenamed(value, f"{value}_b")
    return left.join(right, keys, "full").withColumn(
        "aligned", F.col(f"{value}_a").isNotNull() & F.col(f"{value}_b").isNotNull())


def require_aligned(combined: DataFrame) -> DataFrame:
    """The combined rows, failing on the first bin that is not in both files."""
    ok = F.when(F.col("aligned"), True).otherwise(F.raise_error(F.lit("bins are not aligned")).cast("boolean"))
    return combined.filter(ok)


def hash_sample(df: DataFrame, number: Column, share: float, seed: int = 0) -> DataFrame:
    """Repeatable Bernoulli sample on a whole-number key."""
    return df.filter(F.pmod(number * 7919 + F.lit(seed) * 104729, F.lit(1_000_003)) < int(share * 1_000_003))


# --- bias models ------------------------------------------------------------------------------

def hinge_columns(gc: Column, knots: list[float]) -> dict[str, Column]:
    """Cubic regression-spline basis of GC as plain columns."""
    out = {"gc1": gc, "gc2": gc * gc, "gc3": gc * gc * gc}
    for i, k in enumerate(knots):
        h = F.greatest(gc - k, F.lit(0.0))
        out[f"gck{i}"] = h * h * h
    return out


KNOTS = [0.3, 0.4, 0.5, 0.6, 0.7]


def rate_from_terms(intercept: float, terms: dict[str, float]) -> Column:
    lin = F.lit(intercept)
    for name, c in terms.items():
        lin = lin + F.col(name) * F.lit(c)
    return F.exp(lin)


def ratio_outlier_cut(bins: DataFrame, by: list[str]) -> DataFrame:
    """Bins with reads whose log(obs/expected) lies within 2 interquartile ranges of the quartiles."""
    df = bins.filter("obs > 0").withColumn("log_ratio", F.log(F.col("obs") / F.col("expected") + F.lit(EPS)))
    q = exact_quantiles(df, by, "log_ratio", [0.25, 0.75]).select(*by, "q")
    span = 2 * (F.col("q")[1] - F.col("q")[0])
    return df.join(q, by).filter(F.col("log_ratio").between(F.col("q")[0] - span, F.col("q")[1] + span)).drop("q")


def neutral_bins(bins: DataFrame, by: list[str], enough: float = 0.2) -> DataFrame:
    """Bins of copy number 2 where 2 is the commonest or frequent enough, all bins elsewhere."""
    per = bins.groupBy(*by, "copy_number").agg(F.count("*").alias("k")).groupBy(*by).agg(
        F.max_by("copy_number", F.struct("k", -F.col("copy_number"))).alias("_ploidy"),
        (F.sum(F.when(F.col("copy_number") == 2, F.col("k"))) / F.sum("k")).alias("_two"))
    usable = (F.col("_ploidy") == 2) | (F.coalesce("_two", F.lit(0.0)) > enough)
    return bins.join(per, by).filter(~usable | (F.col("copy_number") == 2)).drop("_ploidy", "_two")


def fit_refine(bins: DataFrame, knots: list[float] = KNOTS, polynomial: bool = False, level: float = 0.05):
    """GC curve of the remaining log ratio; returns (model, inputs).

    The polynomial form drops terms without significance once and fits again.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    basis = hinge_columns(F.col("gc"), [] if polynomial else knots)
    df = bins.withColumns(basis)

    def fit(inputs: list[str], penalty: float):
        v = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
        return LinearRegression(labelCol="log_ratio", solver="normal", regParam=penalty).fit(v.select("log_ratio", "features"))

    inputs = list(basis)
    model = fit(inputs, 0.0 if polynomial else 1e-6)
    if polynomial:
        kept = [c for c, p in zip(inputs, model.summary.pValues) if p <= level]
        if kept and len(kept) < len(inputs):
            inputs, model = kept, fit(kept, 0.0)
    return model, inputs


def refine_term(model, inputs: list[str]) -> Column:
    """Fitted curve as an expression over the basis columns, to be added to the log rate."""
    term = F.lit(float(model.intercept))
    for name, c in zip(inputs, model.coefficients):
        term = term + F.col(name) * F.lit(float(c))
    return term


def _noise() -> tuple[Column, Column]:
    o, e = F.col("obs"), F.col("expected")
    return F.avg(F.when(e > 0, ((o - e) * (o - e) - e) / (e * e))), F.avg(F.when(e > 0, F.col("var") / e))


def noise_factor(bins: DataFrame, by: list[str]) -> DataFrame:
    """theta = mean(((o-e)^2-e)/e^2) and mean variance ratio over bins with a positive expectation."""
    theta, ratio = _noise()
    return bins.filter(F.col("expected") > 0).groupBy(*by).agg(theta.alias("theta"), ratio.alias("var_mean_ratio"))


def with_theta(tracks: DataFrame, by: str) -> DataFrame:
    """The same theta as a column of every bin; bins of groups without a positive expectation go.

    One exchange by group instead of a second pass over the bins and a join; rows come ordered by (group, chrom).
    """
    dealt = spread(tracks.filter(F.col(by).isNotNull()), by).sortWithinPartitions(by, "chrom")
    return dealt.withColumn("theta", _noise()[0].over(Window.partitionBy(by))).filter("theta IS NOT NULL")


def penalty(theta: Column, lam: float, strict: bool = False) -> Column:
    """Penalty scaled by a positive noise factor, squared in strict mode."""
    t = F.greatest(theta, F.lit(0.0)) + 1
    return F.lit(lam) * (t * t if strict else t)


# --- mixture model ----------------------------------------------------------------------------

def component_means(alpha: Column, xi: Column, n: int) -> Column:
    """Tied component means i/2 + alpha*(1-i/2) + xi for i = 0..n-1."""
    return F.array(*[F.lit(i / 2.0) + alpha * F.lit(1 - i / 2.0) + xi for i in range(n)])


def ploidy_and_purity(models: DataFrame) -> DataFrame:
    """D, omega, ploidy, impurity and the penalised parameter count of models with `p`, `alpha`."""
    d = F.aggregate(F.transform("p", lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
    df = models.withColumn("D", d).withColumn("ploidy", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    df = df.withColumn("omega", 1 - (1 - F.col("alpha")) * F.col("D") / 2)
    df = df.withColumn("impurity", F.col("omega") * F.col("D") / (2 + (F.col("D") - 2) * F.col("omega")))
    used = F.size(F.filter("p", lambda x: x > 0))
    free = F.when(F.col("alpha") == 1.0, 2.0).otherwise(used + 2.0)
    return df.withColumn("n_param", free + 2 * F.abs(F.col("ploidy") - 2) + 10 * F.abs("impurity"))


def normal_density(x: Column, mu: Column, var: Column) -> Column:
    d = x - mu
    return F.exp(-d * d / (2 * var)) / F.sqrt(2 * math.pi * var)


def predicted_copy_number(x: Column, p: Column, mu: Column, var: Column, floor: float = 1e-6,
                          nearest: bool = True) -> Column:
    """Component of the largest weighted density; below the floor the nearest mean, or -1."""
    n = F.size(p)
    dens = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(p, i) * normal_density(x, F.get(mu, i), F.get(var, i)))
    best = (F.array_position(dens, F.array_max(dens)) - 1).cast("int")
    dist = F.transform(mu, lambda m: F.abs(x - m))
    near = (F.array_position(dist, F.array_min(dist)) - 1).cast("int")
    near = F.when(near == n - 1, n).otherwise(near)
    return F.when(F.array_max(dens) > floor, best).otherwise(near if nearest else F.lit(-1))


def non_neutral(bins: DataFrame) -> DataFrame:
    """Bins with a copy number other than 2, for models of ploidy 2 or with enough weight on 2."""
    usable = (F.col("ploidy") == 2) | (F.get(F.col("p"), F.lit(2)) > 0.2)
    return bins.filter(usable & (F.col("copy_number") != 2))


def mad_cut(bins: DataFrame, by: list[str], value: str, width: float = 10.0, count: str | None = None) -> DataFrame:
    """Rows within median +- width * 1.4826 * MAD; a row stands for `count` rows, or for one."""
    med = exact_quantiles(bins, by, value, [0.5], count=count).select(*by, F.col("q")[0].alias("_med"))
    df = bins.join(med, by).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    mad = exact_quantiles(df, by, "_off", [0.5], count=count).select(*by, F.col("q")[0].alias("_mad"))
    return df.join(mad, by).filter(F.col("_off") <= F.lit(width * 1.4826) * F.col("_mad")).drop("_med", "_mad", "_off")


# --- regions and segments ---------------------------------------------------------------------

def region_counts(regions: DataFrame, bins: DataFrame) -> DataFrame:
    """Number, total size, observed and expected counts of the bins on each region (inclusive ends).

    Zero when the bins are together more than five times as long as the region.
    """
    b = bins.withColumn("_size", F.col("end") - F.col("start") + 1)
    df = track_overlap_sum(regions, b, ["sample", "chrom"], {"size": "_size", "obs": "obs", "expected": "expected"}, closed=True)
    wide = F.coalesce(F.col("size"), F.lit(0)) > 5 * (F.col("end") - F.col("start") + 1)
    kinds = {"n": "bigint", "size": "bigint", "obs": "bigint", "expected": "double"}
    return df.withColumns({c: F.when(wide, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast(k) for c, k in kinds.items()})


def chi1_upper(z: Column) -> Column:
    """P(chi-square with 1 degree of freedom > z^2) = erfc(|z|/sqrt 2), by a rational-exponent fit."""
    # Chebyshev coefficients of erfc (relative error below 1.2e-7).
    coef = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
            -0.82215223, 0.17087277]
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + x / 2)
    poly = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def _per_sample(left: DataFrame, bins: DataFrame, solver: Callable[[dict, np.ndarray, np.ndarray], dict], extra: str) -> DataFrame:
    """Left rows with the columns that `solver` adds to them; rows of samples without bins go.

    It gets the rows of a sample as arrays, and obs and expected of the sample's bins in genome order. A track is bounded by the genome.
    """
    schema = StructType([*left.schema.fields, *StructType.fromDDL(extra).fields])
    fields = to_arrow_schema(schema)

    def on_tables(rows: pa.Table, track: pa.Table) -> pa.Table:
        if not rows.num_rows or not track.num_rows:
            return fields.empty_table()
        track = track.sort_by([("chrom_num", "ascending"), ("start", "ascending")])
        obs, expected = (track.column(c).to_numpy().astype(float) for c in ("obs", "expected"))
        added = solver({c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.column_names}, obs, expected)
        return pa.Table.from_pydict({**{c: rows.column(c) for c in rows.column_names}, **added}, schema=fields)

    track = spread(bins.select("sample", "chrom_num", "start", "obs", "expected"), "sample").groupBy("sample")
    return spread(left, "sample").groupBy("sample").cogroup(track).applyInArrow(on_tables, schema)


def _resampled(draws: int, block: int, cells: int = 1_000_000) -> Callable[[dict, np.ndarray, np.ndarray], dict]:
    def solve(rows: dict, obs: np.ndarray, expected: np.ndarray) -> dict:
        mu, sd = np.zeros(len(rows["seg_id"])), np.zeros(len(rows["seg_id"]))
        heads = np.arange(0, len(obs), block)
        long = rows["bin_num"] > 50 * block
        for which, scale, n, pool in ((~long, 1, len(obs), (obs, expected)),
                                      (long, block, max((len(obs) + 1) // block, 1), [np.add.reduceat(v, heads) for v in (obs, expected)])):
            where = np.flatnonzero(which & (rows["bin_num"] > 0))
            if not len(where):
                continue
            m = rows["bin_num"][where].astype(np.int64) // scale
            first = np.cumsum(m) - m
            k = np.arange(m.sum()) - np.repeat(first, m) + 1
            base = np.repeat(rows["seg_id"][where].astype(np.int64) * 7368787, m) + k * 15485863
            freq = []
            for lot in np.array_split(np.arange(1, draws + 1), min(draws, len(base) * draws // cells + 1)):
                idx = (base + lot[:, None] * 1299709) % 2147483647 * 48271 % 2147483647 % n
                o, e = (np.add.reduceat(v[idx], first, axis=1) for v in pool)
                freq.append(o / (o + e + EPS))
            freq = np.concatenate(freq)
            mu[where], sd[where] = freq.mean(axis=0), freq.std(axis=0, ddof=1)
        return {"mu": mu, "sd": sd}
    return solve


def resampled_significance(segments: DataFrame, bins: DataFrame, draws: int = 100, block: int = 100) -> DataFrame:
    """Two-tailed p-value of each segment's obs/(obs+exp) against random sets of as many bins.

    segments: sample, seg_id (number), bin_num, obs, expected. Draws are hashed from the keys, so a lost task redraws the same
    bins. Segments over 50 blocks draw whole blocks instead. A sample's segments meet its bins in one group, where the draws are
    summed a bounded number at a time, so no draw is ever a row.
    """
    own = F.col("obs") / (F.col("obs") + F.col("expected") + EPS)
    out = _per_sample(segments, bins, _resampled(max(draws, 20), block), "mu double, sd double")
    out = out.withColumn("z", (own - F.col("mu")) / F.greatest("sd", F.lit(0.01)))
    return out.withColumn("pvalue", chi1_upper(F.col("z"))).drop("mu", "sd")


def _circular(rows: dict, obs: np.ndarray, expected: np.ndarray, slack: float = 0.01) -> dict:
    """Of each region against all circular runs of its n bins: mean and deviation of their shares, and the tails around its own."""
    m, t_obs, t_exp = len(obs), obs.sum(), expected.sum()
    o, e = rows["obs"].astype(float), rows["expected"].astype(float)
    freq = np.round(np.where(o + e == 0, t_obs / (t_obs + t_exp), (o + EPS) / (o + e + EPS)), 9)
    out = {c: np.zeros(len(o)) for c in ("mu", "sd", "low", "high")}
    before = [np.concatenate([[0.0], np.cumsum(np.concatenate([v, v]))]) for v in (obs, expected)]
    for n in np.unique(rows["n"][rows["n"] > 0]):
        who = np.flatnonzero(rows["n"] == n)
        a, b = (p[n % m:n % m + m] - p[:m] + n // m * t for p, t in zip(before, (t_obs, t_exp)))
        f = np.sort(np.round((a + EPS) / (a + b + EPS), 9))
        out["mu"][who], out["sd"][who] = f.mean(), f.std(ddof=1) if m > 1 else 0.0
        out["low"][who] = np.searchsorted(f, np.round(freq[who] + slack, 9), "right")
        out["high"][who] = m - np.searchsorted(f, np.round(freq[who] - slack, 9), "left")
    return {**out, "freq": freq, "m": np.full(len(o), float(m)), "t_obs": np.full(len(o), t_obs), "t_exp": np.full(len(o), t_exp)}


def region_significance(regions: DataFrame, bins: DataFrame) -> DataFrame:
    """Log2 ratio and p-value of region counts against every circular run of as many bins.

    Runs of n consecutive bins have only as many starts as there are bins, so instead of drawing
    starts at random all of them are used, however fine the track.
    They depend on (sample, n) alone and are shared by the regions with that n; they are differences of running sums inside the
    group of a sample, so no run is ever a row. Expected counts above 100 use the normal form, others the tail shares with a
    slack of 0.01. A region without bins gets p = 1.
    """
    r = _per_sample(regions, bins, _circular, ", ".join(f"{c} double" for c in ("mu", "sd", "low", "high", "freq", "m", "t_obs", "t_exp")))
    none = F.col("obs") + F.col("expected") == 0
    z = (F.col("freq") - F.col("mu")) / F.greatest("sd", F.lit(0.01))
    tail = F.least(F.lit(1.0), 2 * F.least("low", "high") / F.col("m"))
    p = (F.when(F.col("n") == 0, 1.0).when(F.col("expected") > 100, chi1_upper(z))
         .otherwise(F.when(tail > 0, tail).otherwise(1 / F.col("m"))))
    log2 = F.when(none, 0.0).otherwise(
        F.log2((F.col("obs") + EPS) / (F.col("expected") + EPS) + EPS) - F.log2(F.col("t_obs") / (F.col("t_exp") + EPS) + EPS))
    return r.withColumn("log2_ratio", log2).withColumn("pvalue", p)


def drop_low_expectation(segments: DataFrame, by: list[str]) -> DataFrame:
    """Drop segments whose expectation per base is under a fifth of the genome mean."""
    w = Window.partitionBy(*by)
    length = F.col("end") - F.col("start") + 1
    mean = F.sum("expected").over(w) / F.sum(length).over(w)
    return segments.withColumn("_mean", mean).filter(F.col("expected") / length >= F.col("_mean") / 5).drop("_mean")


def centred_log2(segments: DataFrame, by: list[str]) -> DataFrame:
    """log2(obs/exp) against the genome-wide ratio (one sample, or summed over samples)."""
    w = Window.partitionBy(*by)
    overall = F.log2(F.sum("obs").over(w) / F.sum("expected").over(w) + EPS)
    return segments.withColumn("log2_ratio", F.log2((F.col("obs") + EPS) / (F.col("expected") + EPS)) - overall)


def two_sample_log2(segments: DataFrame, by: list[str]) -> DataFrame:
    """Tumour over normal, each relative to expectation, centred genome-wide; and tumour over expectation."""
    w = Window.partitionBy(*by)
    t, n = F.col("tumor") / F.col("tumor_expected"), F.col("normal") / F.col("normal_expected")
    wt = F.sum("tumor").over(w) / F.sum("tumor_expected").over(w)
    wn = F.sum("normal").over(w) / F.sum("normal_expected").over(w)
    return segments.withColumn("log2_ratio", F.log2(t / (n + EPS) + EPS) - F.log2(wt / wn + EPS)).withColumn(
        "log2_tumor_expected", F.log2(t / n + EPS) - F.log2(wt + EPS))


def recentre_on_neutral(segments: DataFrame, by: list[str], cutoff: float = 0.3, enough: int = 1000) -> DataFrame:
    """Shift so that near-neutral segments average 0, if they hold enough reads."""
    w = Window.partitionBy(*by)
    near = F.abs("log2_ratio") <= cutoff
    o, e = F.sum(F.when(near, F.col("obs"))).over(w), F.sum(F.when(near, F.col("expected"))).over(w)
    adjust = F.when(F.coalesce(o, F.lit(0)) >= enough, F.log2(o / e)).otherwise(0.0)
    return segments.withColumn("adjust", adjust).withColumn(
        "log2_ratio", F.log2(F.col("obs") / F.col("expected") + EPS) - F.col("adjust"))


def renormalise_roles(segments: DataFrame, by: list[str]) -> DataFrame:
    """Between the two rounds: value = (obs/exp) * bins * (all reads / all bins) for tumour and normal."""
    w = Window.partitionBy(*by)
    bins = F.sum("bin_num").over(w)
    return segments.withColumns({
        f"{r}_value": F.col(r) / F.col(f"{r}_expected") * F.col("bin_num") * (F.sum(r).over(w) / bins)
        for r in ("tumor", "normal")})


def roll_up(fine: DataFrame, coarse: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Fine segments summed into coarse ones by running fine-segment counts.

    Both sides number their fine segments; `agrees` checks that the coarse bounds match. Fine
    segments of a sample are bounded by its bins.
    """
    w = Window.partitionBy(*by).orderBy("chrom_num", "start")
    f = fine.withColumn("_i", F.row_number().over(w))
    c = coarse.withColumn("_hi", F.sum("bin_num").over(w)).withColumn("_lo", F.col("_hi") - F.col("bin_num") + 1)
    c = c.select(*by, F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.explode(F.sequence("_lo", "_hi")).alias("_i"))
    out = f.join(c, [*by, "_i"]).groupBy(*by, "chrom_num", "c_start", "c_end").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("bin_num").alias("bin_num"),
        *[F.sum(m).alias(m) for m in measures])
    return out.withColumn("agrees", (F.col("start") == F.col("c_start")) & (F.col("end") == F.col("c_end"))).drop("c_start", "c_end")


def common_cnv(segments: DataFrame, segment_key: list[str], cutoff: float = 0.5) -> DataFrame:
    """Segments raised in every sample, which are likely inherited: flag `common` per segment.

    A sample counts as raised at log2 >= cutoff or >= its own mean + cutoff; one sample alone never is.
    """
    s = Window.partitionBy("sample")
    overall = F.log2(F.sum("tumor").over(s) / F.sum("normal").over(s) + 0.001)
    own = F.log2(F.col("tumor") / F.col("normal") + 0.001)
    df = segments.withColumn("_up", (own >= cutoff) | (own >= overall + cutoff))
    return df.groupBy(*segment_key).agg(
        (F.bool_and("_up") & (F.count_distinct("sample") > 1)).alias("common"))


def count_gc_histogram(bins: DataFrame, gc_classes: int = 20, n_classes: int = 20) -> DataFrame:
    """Counts against GC: 2-D histogram inside the 5-95 % count range widened by 0.6 of it."""
    q = exact_quantiles(bins, ["sample"], "obs", [0.05, 0.95]).select("sample", "q")
    span = F.col("q")[1] - F.col("q")[0]
    df = bins.join(q, "sample").withColumn("_lo", F.col("q")[0] - 0.6 * span).withColumn("_hi", F.col("q")[1] + 0.6 * span)
    df = df.filter((F.col("obs") >= F.col("_lo")) & (F.col("obs") <= F.col("_hi")) & (F.col("_hi") > F.col("_lo")))
    g = F.least(F.floor(F.col("gc") * gc_classes), F.lit(gc_classes - 1).cast("bigint"))
    c = F.least(F.floor((F.col("obs") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n_classes), F.lit(n_classes - 1).cast("bigint"))
    return df.groupBy("sample", g.alias("gc_class"), c.alias("n_class")).agg(F.count("*").alias("bins"))
