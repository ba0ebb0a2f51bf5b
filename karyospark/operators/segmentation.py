"""Sequential solvers as grouped functions: LOWESS, CBS, BIC merging, neighbour merging, mixture fits.

Each group is one sample's bins or one chromosome of one sample, both bounded by the genome, or a
fixed-size histogram. The numeric helpers are small; Spark does the partitioning.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from karyospark.operators.counts import by_track
from karyospark.session import materialise, spread

SEGMENT_SCHEMA = "sample string, chrom string, start_bin bigint, end_bin bigint, n_bins bigint, mean double"
BIC_SCHEMA = "sample string, chrom string, start bigint, end bigint, bin_num bigint, obs double, expected double"


def run_caller(bins: DataFrame, caller: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str,
               params: dict | None = None, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Plug-in hook: a function of (one group's rows, parameters) returning rows of a declared schema."""
    settings = dict(params or {})
    return spread(bins, *by).groupBy(*by).applyInPandas(lambda pdf: caller(pdf, settings), schema)


def _tracks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[dict, list[tuple[int, int]]]]:
    """Columns as arrays and the bounds of the whole groups in them, from batches sorted by `keys`.

    A group that a batch cuts is kept until its rest has come, so no more is held than a batch and one group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = [0]
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            edges.extend((np.flatnonzero(v[1:] != v[:-1]) + 1).tolist())
            if rest and rest[-1].column(k)[-1].as_py() != v[0]:
                edges.append(-1)
        edges = sorted(set(edges))
        if edges[0] < 0:
            yield _columns(rest, keys)
            rest, edges = [], edges[1:]
        if len(edges) > 1:
            yield _columns([*rest, batch.slice(0, edges[-1])], keys)
            rest = []
        rest.append(batch.slice(edges[-1]))
    if rest:
        yield _columns(rest, keys)


def _columns(parts: list[pa.RecordBatch], keys: tuple[str, ...]) -> tuple[dict, list[tuple[int, int]]]:
    table = pa.Table.from_batches(parts)
    cols = {n: table.column(n).to_numpy(zero_copy_only=False) for n in table.column_names}
    cut = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        cut |= cols[k][1:] != cols[k][:-1]
    heads = [0, *(np.flatnonzero(cut) + 1).tolist(), table.num_rows]
    return cols, list(zip(heads, heads[1:]))


def run_solver(bins: DataFrame, solver: Callable, schema: str, params: dict | None, by: tuple[str, ...],
               together: bool = False) -> DataFrame:
    """As `run_caller` for the many small groups of (sample, chrom): columns as arrays, straight from Arrow.

    The rows of a task come sorted by `by` and in batches that hold many groups: a message of its own for each group would take
    longer than most groups' work. With `together` the solver takes a list of groups and yields the columns of each.
    """
    settings = dict(params or {})
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in _tracks(batches, by):
            out: dict[str, list] = {n: [] for n in fields.names}
            groups = [{n: v[lo:hi] for n, v in cols.items()} for lo, hi in bounds]
            for got in solver(groups, settings) if together else (solver(g, settings) for g in groups):
                for n, column in out.items():
                    column.extend(got[n])
            yield pa.RecordBatch.from_pydict(out, schema=fields)

    return spread(bins, *by).sortWithinPartitions(*by).mapInArrow(on_batches, schema)


# --- GC correction ----------------------------------------------------------------------------

def lowess_fit(x: np.ndarray, y: np.ndarray, frac: float = 0.1, robust_passes: int = 3) -> np.ndarray:
    """Tricube-weighted local lines with robust reweighting, evaluated once per distinct x."""
    n = len(x)
    k = min(max(int(frac * n + 1e-10), 2), n)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    grid, first = np.unique(xs, return_index=True)
    fitted, weight = np.zeros(n), np.ones(n)
    for turn in range(robust_passes + 1):
        at_grid = np.empty(len(grid))
        for g, x0 in enumerate(grid):
            lo, hi = max(0, first[g] - k + 1), min(n, first[g] + k)
            near = np.argpartition(np.abs(xs[lo:hi] - x0), min(k, hi - lo) - 1)[:k] + lo
            d = np.abs(xs[near] - x0)
            far = max(d.max(), 1e-12)
            w = np.where(d <= 0.001 * far, 1.0, (1 - np.minimum(d / far, 1.0) ** 3) ** 3) * weight[near]
            total = w.sum()
            if total <= 0:
                at_grid[g] = ys[near].mean()
                continue
            mx, my = (w * xs[near]).sum() / total, (w * ys[near]).sum() / total
            sxx = (w * (xs[near] - mx) ** 2).sum()
            slope = (w * (xs[near] - mx) * (ys[near] - my)).sum() / sxx if sxx > 1e-12 else 0.0
            at_grid[g] = my + slope * (x0 - mx)
        fitted = np.interp(xs, grid, at_grid)
        if turn < robust_passes:
            res = np.abs(ys - fitted)
            scale = 6.0 * np.median(res)
            if scale <= 0:
                break
            weight = (1 - np.minimum(res / scale, 1.0) ** 2) ** 2
    out = np.empty(n)
    out[order] = fitted
    return out


def gc_lowess(bins: DataFrame, count: str = "n", min_count: float = 1e-4, frac: float = 0.1) -> DataFrame:
    """Counts over their LOWESS expectation by GC, per sample; masked or empty bins give 0.

    Input has sample, chrom, bin, gc, masked and the count. Only usable rows go to Python.
    """
    ok = (F.col(count) > min_count) & ~F.col("masked")
    rows = bins.filter(ok).select("sample", "chrom", "bin", F.col(count).cast("double").alias("c"), F.col("gc").cast("double"))

    def correct(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["c"].to_numpy()
        e = lowess_fit(pdf["gc"].to_numpy(), y, frac) if len(pdf) > 2 else np.zeros(len(pdf))
        return pdf[["sample", "chrom", "bin"]].assign(value=np.where(e > 0, y / np.where(e > 0, e, 1.0), y))

    fixed = run_caller(rows, lambda pdf, _: correct(pdf), "sample string, chrom string, bin bigint, value double")
    return bins.drop("value").join(fixed, ["sample", "chrom", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def loess_curve(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75, count: np.ndarray | None = None) -> np.ndarray:
    """Local quadratic, tricube weights, evaluated at given points; ``count`` says how many equal rows a point stands for."""
    count = np.ones(len(x)) if count is None else count
    need = max(span * count.sum(), min(count.sum(), 4.0))
    out = np.empty(len(at))
    for i, x0 in enumerate(at):
        d = np.abs(x - x0)
        near = np.argsort(d, kind="stable")
        k = min(int(np.searchsorted(np.cumsum(count[near]), need - 1e-9)), len(x) - 1)
        far = max(d[near[k]], 1e-9)
        w = np.clip(1 - (d / far) ** 3, 0, None) ** 1.5 * np.sqrt(count)
        a = np.vander(x - x0, 3) * w[:, None]
        out[i] = np.linalg.lstsq(a, y * w, rcond=None)[0][-1]
    return out


def gc_loess_ratio(bins: DataFrame, count: str = "obs", cells: int = 100, fine: int = 2000) -> DataFrame:
    """(count+0.1) over a loess of log(count+0.1) on GC, per sample.

    The fit sees all rows as a histogram of ``fine`` GC cells with their counts and means, whatever the size of the track; it
    becomes a small curve that is joined and interpolated on all rows, which never go to Python.
    """
    rows = bins.groupBy("sample", F.floor(F.col("gc") * fine).alias("_cell")).agg(
        F.avg(F.col("gc").cast("double")).alias("gc"), F.avg(F.log(F.col(count) + F.lit(0.1))).alias("y"), F.count("*").alias("k")).drop("_cell")
    grid = np.linspace(0.0, 1.0, cells + 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["gc"].to_numpy(), pdf["y"].to_numpy()
        at = np.clip(grid, x.min(), x.max())
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "cell": np.arange(cells), "y0": (c := loess_curve(x, y, at, count=pdf["k"].to_numpy(float)))[:-1], "y1": c[1:]})

    curve = run_caller(rows, lambda pdf, _: fit(pdf), "sample string, cell bigint, y0 double, y1 double")
    cell = F.least(F.floor(F.col("gc") * cells), F.lit(cells - 1).cast("bigint"))
    joined = bins.withColumn("cell", cell).join(curve, ["sample", "cell"])
    part = F.col("gc") * cells - F.col("cell")
    return joined.withColumn("ratio", (F.col(count) + 0.1) / F.exp(F.col("y0") + part * (F.col("y1") - F.col("y0")))).drop("cell", "y0", "y1")


# --- circular binary segmentation ---------------------------------------------------------------

def cap_outliers(bins: DataFrame, region: int = 10, value: str = "log2_ratio") -> DataFrame:
    """Pull single outliers to the local median +- 2 SD when they stand 4 SD off their neighbours (windows only)."""
    order = by_track().orderBy("bin")
    step = F.abs(F.col(value) - F.lag(value).over(order))
    df = bins.withColumn("_d", step)
    df = df.withColumn("_sd", F.percentile("_d", F.lit(0.5)).over(by_track()) * F.lit(1.4826 / math.sqrt(2)))
    # The neighbours' extremes are those of the sorted window without the value itself: its second and last but one.
    df = df.withColumn("_near", F.sort_array(F.collect_list(value).over(order.rowsBetween(-region, region))))
    near, n, x, sd = F.col("_near"), F.size("_near"), F.col(value), F.col("_sd")
    low, top = F.get(near, F.lit(1)), F.get(near, n - 2)
    med = F.get(near, F.expr("(size(_near) - 1) div 2").cast("int")) * 0.5 + F.get(near, F.expr("size(_near) div 2").cast("int")) * 0.5
    capped = F.when(x > top + 4 * sd, med + 2 * sd).when(x < low - 4 * sd, med - 2 * sd).otherwise(x)
    return df.withColumn(value, capped).drop("_d", "_sd", "_near")


def _nu(x: np.ndarray) -> np.ndarray:
    phi = np.exp(-x * x / 8) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * (1 + math.erf(v / 2 / math.sqrt(2))) for v in x])
    return (2 / x) * (cdf - 0.5) / (x / 2 * cdf + phi)


def arc_tail(b: float, n: int, share: float, cells: int = 100) -> float:
    """Upper tail of the largest arc statistic over arcs of at least `share` of n points (boundary-crossing form)."""
    if b <= 0 or share >= 0.5:
        return 1.0
    t = np.linspace(share, 1 - share, 2 * cells + 1)
    mid = (t[1:] + t[:-1]) / 2
    f = _nu(b / np.sqrt(n * mid * (1 - mid))) ** 2 / (mid * (1 - mid)) ** 2
    return min(1.0, b ** 3 * math.exp(-b * b / 2) / (4 * math.sqrt(2 * math.pi)) * float((f * np.diff(t)).sum()))


def best_arc(x: np.ndarray, longest: int | None = None, min_width: int = 2, cells: int = 1_000_000) -> tuple[float, int, int]:
    """Largest |arc mean - rest mean| in standard units, with its half-open bounds.

    All arcs of some widths at once, `cells` at most. The complement of a long arc is a short one, so widths above n/2 are covered
    by arcs that wrap around the end.
    """
    n = len(x)
    s = np.concatenate([[0.0], np.cumsum(x - x.mean())])
    best = (0.0, 0, n)
    start = np.arange(n)
    last = min(longest or n // 2, n - min_width)
    # Row w of `ends` is where the arcs of width w end, for every start; a start above n - w wraps.
    ends = sliding_window_view(np.concatenate([s, s[1:]]), n)
    step = max(1, cells // max(n, 1))
    for w0 in range(min_width, last + 1, step):
        w = np.arange(w0, min(w0 + step, last + 1))
        plain = start <= n - w[:, None]
        arcs = np.abs(ends[w] + np.where(plain, -s[:-1], s[-1] - s[:-1]))
        rows, unit = np.arange(len(w)), np.sqrt(w * (1 - w / n))
        i = np.where(plain, arcs, -1.0).argmax(axis=1)
        z = [arcs[rows, i] / unit]
        if longest is None:
            # Among equal arcs that wrap, the latest start counts.
            j = n - 1 - np.where(plain, -1.0, arcs)[:, ::-1].argmax(axis=1)
            z.append(np.where(w > 1, arcs[rows, j] / unit, 0.0))
        z = np.stack(z, axis=1)
        k, wraps = divmod(int(z.argmax()), z.shape[1])
        if z[k, wraps] > best[0]:
            a, width = int((i, j)[wraps][k] if wraps else i[k]), int(w[k])
            best = (float(z[k, wraps]), a + width - n, a) if wraps else (float(z[k, wraps]), a, a + width)
    return best


def arc_significant(x: np.ndarray, z: float, alpha: float, permutations: int, rng, short: int = 25) -> bool:
    """Hybrid p-value: tail formula for long arcs plus seeded permutations for short ones."""
    n = len(x)
    sd = x.std(ddof=1)
    if sd <= 1e-12:
        return False
    b = z / sd
    tail = arc_tail(b, n, (short + 1) / n) if n > 2 * (short + 1) else 0.0
    if tail > alpha:
        return False
    centred = x - x.mean()
    allowed, seen, done = (alpha - tail) * permutations, 0, 0
    while done < permutations:
        m = min(200, permutations - done)
        drawn = rng.permuted(np.tile(centred, (m, 1)), axis=1)
        # Noise mostly shows in the first few permutations; the rest is drawn all the same, so later draws don't depend on it.
        for lot in (drawn[:20], drawn[20:]):
            s = np.concatenate([np.zeros((len(lot), 1)), np.cumsum(lot, axis=1)], axis=1)
            top = np.zeros(len(lot))
            for w in range(2, min(short, n // 2) + 1):
                top = np.maximum(top, np.abs(s[:, w:] - s[:, :-w]).max(axis=1) / math.sqrt(w * (1 - w / n)))
            seen += int((top >= z).sum())
            if seen > allowed:
                return False
        done += m
    return True


def cbs_breaks(x: np.ndarray, alpha: float, permutations: int, seed: int, min_width: int = 2) -> list[int]:
    """Segment bounds of one track by repeated circular splits."""
    rng, todo, bounds = np.random.default_rng(seed), [(0, len(x))], {0, len(x)}
    while todo:
        lo, hi = todo.pop()
        part = x[lo:hi]
        if hi - lo < 2 * min_width:
            continue
        z, i, j = best_arc(part, None, min_width)
        if z <= 0 or not arc_significant(part, z, alpha, permutations, rng):
            continue
        cuts = sorted({0, i, j, hi - lo})
        if len(cuts) > 2:
            bounds.update(lo + c for c in cuts)
            todo.extend((lo + a, lo + b) for a, b in zip(cuts, cuts[1:]))
    return sorted(bounds)


def cbs_solver(cols: dict, params: dict) -> dict:
    order = np.argsort(cols["bin"])
    x, b = cols["log2_ratio"][order], cols["bin"][order]
    cut = cbs_breaks(x, params["alpha"], params["permutations"], params["seed"])
    spans = list(zip(cut, cut[1:]))
    return {"sample": [cols["sample"][0]] * len(spans), "chrom": [cols["chrom"][0]] * len(spans),
            "start_bin": [int(b[i]) for i, _ in spans], "end_bin": [int(b[j - 1]) for _, j in spans],
            "n_bins": [j - i for i, j in spans], "mean": [float(x[i:j].mean()) for i, j in spans]}


def cbs_segments(bins: DataFrame, alpha: float = 1e-5, permutations: int = 20_000, seed: int = 42) -> DataFrame:
    """Circular binary segmentation of every (sample, chrom) track of valid log2 ratios."""
    rows = cap_outliers(bins.filter("log2_ratio IS NOT NULL")).select("sample", "chrom", "bin", "log2_ratio")
    return run_solver(rows, cbs_solver, SEGMENT_SCHEMA,
                      {"alpha": alpha, "permutations": permutations, "seed": seed}, ("sample", "chrom"))


# --- BIC merging --------------------------------------------------------------------------------

def _cost(obs: list[float], exp: list[float]) -> float:
    """-2 log likelihood of the observed share, summed over samples; 0 where either count is 0."""
    total = 0.0
    for o, e in zip(obs, exp):
        if o > 0 and e > 0:
            total -= 2 * (o * math.log(o / (o + e)) + e * math.log(e / (o + e)))
    return total


def _merge_level(segs: list[list], level: int, price: float) -> tuple[list[list], int]:
    """Merge runs of `level` neighbours, best first, until no run lowers the BIC.

    A segment is [first bin, obs per sample, exp per sample, cost]. A heap holds one entry per run;
    entries of changed runs are outdated by a stamp instead of being searched for.
    """
    n = len(segs)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    stamp, alive, heap, merged = [0] * n, [True] * n, [], 0

    def run(i: int) -> list[int]:
        out = []
        while i < n and len(out) < level:
            out.append(i)
            i = after[i]
        return out

    def push(i: int) -> None:
        stamp[i] += 1
        if level == 2:
            j = after[i]
            if j >= n:
                return
            a, b = segs[i], segs[j]
            o, e, apart = list(map(add, a[1], b[1])), list(map(add, a[2], b[2])), a[3] + b[3]
        else:
            members = run(i)
            if len(members) < level:
                return
            o = [sum(v) for v in zip(*(segs[m][1] for m in members))]
            e = [sum(v) for v in zip(*(segs[m][2] for m in members))]
            apart = sum(segs[m][3] for m in members)
        cost = _cost(o, e)
        gain = cost - apart - (level - 1) * price
        if gain < 0:
            heapq.heappush(heap, (gain, i, stamp[i], o, e, cost))

    for i in range(n):
        push(i)
    while heap:
        _, i, s, o, e, cost = heapq.heappop(heap)
        if not alive[i] or s != stamp[i]:
            continue
        members = run(i)
        for m in members[1:]:
            alive[m] = False
        after[i] = after[members[-1]]
        if after[i] < n:
            before[after[i]] = i
        segs[i] = [segs[i][0], o, e, cost]
        merged += level - 1
        j = i
        for _ in range(level):
            if j < 0:
                break
            push(j)
            j = before[j]
    return [segs[i] for i in range(n) if alive[i]], merged


def bic_merge(obs: np.ndarray, exp: np.ndarray, price: float) -> list[int]:
    """First bins of the final segments (and the number of bins at the end).

    obs and exp are (bins, samples); `price` is samples * lambda * log N. Pairs merge first, then
    longer runs as long as each length merges something, then back down until pairs are settled.
    """
    segs = [[i, o, e, _cost(o, e)] for i, (o, e) in enumerate(zip(obs.tolist(), exp.tolist()))]
    level = 2
    while True:
        segs, merged = _merge_level(segs, level, price)
        if merged:
            level += 1
        elif level <= 2:
            break
        else:
            level -= 1
    return [s[0] for s in segs] + [len(obs)]


def _bic_solver(keys: list[str], penalty: str) -> Callable[[dict, dict], dict]:
    def merge(cols: dict, params: dict) -> dict:
        order = np.argsort(cols["start"])
        cols = {k: v[order] for k, v in cols.items()}
        roles = params["roles"]
        price = len(roles) * float(cols[penalty][0]) * math.log(max(float(cols["n_reads"][0]), 2.0))
        o, e = (np.stack([cols[r[i]] for r in roles], axis=1) for i in (0, 1))
        at = np.array(bic_merge(o, e, price)[:-1])
        out = {k: [cols[k][0]] * len(at) for k in [*keys, penalty, "n_reads"]}
        out["start"] = cols["start"][at]
        out["end"] = np.maximum.reduceat(cols["end"], at)
        for c in ["bin_num", *[c for r in roles for c in r]]:
            out[c] = np.add.reduceat(cols[c], at)
        return out
    return merge


def bic_segments(bins: DataFrame, roles: list[tuple[str, str]], group: str = "sample", block: int = 50_000,
                 penalty: str = "lam") -> DataFrame:
    """Two-level BIC segmentation of (group, chrom) tracks.

    Bins first merge inside blocks of `block` consecutive bins, then the surviving segments merge
    over the whole chromosome. `bins` has start, end, the count columns of `roles` (one pair per
    sample) and the penalty; N is all reads of the chromosome.
    """
    counts = [c for r in roles for c in r]
    whole = Window.partitionBy(group, "chrom")
    n = sum((F.sum(c).over(whole) for c in counts[1:]), F.sum(counts[0]).over(whole))
    width = F.min(F.col("end") - F.col("start") + 1).over(whole)
    df = bins.withColumn("n_reads", n.cast("double")).withColumn(
        "block", F.floor(F.col("start") / (F.greatest(width, F.lit(1)) * block)))
    df = df.select(group, "chrom", "block", "start", "end", F.lit(1).cast("bigint").alias("bin_num"),
                   *[F.col(c).cast("double") for c in counts], F.col(penalty).cast("double"), "n_reads")
    tail = ", ".join(f"{c} double" for c in counts)
    first = (f"{group} string, chrom string, block bigint, start bigint, end bigint, bin_num bigint, {tail}, "
             f"{penalty} double, n_reads double")
    second = first.replace(" block bigint,", "")
    inside = run_solver(df, _bic_solver([group, "chrom", "block"], penalty), first, {"roles": roles}, (group, "chrom", "block"))
    return run_solver(inside.drop("block"), _bic_solver([group, "chrom"], penalty), second, {"roles": roles}, (group, "chrom"))


def merge_close(segments: DataFrame, min_diff: float = 0.1) -> DataFrame:
    """Merge the neighbouring pair with the closest log2 ratio while they differ by at most `min_diff`."""
    def merge(pdf: pd.DataFrame, params: dict) -> pd.DataFrame:
        pdf = pdf.sort_values("start").reset_index(drop=True)
        cols = {c: pdf[c].to_numpy(dtype=float).tolist() for c in ("obs", "expected")}
        start, end, nb = pdf["start"].tolist(), pdf["end"].tolist(), pdf["bin_num"].tolist()
        adjust = float(pdf["adjust"].iloc[0])

        def log2(i: int) -> float:
            return math.log2(cols["obs"][i] / cols["expected"][i] + 1e-10) - adjust

        x = [log2(i) for i in range(len(start))]
        while len(x) > 1:
            d = np.abs(np.diff(x))
            i = int(np.argmin(d))
            if d[i] > params["min_diff"]:
                break
            for v in (cols["obs"], cols["expected"], nb):
                v[i] += v.pop(i + 1)
            end[i] = end.pop(i + 1)
            start.pop(i + 1)
            x.pop(i + 1)
            x[i] = log2(i)
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "chrom": pdf["chrom"].iloc[0], "start": start, "end": end,
                             "bin_num": nb, "obs": cols["obs"], "expected": cols["expected"], "log2_ratio": x})
    rows = segments.select("sample", "chrom", "start", "end", "bin_num", F.col("obs").cast("double"),
                           F.col("expected").cast("double"), F.col("adjust").cast("double"))
    return run_caller(rows, merge, BIC_SCHEMA + ", log2_ratio double", {"min_diff": min_diff}, ("sample", "chrom"))


# --- mixture of copy-number states ---------------------------------------------------------------

#: Numbers in one array of a batch of fits; more samples at once would leave the processor's cache.
_MIXTURE_NUMBERS = 200_000
MODEL_SCHEMA = ("sample string, n int, start int, alpha double, xi double, p array<double>, mu array<double>, "
                "var array<double>, loglik double, bic double")


def _mixture_starts(models: list[tuple[int, int]]) -> list[tuple[float, np.ndarray]]:
    """First alpha and shares of each (components, start); seeded, so the same for every sample."""
    out = []
    for n, start in models:
        rng = np.random.default_rng(start * 1009 + n)
        out.append((rng.uniform(0.0, 0.6), rng.dirichlet(np.full(n, 5.0))))
    return out


def _solve_2x2(a11: np.ndarray, a12: np.ndarray, a22: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """First unknown of symmetric 2x2 systems, by elimination with pivots; the second is 0 where a system is singular."""
    swap = np.abs(a12) > np.abs(a11)
    pivot, low, c1, c2 = (np.where(swap, u, v) for u, v in ((a12, a11), (a11, a12), (a22, a12), (a12, a22)))
    r1, r2 = np.where(swap, b2, b1), np.where(swap, b1, b2)
    rest = c2 - low / pivot * c1
    second = np.where(rest != 0, (r2 - low / pivot * r1) / np.where(rest != 0, rest, 1.0), 0.0)
    return (r1 - c1 * second) / pivot


def fit_tied_mixtures(x: np.ndarray, w: np.ndarray, starts: list[tuple[float, np.ndarray]], equal_variance: bool = True,
                      passes: int = 200, faint: float = 1e-4) -> list[list[dict]]:
    """EM for normal components with means i/2 + alpha*(1-i/2) + xi, on weighted points: all `starts` of all samples at once.

    x and w are (samples, points), filled up with points of no weight. One variance, or one per component. Components fainter
    than `faint` are dropped on the way, so a model with too many components reduces itself. Each fit goes its own way and ends
    by itself. The arrays hold a row for each component still alive, those of a fit side by side, so a pass over all fits costs as many calls as a
    pass over one.
    """
    samples, models, sizes = len(x), len(starts), np.array([len(p) for _, p in starts])
    weights = w.sum(axis=1)
    spread = (w * (x - ((w * x).sum(axis=1) / weights)[:, None]) ** 2).sum(axis=1) / weights
    # Of each fit: its number, sample, alpha, xi, log-likelihood, pooled variance. Of each row: fit, component, share, variance.
    who = np.arange(samples * models)
    sample = who // models
    alpha, xi, last = np.tile([a for a, _ in starts], samples), np.zeros(len(who)), np.full(len(who), -np.inf)
    fit = np.repeat(who, np.tile(sizes, samples))
    comp = np.tile(np.concatenate([np.arange(n) for n in sizes]), samples)
    p = np.tile(np.concatenate([share for _, share in starts]), samples)
    pooled = spread[sample] / np.tile(sizes, samples) + 1e-4
    var = pooled[fit]
    found = {c: np.zeros(len(who)) for c in ("alpha", "xi", "loglik")}
    found_p, found_var = np.zeros((len(who), sizes.max())), np.zeros((len(who), sizes.max()))

    def settle(ended: np.ndarray) -> None:
        rows, at = ended[fit], who[ended]
        for c, v in (("alpha", alpha), ("xi", xi), ("loglik", last)):
            found[c][at] = v[ended]
        found_var[at] = pooled[ended][:, None]
        spot = who[fit[rows]], comp[rows]
        found_p[spot], found_var[spot] = p[rows], var[rows]

    changed = True
    for _ in range(passes):
        if changed:
            heads, points, weight, total_weight = np.searchsorted(fit, np.arange(len(who))), x[sample[fit]], w[sample], weights[sample]
            i = comp / 2.0
            changed = False
        mu = i + alpha[fit] * (1 - i) + xi[fit]
        off = points - mu[:, None]
        dens = off * off
        dens *= (-0.5 / var)[:, None]
        np.exp(dens, out=dens)
        dens *= (p / np.sqrt(2 * math.pi * var))[:, None]
        total = np.add.reduceat(dens, heads, axis=0) + 1e-300
        ll = (weight * np.log(total)).sum(axis=1)
        ended = ll - last < 1e-6 * np.abs(ll)
        settle(ended)
        if ended.all():
            break
        last = ll
        # What each component takes of the points: its weight, and sums of the distance from its mean and of the square of that.
        dens *= (weight / total)[fit]
        m = dens.sum(axis=1)
        dens *= off
        first = dens.sum(axis=1)
        dens *= off
        second = dens.sum(axis=1)
        p = np.where(m / total_weight[fit] < faint, 0.0, m)
        p = p / np.add.reduceat(p, heads)[fit]
        # Weighted least squares of x - i on (1 - i) and 1 gives alpha and xi.
        q, y = m / var, (first + (mu - i) * m) / var
        q1, q0, y0 = (np.add.reduceat(v, heads) for v in (q * (1 - i), q, y))
        slope = _solve_2x2(np.add.reduceat(q * (1 - i) ** 2, heads) + 1e-9, q1, q0 + 1e-9, np.add.reduceat(y * (1 - i), heads), y0)
        alpha = np.clip(slope, 0.0, 0.999)
        xi = (y0 - alpha * q1) / q0
        step = mu - (i + alpha[fit] * (1 - i) + xi[fit])
        spread_sq = second + 2 * step * first + step * step * m
        pooled = np.maximum(np.add.reduceat(spread_sq, heads) / total_weight, 1e-6)
        var = pooled[fit] if equal_variance else np.where(p > 0, np.maximum(spread_sq / np.maximum(m, 1e-9), 1e-6), pooled[fit])
        keep = (p != 0) & ~ended[fit]
        if not keep.all():
            number = np.cumsum(~ended) - 1
            fit, comp, p, var = number[fit[keep]], comp[keep], p[keep], var[keep]
            who, sample, alpha, xi, last, pooled = (v[~ended] for v in (who, sample, alpha, xi, last, pooled))
            changed = True
    else:
        settle(np.ones(len(who), bool))
    return [[_mixture(int(n), {c: float(v[k]) for c, v in found.items()}, found_p[k, :n], found_var[k, :n], weights[s], equal_variance)
             for k, n in enumerate(sizes, s * models)] for s in range(samples)]


def _mixture(n: int, fitted: dict, p: np.ndarray, var: np.ndarray, weight: float, equal_variance: bool) -> dict:
    i = np.arange(n) / 2.0
    used = int((p > 0).sum())
    free = used + 2 if equal_variance else 2 * used + 2
    return {**fitted, "p": p.tolist(), "mu": (i + fitted["alpha"] * (1 - i) + fitted["xi"]).tolist(), "var": var.tolist(),
            "bic": -2 * fitted["loglik"] + free * math.log(max(weight, 2.0))}


def mixture_models(ratios: DataFrame, components: range = range(3, 16), starts: int = 10, cell: float = 0.01,
                   value: str = "ratio", top: float = 8.0, equal_variance: bool = True, count: str | None = None) -> DataFrame:
    """All candidate mixture models per sample, one row per (sample, components, start).

    Ratios become a histogram of at most top/cell + 1 cells on Spark (the last cell collects
    everything above `top`), so a fit never depends on the number of bins. A row stands for `count` equal ratios, or for one. All fits of a sample run
    in its one group: its histogram is shuffled once, not once for each fit. Samples are fitted a few at a time, by the size of their arrays.
    The histograms are written before: where a join leaves them by sample already, the planner would drop the spread over tasks.
    """
    c = F.least(F.floor(F.col(value) / cell), F.lit(int(top / cell)).cast("bigint"))
    n = F.col(count) if count else F.lit(1).cast("bigint")
    hist = ratios.filter(F.col(value).isNotNull()).groupBy("sample", c.alias("cell")).agg(
        F.sum(n).alias("w"), (F.sum(F.col(value) * n) / F.sum(n)).alias("x"))
    models = [(k, start) for k in components for start in range(starts)]

    def fit(groups: list[dict], params: dict) -> Iterator[dict]:
        begin, at = _mixture_starts(models), 0
        rows = sum(k for k, _ in models)
        while at < len(groups):
            width, several = 0, []
            while at < len(groups):
                width = max(width, len(groups[at]["cell"]))
                if several and rows * width * (len(several) + 1) > _MIXTURE_NUMBERS:
                    break
                several.append(groups[at])
                at += 1
            yield from _fitted(several, models, begin, params["equal_variance"])

    written = materialise(hist, "ratio-histograms")
    return run_solver(written, fit, MODEL_SCHEMA, {"equal_variance": equal_variance}, ("sample",), together=True)


def _fitted(groups: list[dict], models: list[tuple[int, int]], begin: list[tuple[float, np.ndarray]], equal_variance: bool) -> Iterator[dict]:
    """Columns of all models of each of some samples."""
    x, w = np.zeros((2, len(groups), max(len(g["cell"]) for g in groups)))
    for s, g in enumerate(groups):
        order = np.argsort(g["cell"])
        x[s], w[s, :len(order)] = g["x"][order[0]], g["w"][order]
        x[s, :len(order)] = g["x"][order]
    for g, fits in zip(groups, fit_tied_mixtures(x, w, begin, equal_variance)):
        out = {"sample": [g["sample"][0]] * len(models), "n": [n for n, _ in models], "start": [k for _, k in models]}
        yield out | {c: [m[c] for m in fits] for c in fits[0]}


def copy_ratio_models(ratios: DataFrame, value: str = "ratio", **fit) -> DataFrame:
    """Best model per sample after the outlier cut of 10 MAD around the median.

    Equal ratios of a sample are counted once and written: the two quantiles, the cut and the fits read that table, not the bins.
    """
    from karyospark.operators.bic import mad_cut

    counted = materialise(ratios.filter(F.col(value).isNotNull()).groupBy("sample", value).agg(F.count("*").alias("n")), "copy-ratios")
    return best_model(mixture_models(mad_cut(counted, ["sample"], value, count="n"), value=value, count="n", **fit))


def best_model(models: DataFrame) -> DataFrame:
    """Model of the lowest penalised BIC per sample."""
    from karyospark.operators.bic import ploidy_and_purity

    m = ploidy_and_purity(models)
    score = F.col("bic") + 2 * F.abs(F.col("ploidy") - 2) + 10 * F.abs("impurity")
    whole = F.struct(*m.columns)
    return m.withColumn("_s", score).groupBy("sample").agg(F.min_by(whole, F.struct("_s", "n", "start")).alias("m")).select("m.*")
