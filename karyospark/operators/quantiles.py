"""Exact interpolated percentiles of groups of any size.

Equal values are counted first. A group with at most `block` distinct values goes through the built-in percentile, weighted by
those counts, so a million small groups are one aggregate. A larger group is narrowed down by rank: a sketch of fixed size
brackets each wanted rank, one aggregate counts exactly what lies below and inside the bracket, and only what is
inside is looked at again, until it is small enough to be ordered. No edges are listed on rows, and how a group is
treated depends on that group alone.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.session import materialise

#: Steps of the sketch that brackets a rank, and its accuracy (rank error one in that many).
GRID, ACCURACY = 256, 10_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, cuts: list[float], block: int = 100_000,
                    count: str | None = None) -> DataFrame:
    """by..., n, mean, q: array of the percentiles at `cuts` (linear interpolation); NULL values are left out.

    A row stands for `count` equal values, or for one.
    """
    present = df.filter(F.col(value).isNotNull())
    counted = materialise(present.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        (F.sum(count) if count else F.count("*")).alias("_n")), "quantiles")
    weighted = [F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean")]
    points = F.percentile("_v", F.array(*[F.lit(float(c)) for c in cuts]), F.col("_n")).alias("q")
    if counted.count() <= block:  # the written table knows its rows: no group can be large
        return counted.groupBy(*by).agg(*weighted, points)
    sizes = counted.groupBy(*by).agg(F.count("*").alias("_d"), *weighted)
    large = materialise(sizes.filter(F.col("_d") > block).drop("_d"), "quantiles-large")
    if not large.count():
        return counted.groupBy(*by).agg(*weighted, points)
    small = _with_groups(counted, large, by, "left_anti").groupBy(*by).agg(*weighted, points)
    # The sketches see a value as often as it counts.
    seen = present.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint")))) if count else present
    values = _with_groups(seen.select(*by, F.col(value).cast("double").alias("_v")), large, by, "left_semi")
    big = _selected(values, _with_groups(counted, large, by, "left_semi"), large, by, cuts, block)
    return small.unionByName(big)


def _with_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with a table of groups; NULL keys are groups of their own."""
    right = groups.withColumnsRenamed({c: f"_k_{c}" for c in by})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by), F.lit(True))
    return rows.join(right, same, how).drop(*[f"_k_{c}" for c in by])


def _selected(values: DataFrame, counted: DataFrame, large: DataFrame, by: list[str], cuts: list[float], block: int) -> DataFrame:
    """Percentiles of the large groups: two wanted ranks (_r) for each, every one in an open bracket (_lo, _hi).

    A round takes new edges from a sketch of what is inside and counts exactly below and at them. A rank that falls on
    the values at an edge is found; otherwise the edges stay outside, so ties never keep a bracket from shrinking.
    """
    cut = F.array(*[F.lit(float(c)) for c in cuts])
    ranks = F.explode(F.flatten(F.transform(cut, lambda c, i: F.array(*[
        F.struct(i.alias("i"), F.lit(k).alias("k"), F.least(F.floor((F.col("n") - 1) * c) + k, F.col("n") - 1).alias("r")) for k in (0, 1)]))))
    wide = large.select(*by, "n", ranks.alias("_w")).select(
        *by, F.col("_w.i").alias("_i"), F.col("_w.k").alias("_j"), F.col("_w.r").alias("_r"), F.lit(float("-inf")).alias("_lo"),
        F.lit(float("inf")).alias("_hi"), F.lit(0).cast("bigint").alias("_before"), F.col("n").alias("_inside"))
    grid = F.array(*[F.lit(j / GRID) for j in range(GRID + 1)])
    sketch = F.percentile_approx("_v", grid, F.lit(ACCURACY)).alias("_e")
    edges, key, ready = _with_groups(wide, values.groupBy(*by).agg(sketch), by), [*by, "_i", "_j"], []
    v, lo, hi, r = (F.col(c) for c in ("_v", "_lo", "_hi", "_r"))
    few = max(block, GRID)
    while True:
        first = (F.floor((r - F.col("_before")) / F.col("_inside") * GRID) - 2).cast("int")
        last = (F.ceil((r + 1 - F.col("_before")) / F.col("_inside") * GRID) + 2).cast("int")
        narrow = materialise(edges.select(
            *key, "_r", F.when(first > 0, F.greatest(lo, F.get("_e", first))).otherwise(lo).alias("_lo"),
            F.when(last < GRID, F.least(hi, F.get("_e", last))).otherwise(hi).alias("_hi")), "quantiles-narrow")
        weight = {"_below": v < lo, "_before": v <= lo, "_under": v < hi, "_through": v <= hi}
        seen = _with_groups(counted, narrow, by).groupBy(*key, "_r", "_lo", "_hi").agg(
            *(F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).alias(name) for name, c in weight.items()), F.count_if((v > lo) & (v < hi)).alias("_d"))
        value = F.when((r >= F.col("_below")) & (r < F.col("_before")), lo).when((r >= F.col("_under")) & (r < F.col("_through")), hi)
        seen = materialise(seen.withColumn("_x", value).withColumn("_inside", F.col("_under") - F.col("_before")), "quantiles-brackets")
        ready.append(seen.filter(F.col("_x").isNotNull() | (F.col("_d") <= few)))
        wide = seen.filter(F.col("_x").isNull() & (F.col("_d") > few)).select(*key, "_r", "_lo", "_hi", "_before", "_inside")
        if not wide.count():
            break
        again = _with_groups(values, wide.select(*key, "_lo", "_hi"), by).filter((v > lo) & (v < hi)).groupBy(*key).agg(sketch)
        edges = _with_groups(wide, again, key)
    found = reduce(DataFrame.unionByName, ready).select(*key, "_r", "_lo", "_hi", "_before", "_x")
    rows = _with_groups(counted, found.filter("_x IS NULL"), by).filter((v > lo) & (v < hi))
    w = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_through", F.col("_before") + F.sum("_n").over(w))
    inner = rows.filter((F.col("_through") - F.col("_n") <= r) & (r < F.col("_through"))).select(*key, v.alias("_x"))
    both = found.filter("_x IS NOT NULL").select(*key, "_x").unionByName(inner).groupBy(*by, "_i").agg(
        F.max(F.when(F.col("_j") == 0, F.col("_x"))).alias("_a"), F.max(F.when(F.col("_j") == 1, F.col("_x"))).alias("_z"))
    per = _with_groups(both, large, by)
    at = (F.col("n") - 1) * F.get(cut, F.col("_i"))
    point = F.struct("_i", (F.col("_a") + (at - F.floor(at)) * (F.col("_z") - F.col("_a"))).alias("q"))
    return per.groupBy(*by, "n", "mean").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["q"]).alias("q"))
