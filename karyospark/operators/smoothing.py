"""Smoothing of log2-ratio tracks as window plans; NULL is a masked bin."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyospark.operators.counts import by_track


def _shifted(how: str, column: str, offset: int, nulls: str = "RESPECT") -> Column:
    return F.expr(f"{how}({column}, {offset}) {nulls} NULLS OVER (PARTITION BY sample, chrom ORDER BY bin)")


def nearest_valid(bins: DataFrame, k: int, how: str = "mean", value: str = "log2_ratio",
                  out: str = "smoothed") -> DataFrame:
    """Mean or median of the k nearest valid bins, the left one winning ties; masked bins are filled too.

    The k valid bins before a bin and the k after it are plain columns, each in order of distance. So the j-th of one side
    is among the k nearest exactly when the one that it would displace on the other side is farther: no list, no sort.
    """
    valid = F.col(value).isNotNull()
    # A masked bin has places for k neighbours, a valid one (it is its own nearest) for k - 1.
    df = bins.withColumn("_it", F.when(valid, F.struct(F.col("bin").alias("b"), F.col(value).alias("v"))))
    df = df.select(*df.columns, *[_shifted(way, "_it", j, "IGNORE").alias(f"_{way}{j}")
                                  for way in ("lag", "lead") for j in range(1, k + 1)])

    def distance(way: str, j: int) -> Column:
        return F.abs(F.col(f"_{way}{j}.b") - F.col("bin"))

    def beats(way: str, j: int, places: int) -> Column:
        """Whether the j-th on this side takes one of the places."""
        rival = places - j + 1
        if rival < 1:
            return F.lit(False)
        other = distance("lead" if way == "lag" else "lag", rival)
        mine = distance(way, j)
        return other.isNull() | (mine <= other if way == "lag" else mine < other)

    taken = [F.when(valid, F.col(value))]
    for way in ("lag", "lead"):
        taken += [F.when(F.when(valid, beats(way, j, k - 1)).otherwise(beats(way, j, k)), F.col(f"_{way}{j}.v"))
                  for j in range(1, k + 1)]
    # The conditions are long, so they are put into one list once: written out for each sum they make a method too long to compile.
    df = df.select(*bins.columns, F.array_compact(F.array(*taken)).alias("_near"))
    near, n = F.col("_near"), F.size("_near")
    if how == "mean":
        stat = reduce(add, [F.coalesce(F.get(near, F.lit(j)), F.lit(0.0)) for j in range(k)]) / n
    else:
        df = df.withColumn("_near", F.sort_array(near))
        stat = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(out, F.when(n > 0, stat)).drop("_near")


def bilateral(bins: DataFrame, width: int, value: str = "log2_ratio", out: str = "smoothed",
              sigma: float | None = None, sigma_range: float | None = None) -> DataFrame:
    """Average of a window weighted by distance and by difference in value; masked bins stay masked.

    The value scale is 1.5 MAD of the track (0.2 if that is 0) unless given.
    """
    half = width // 2
    s = sigma if sigma is not None else max(1e-6, half / 2.0)
    df = bins
    if sigma_range is None:
        med = F.percentile(value, F.lit(0.5)).over(by_track())
        df = df.withColumn("_med", med)
        df = df.withColumn("_mad", F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).over(by_track()))
        df = df.withColumn("_sr", F.when(F.col("_mad") > 0, F.col("_mad") * 1.5).otherwise(0.2)).drop("_med", "_mad")
    else:
        df = df.withColumn("_sr", F.lit(max(1e-6, float(sigma_range))))
    # Bins of a track are distinct, so a bin within reach is at most half rows away.
    sides = [(way, j) for way in ("lag", "lead") for j in range(1, half + 1)]
    df = df.withColumn("_it", F.struct(F.col("bin").alias("b"), F.col(value).alias("v")))
    df = df.select(*df.columns, *[_shifted(way, "_it", j).alias(f"_{way}{j}") for way, j in sides])

    def weight(x: str) -> Column:
        """Weight of a neighbour; 0 beyond the window and for masked ones."""
        off = F.col(f"{x}.b") - F.col("bin")
        near, alike = off / F.lit(s), (F.col(f"{x}.v") - F.col(value)) / F.col("_sr")
        w = F.exp(F.lit(-0.5) * near * near) * F.exp(F.lit(-0.5) * alike * alike)
        return F.coalesce(F.when(F.abs(off) <= half, w), F.lit(0.0))

    weights = [(weight(f"_{way}{j}"), F.coalesce(F.col(f"_{way}{j}.v"), F.lit(0.0))) for way, j in sides]
    top = reduce(add, [w * v for w, v in weights], F.col(value))
    bottom = reduce(add, [w for w, _ in weights], F.lit(1.0))
    return df.withColumn(out, top / bottom).drop("_sr", "_it", *[f"_{way}{j}" for way, j in sides])
