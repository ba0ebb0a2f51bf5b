"""Bin masks; True always means drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_chrom():
    return Window.partitionBy("chrom")


def base_mask(track: DataFrame, max_n: float = 0.1, min_gc: float = 0.0) -> DataFrame:
    """Too many unknown bases or no GC."""
    return track.withColumn("masked", (F.col("n_ratio") >= max_n) | (F.col("gc") <= min_gc))


def combine_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Masked in either; bins known to one side only keep that side's flag."""
    right = b.select("chrom", "bin", F.col("masked").alias("_m"))
    return (a.select("chrom", "bin", "masked").join(right, ["chrom", "bin"], "full")
            .select("chrom", "bin", (F.coalesce("masked", F.lit(False)) | F.coalesce("_m", F.lit(False))).alias("masked")))


def zscore_mask(bins: DataFrame, value: str = "mean", limit: float = 3.0) -> DataFrame:
    """Add bins whose value is far from the unmasked bins of the chromosome."""
    kept = F.when(~F.col("masked"), F.col(value))
    mu, sd = F.avg(kept).over(by_chrom()), F.stddev_pop(kept).over(by_chrom())
    far = F.coalesce((sd > 0) & (F.abs((F.col(value) - mu) / sd) > limit), F.lit(False))
    return bins.withColumn("masked", F.col("masked") | far)


def _chrom_group() -> Column:
    return F.when(F.col("chrom").isin("X", "Y"), F.col("chrom")).otherwise("autosome")


def cv_mask(bins: DataFrame, share: float = 0.1, cv: str = "cv") -> DataFrame:
    """Add the ceil(share * n) most variable unmasked bins of the autosomes, of X and of Y."""
    df = bins.withColumn("_g", _chrom_group())
    w = Window.partitionBy("_g", "masked")
    rank = F.row_number().over(w.orderBy(F.desc(cv), "chrom", "bin"))
    worst = ~F.col("masked") & (rank <= F.ceil(F.lit(share) * F.count("*").over(w)))
    return df.withColumn("masked", F.col("masked") | worst).drop("_g")


def dilate(bins: DataFrame, k: int = 1, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Mask the k neighbours on either side of each masked bin (bins are consecutive)."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(-k, k)
    return bins.withColumn("masked", F.max("masked").over(w))


def keep_ratio_filter(bins: DataFrame, keep: float, k: int = 1) -> DataFrame:
    """Legacy filter on the CV of each chromosome, given a BED mask in `masked`.

    Drop the ceil(n(1-keep)) largest absolute z-scores, of the rest keep the ceil(n*keep) smallest
    CVs, fall back to the smallest CVs when nothing is left, then widen the dropped bins by k.
    """
    z = F.abs((F.col("cv") - F.avg("cv").over(by_chrom())) / F.when(
        F.stddev_pop("cv").over(by_chrom()) == 0, F.lit(1e-12)).otherwise(F.stddev_pop("cv").over(by_chrom())))
    n = F.count("*").over(by_chrom())
    df = bins.withColumn("_z", z).withColumn("_n", n)
    df = df.withColumn("_zr", F.row_number().over(by_chrom().orderBy(F.desc("_z"), "bin")))
    df = df.withColumn("_ok", ~F.col("masked") & (F.col("_zr") > F.ceil(F.round(F.col("_n") * (1 - keep), 9))))
    df = df.withColumn("_any", F.max("_ok").over(by_chrom()))
    df = df.withColumn("_rank", F.row_number().over(
        Window.partitionBy("chrom", F.col("_ok") | ~F.col("_any")).orderBy("cv", "bin")))
    kept = (F.col("_ok") | ~F.col("_any")) & (
        F.col("_rank") <= F.greatest(F.ceil(F.round(F.col("_n") * keep, 9)), F.lit(1)))
    return dilate(df.withColumn("masked", ~kept).drop("_z", "_n", "_zr", "_ok", "_any", "_rank"), k)


def removed_share(bins: DataFrame) -> DataFrame:
    """Per chromosome: bins, masked bins and their percentage."""
    return bins.groupBy("chrom").agg(
        F.count("*").alias("bins"), F.count_if("masked").alias("removed")).withColumn(
        "removed_percent", F.col("removed") * 100.0 / F.col("bins"))
