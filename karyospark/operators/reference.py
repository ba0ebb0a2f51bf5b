"""Reference tracks over samples, ratios against them, and the aberration-aware second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyospark.operators.counts import by_sample, by_track, is_autosome
from karyospark.operators.quantiles import exact_quantiles
from karyospark.schema import bin_count

BROADCAST_ROWS = 500_000


def per_bin(dim: DataFrame, bin_size: int) -> DataFrame:
    """A per-bin dimension for joining: broadcast only if the genome cannot have more rows than the bound."""
    return F.broadcast(dim) if bin_count(bin_size) <= BROADCAST_ROWS else dim


def usable_for_reference() -> Column:
    """Autosomes from every sample, X from females, Y from males."""
    return (is_autosome() | ((F.col("chrom") == "X") & (F.col("sex") == "female"))
            | ((F.col("chrom") == "Y") & (F.col("sex") == "male")))


def reference_mean(bins: DataFrame, value: str) -> DataFrame:
    """Mean per bin of the training samples; needs a `sex` column."""
    return (bins.filter(usable_for_reference()).groupBy("chrom", "bin").agg(F.avg(value).alias("reference")))


def require_both_sexes(sex: DataFrame) -> DataFrame:
    """The sex table, or an error when it lacks females or males."""
    per = sex.groupBy("sex").agg(F.count("*").alias("k")).agg(
        F.coalesce(F.sum(F.when(F.col("sex") == "female", F.col("k"))), F.lit(0)).alias("f"),
        F.coalesce(F.sum(F.when(F.col("sex") == "male", F.col("k"))), F.lit(0)).alias("m"))
    check = F.when((F.col("f") > 0) & (F.col("m") > 0), True).otherwise(
        F.raise_error(F.format_string("both sexes are needed: %d female, %d male", "f", "m")).cast("boolean"))
    return sex.join(F.broadcast(per.select(check.alias("_ok"))), F.col("_ok")).drop("_ok")


def bin_variation(bins: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation and coefficient of variation per bin of the training samples."""
    agg = bins.filter(usable_for_reference()).groupBy("chrom", "bin").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return agg.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0))


def linear_ratio(bins: DataFrame, reference: DataFrame, bin_size: int, value: str = "proportion") -> DataFrame:
    """test / reference; 0 where the reference is 0, NULL where there is no reference."""
    joined = bins.join(per_bin(reference, bin_size), ["chrom", "bin"], "left")
    ratio = F.when(F.col("reference") > 0, F.col(value) / F.col("reference")).when(F.col("reference").isNotNull(), 0.0)
    return joined.withColumn("ratio", ratio)


def aberrant_bins(ratios: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Flag autosome bins far from 1; more than half of the usable bins flags the whole chromosome."""
    valid = F.coalesce(F.col("reference") > 0, F.lit(False))
    far = F.coalesce(F.abs(F.col("ratio") - 1.0) > threshold, F.lit(True))
    n_valid = F.sum(F.when(valid, 1).otherwise(0)).over(by_track())
    n_far = F.sum(F.when(valid & far, 1).otherwise(0)).over(by_track())
    flag = F.when(~is_autosome() | (n_valid == 0), False).when(n_far * 2 > n_valid, True).otherwise(far)
    return ratios.withColumn("aberrant", flag)


def rescale(flagged: DataFrame, value: str = "value") -> DataFrame:
    """Global scale of a sample: signal over reference on good autosome bins, 1 when undefined."""
    good = is_autosome() & (F.col("reference") > 0) & ~F.col("aberrant")
    top, bottom = F.sum(F.when(good, F.col(value))).over(by_sample()), F.sum(F.when(good, F.col("reference"))).over(by_sample())
    return flagged.withColumn("scale", F.when(bottom > 0, top / bottom).otherwise(1.0))


def adjusted_totals(scaled: DataFrame, value: str = "value") -> DataFrame:
    """Leave-one-chromosome-out totals with aberrant bins replaced by scaled reference."""
    adjusted = F.when(F.col("aberrant"), F.col("reference") * F.col("scale")).otherwise(F.col(value))
    v = F.when(is_autosome() & (adjusted >= 0), adjusted).otherwise(0.0)
    df = scaled.withColumn("_v", v)
    return df.withColumn("total", F.sum("_v").over(by_sample()) - F.sum("_v").over(by_track())).drop("_v")


def aberration_totals(ratios: DataFrame, threshold: float = 0.35, value: str = "value") -> DataFrame:
    """What `adjusted_totals` of `rescale` of `aberrant_bins` gives, by one window per track and one per sample.

    Signal and reference are never negative, so the total is linear in the scale and both are sums of the same rows. Rows come
    ordered by (sample, chrom, bin).
    """
    ref, v, track = F.col("reference"), F.col(value), by_track()
    df = ratios.withColumns({"_valid": F.coalesce(ref > 0, F.lit(False)), "_far": F.coalesce(F.abs(F.col("ratio") - 1.0) > threshold, F.lit(True))})
    df = df.sortWithinPartitions("sample", "chrom", "bin")
    valid, far = F.col("_valid"), F.col("_far")

    def over(window, column: Column, *conditions: Column) -> Column:
        for c in conditions:
            column = F.when(c, column)
        return F.coalesce(F.sum(column).over(window), F.lit(0.0))

    df = df.withColumns({"_nv": F.count_if(valid).over(track), "_nf": F.count_if(valid & far).over(track),
                         "_v": over(track, v), "_v_near": over(track, v, ~far), "_r": over(track, ref), "_r_far": over(track, ref, far)})
    none, whole = ~is_autosome() | (F.col("_nv") == 0), F.col("_nf") * 2 > F.col("_nv")
    df = df.withColumns({
        "aberrant": F.when(none, False).when(whole, True).otherwise(far),
        "_own": F.when(none, F.col("_v")).when(whole, 0.0).otherwise(F.col("_v_near")),
        "_own_r": F.when(none, 0.0).when(whole, F.col("_r")).otherwise(F.col("_r_far"))})
    flag, auto, sample = F.col("aberrant"), is_autosome(), by_sample()
    df = df.withColumns({"_top": over(sample, v, auto & valid & ~flag), "_bottom": over(sample, ref, auto & valid & ~flag),
                         "_all": over(sample, v, auto & ~flag), "_all_r": over(sample, ref, auto & flag)})
    df = df.withColumn("scale", F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).otherwise(1.0))
    own, own_r = (F.when(auto, F.col(c)).otherwise(0.0) for c in ("_own", "_own_r"))
    df = df.withColumn("total", (F.col("_all") - own) + F.col("scale") * (F.col("_all_r") - own_r))
    return df.select(*ratios.columns, "aberrant", "scale", "total")


def recomputed_log2(totals: DataFrame, bin_size: int, value: str = "value") -> DataFrame:
    """Log2 of new proportion over reference, one lower on Y, NULL where either is not positive."""
    p = F.when(F.col("total") > 0, F.col(value) / F.col("total") * bin_size)
    raw = F.when((p > 0) & (F.col("reference") > 0), F.log2(p / F.col("reference")))
    return totals.withColumn("log2_ratio", F.when(F.col("chrom") == "Y", raw - 1.0).otherwise(raw))


def control_stats(bins: DataFrame, value: str = "fraction") -> DataFrame:
    """Older variant: mean and population deviation over controls, cut to the shortest track."""
    last = bins.groupBy("chrom", "sample").agg(F.max("bin").alias("b")).groupBy("chrom").agg(F.min("b").alias("cut"))
    return (bins.join(F.broadcast(last), "chrom").filter("bin <= cut").groupBy("chrom", "bin")
            .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")))


def drop_unstable(stats: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Older variant: mean is -1 where the deviation is too large."""
    return stats.withColumn("mean", F.when(F.col("std") > threshold, -1.0).otherwise(F.col("mean")))


def legacy_log2(case: DataFrame, stats: DataFrame, bin_size: int, value: str = "fraction") -> DataFrame:
    """Older variant: log2(case / mean) where both are positive, NULL otherwise."""
    joined = case.join(per_bin(stats, bin_size), ["chrom", "bin"])
    ok = (F.col("mean") > 0) & (F.col(value) > 0)
    return joined.withColumn("log2_ratio", F.when(ok, F.log2(F.col(value) / F.col("mean"))))


def box_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    present = df.filter(F.col(value).isNotNull())
    q = exact_quantiles(present, by, value, [0.25, 0.5, 0.75])
    fence = q.select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    whisk = present.join(fence, by).groupBy(*by).agg(
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))
    return fence.join(whisk, by)
