"""The copy-ratio chain: reads to calls in one lazy plan.

Shuffles: partial counts by (sample, chrom, bin), one exchange by sample for all per-sample and
per-chromosome windows, and the reference aggregation by (chrom, bin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyospark.functions import calls
from karyospark.operators import counts, masks, reference, segmentation


def first_pass(reads: DataFrame, bin_size: int, mask: DataFrame | None = None, gc: DataFrame | None = None) -> DataFrame:
    """Counts, sex and leave-one-out proportions per bin; masked bins count as 0.

    With a ``gc`` track (chrom, bin, gc) the counts are first divided by their LOWESS expectation.
    """
    if mask is None and gc is None:
        return counts.proportions_and_sex(reads, bin_size)
    bins = counts.count_reads(reads, bin_size).withColumn("value", F.col("n").cast("double"))
    if mask is None:
        bins = bins.withColumn("masked", F.lit(False))
    else:
        flags = reference.per_bin(mask.select("chrom", "bin", "masked"), bin_size)
        bins = bins.join(flags, ["chrom", "bin"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    if gc is not None:
        bins = segmentation.gc_lowess(bins.join(reference.per_bin(gc.select("chrom", "bin", "gc"), bin_size), ["chrom", "bin"]))
    return counts.with_sex(counts.proportion(bins, bin_size, masked="masked"), "proportion")


def ratios(first: DataFrame, bin_size: int) -> DataFrame:
    """Linear ratio of every sample against the sex-aware mean of all of them."""
    return reference.linear_ratio(first, reference.reference_mean(first, "proportion"), bin_size)


def second_pass(ratio: DataFrame, bin_size: int, threshold: float = 0.35) -> DataFrame:
    """Aberration-aware log2 ratios."""
    return reference.recomputed_log2(reference.aberration_totals(ratio, threshold), bin_size)


def blacklist(first: DataFrame, base: DataFrame, bin_size: int, z: float = 3.0, share: float = 0.1) -> DataFrame:
    """Base mask, z-score outliers, most variable bins and their neighbours."""
    freq = counts.frequency(first, bin_size)
    stats = reference.bin_variation(freq, "frequency")
    joined = stats.join(base.select("chrom", "bin", "masked"), ["chrom", "bin"])
    return masks.dilate(masks.cv_mask(masks.zscore_mask(joined, limit=z), share))


def bin_calls(reads: DataFrame, bin_size: int) -> DataFrame:
    """Reads to a gain/loss call per bin."""
    first = first_pass(reads, bin_size)
    log2 = second_pass(ratios(first, bin_size), bin_size)
    cn = calls.copy_number(F.col("log2_ratio"))
    return log2.select("sample", "chrom", "bin", "sex", "log2_ratio", cn.alias("copy_number"),
                       F.when(cn.isNotNull(), calls.call_absolute(cn)).alias("call"))
