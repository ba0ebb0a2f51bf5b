"""Reads to bins: counts, frequencies, proportions, sex."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.schema import AUTOSOMES, CHROMOSOME_LENGTHS
from karyospark.session import spread


def by_sample():
    return Window.partitionBy("sample")


def by_track():
    return Window.partitionBy("sample", "chrom")


XY_MALE = 0.1
#: The bins that a task lists from its tracks are sorted in its memory, however few partitions the session has.
TASKS_PER_CORE = 16


def is_autosome() -> Column:
    return F.col("chrom").isin(AUTOSOMES)


def last_bins(bin_size: int) -> Column:
    """Chromosome to the number of its last full bin; chromosomes shorter than a bin have none."""
    return F.create_map(*[x for c, n in CHROMOSOME_LENGTHS.items() if n >= bin_size
                          for x in (F.lit(c), F.lit(n // bin_size - 1).cast("bigint"))])


def _counted_tracks(reads: DataFrame, bin_size: int, samples: DataFrame | None) -> DataFrame:
    """One row per (sample, chrom), partitioned by sample, with the list of its bins with reads.

    Only bins with reads are shuffled. The empty ones are listed afterwards, track by track, so the grid of all bins is never
    the side of a join.
    """
    last = F.greatest(F.expr(f"(`end` - 1) div {bin_size}"), F.expr(f"pos div {bin_size}"))
    hits = reads.select("sample", "chrom", F.explode(F.sequence(F.expr(f"pos div {bin_size}"), last)).alias("bin"))
    ends = last_bins(bin_size)
    known = F.col("sample").isNotNull() & F.col("bin").between(0, ends[F.col("chrom")])
    counts = hits.filter(known).groupBy("sample", "chrom", "bin").agg(F.count("*").alias("n"))
    who = samples if samples is not None else reads.select("sample").distinct()
    tracks = who.select("sample", F.explode(F.map_keys(ends)).alias("chrom"))
    hit = F.struct("bin", "n")
    rows = counts.select("sample", "chrom", hit.alias("hit")).unionByName(tracks.select("sample", "chrom", F.lit(None).alias("hit")))
    # A track has at most the bins of its chromosome; its own row is the one without a hit.
    return spread(rows, "sample", per_core=TASKS_PER_CORE).groupBy("sample", "chrom").agg(
        F.collect_list("hit").alias("_hits"), F.count_if(F.col("hit").isNull()).alias("_asked"),
        F.coalesce(F.sum("hit.n"), F.lit(0)).alias("_reads")).filter("_asked > 0").drop("_asked")


def _listed(tracks: DataFrame, bin_size: int, *others: str) -> DataFrame:
    """One row per bin of each track, empty bins included, with `n` and other columns of the track."""
    empty = F.array_except(F.sequence(F.lit(0).cast("bigint"), last_bins(bin_size)[F.col("chrom")]), F.col("_hits.bin"))
    bins = tracks.select("sample", "chrom", "_hits", *others, F.posexplode(F.concat(F.col("_hits.bin"), empty)).alias("_i", "bin"))
    n = F.when(F.col("_i") < F.size("_hits"), F.get("_hits", F.col("_i"))["n"]).otherwise(F.lit(0).cast("bigint"))
    return bins.select("sample", "chrom", "bin", n.alias("n"), *others)


def count_reads(reads: DataFrame, bin_size: int, samples: DataFrame | None = None) -> DataFrame:
    """Reads overlapping each bin, empty bins included; a read over an edge counts in both bins.

    Rows come partitioned by sample and ordered by (sample, chrom): windows over either need no exchange.
    """
    return _listed(_counted_tracks(reads, bin_size, samples), bin_size).sortWithinPartitions("sample", "chrom")


def proportions_and_sex(reads: DataFrame, bin_size: int, samples: DataFrame | None = None) -> DataFrame:
    """What `with_sex` of the `proportion` of `count_reads` gives, where no bin is masked or corrected.

    All sums are of counts, so they are taken over the 24 tracks of a sample before the bins are listed. Rows come partitioned by
    sample, without order.
    """
    v = F.col("_reads").cast("double")
    tracks = _counted_tracks(reads, bin_size, samples).withColumns({
        "_all": F.sum(F.when(is_autosome(), v).otherwise(0.0)).over(by_sample()),
        "_bins": last_bins(bin_size)[F.col("chrom")] + 1})

    def total(chrom: str, column: Column) -> Column:
        return F.sum(F.when(F.col("chrom") == chrom, column)).over(by_sample())

    bins = F.col("_bins")
    xy = F.when((F.col("_all") > 0) & (total("X", v) > 0) & (total("Y", bins) > 0),
                (total("Y", v) * total("X", bins)) / (total("X", v) * total("Y", bins))).otherwise(0.0)
    tracks = tracks.withColumn("xy_ratio", xy).withColumn("_rest", F.col("_all") - F.when(is_autosome(), v).otherwise(0.0))
    value = F.col("n").cast("double")
    p = F.when(F.col("_rest") > 0, value / F.col("_rest") * bin_size).otherwise(0.0)
    return (_listed(tracks, bin_size, "_rest", "xy_ratio").withColumns({"value": value, "masked": F.lit(False), "proportion": p, "sex": _sex()})
            .select("sample", "chrom", "bin", "n", "value", "masked", "proportion", "xy_ratio", "sex"))


def frequency(bins: DataFrame, bin_size: int, value: str = "value") -> DataFrame:
    """Share of the autosome total times the bin size; a sample without autosome reads drops out."""
    total = F.sum(F.when(is_autosome(), F.col(value))).over(by_sample())
    return (bins.withColumn("_total", total).filter("_total > 0")
            .withColumn("frequency", F.col(value) / F.col("_total") * bin_size).drop("_total"))


def _xy_ratio(value: str, over: Callable[[Column], Column]) -> Column:
    def total(chrom: str, column: Column) -> Column:
        return over(F.sum(F.when(F.col("chrom") == chrom, column)))

    v, one = F.col(value), F.lit(1)
    ratio = (total("Y", v) * total("X", one)) / (total("X", v) * total("Y", one))
    return F.when((total("X", v) > 0) & (total("Y", one) > 0), ratio).otherwise(0.0)


def _sex() -> Column:
    return F.when(F.col("xy_ratio") > XY_MALE, "male").otherwise("female")


def sample_sex(bins: DataFrame, value: str) -> DataFrame:
    """One row per sample: xy_ratio = mean Y over mean X (0 without X signal) and the sex it implies."""
    return bins.groupBy("sample").agg(_xy_ratio(value, lambda c: c).alias("xy_ratio")).withColumn("sex", _sex())


def with_sex(bins: DataFrame, value: str) -> DataFrame:
    """The same as columns of every bin; rows partitioned by sample need no further shuffle."""
    return bins.withColumn("xy_ratio", _xy_ratio(value, lambda c: c.over(by_sample()))).withColumn("sex", _sex())


def proportion(bins: DataFrame, bin_size: int, value: str = "value", masked: str | None = None) -> DataFrame:
    """Share of all autosome signal outside the bin's own chromosome, times the bin size.

    Masked bins count as 0. Windows over (sample) and (sample, chrom) share one shuffle, or that of `count_reads`.
    """
    v = F.when(F.col(masked), 0.0).otherwise(F.col(value)) if masked else F.col(value).cast("double")
    df = bins.withColumn("_v", v)
    df = df.withColumn("_all", F.sum(F.when(is_autosome(), F.col("_v")).otherwise(0.0)).over(by_sample()))
    df = df.withColumn("_own", F.when(is_autosome(), F.sum("_v").over(by_track())).otherwise(0.0))
    denom = F.col("_all") - F.col("_own")
    return (df.withColumn("proportion", F.when(denom > 0, F.col("_v") / denom * bin_size).otherwise(0.0))
            .drop("_v", "_all", "_own"))


def fraction_of_total(counts: DataFrame, count: str = "n") -> DataFrame:
    """Older variant: share of the whole-file total, 0 when the file is empty."""
    total = F.sum(count).over(by_sample())
    return counts.withColumn("fraction", F.coalesce(F.try_divide(F.col(count).cast("double"), total), F.lit(0.0)))


def gc_content(chunks: DataFrame, bin_size: int) -> DataFrame:
    """GC and N share per full bin of a reference given as (chrom, offset, seq) chunks.

    Chunks are cut at bin edges and only the character counts travel; GC is over non-N bases.
    """
    n = F.length("seq").cast("bigint")
    pieces = (chunks.withColumn("_n", n).filter("_n > 0")
              .withColumn("bin", F.explode(F.sequence(F.expr(f"offset div {bin_size}"),
                                                      F.expr(f"(offset + _n - 1) div {bin_size}")))))
    lo = F.greatest(F.col("offset"), F.col("bin") * bin_size)
    hi = F.least(F.col("offset") + F.col("_n"), (F.col("bin") + 1) * bin_size)
    part = F.substring(F.col("seq"), (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    per = pieces.select("chrom", "bin", (hi - lo).alias("bases"), part.alias("p"))

    def letters(chars: str) -> Column:
        return (F.col("bases") - F.length(F.translate("p", chars, ""))).cast("bigint")

    per = per.select("chrom", "bin", "bases", letters("GCgc").alias("gc_bases"), letters("Nn").alias("n_bases"))
    agg = per.groupBy("chrom", "bin").agg(*[F.sum(c).alias(c) for c in ("bases", "gc_bases", "n_bases")])
    known = bin_size - F.col("n_bases")
    return (agg.filter(F.col("bases") == bin_size)
            .select("chrom", "bin", F.when(known > 0, F.col("gc_bases") / known).otherwise(0.0).alias("gc"),
                    (F.col("n_bases") / F.lit(bin_size)).alias("n_ratio")))
