"""Coordinates across the genome and segments on the bin axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions.calls import call_plot
from karyospark.functions.chromosomes import to_name
from karyospark.schema import chromosome_dim


def _before(sizes: DataFrame, size: str) -> DataFrame:
    """Sum of the sizes of earlier chromosomes; at most 25 rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("chrom_num").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def genome_position(df: DataFrame, pos: str) -> DataFrame:
    """Position counted from the start of chromosome 1, by the fixed lengths."""
    dim = _before(chromosome_dim(df.sparkSession), "length").select("chrom", "_before")
    return df.join(F.broadcast(dim), "chrom").withColumn("genome_pos", F.col(pos) + F.col("_before")).drop("_before")


def observed_position(df: DataFrame, pos: str, end: str) -> DataFrame:
    """As above, with the largest end seen on each chromosome as its length."""
    sizes = df.groupBy("chrom_num").agg(F.max(end).alias("_size"))
    dim = _before(sizes, "_size").select("chrom_num", "_before")
    return df.join(F.broadcast(dim), "chrom_num").withColumn("genome_pos", F.col(pos) + F.col("_before")).drop("_before")


def segment_bins(segments: DataFrame, bin_size: int) -> DataFrame:
    """One row per bin that a segment spans, clamped to the chromosome, with its plotting state."""
    dim = chromosome_dim(segments.sparkSession).select("chrom_num", F.expr(f"length div {bin_size} - 1").alias("_last"))
    df = segments.join(F.broadcast(dim), "chrom_num")
    lo = F.least(F.floor(F.col("start") / bin_size), F.col("_last"))
    hi = F.least(F.floor(F.col("end") / bin_size), F.col("_last"))
    state = call_plot(F.col("copy_number"), to_name(F.col("chrom_num")), F.col("sex"))
    return df.withColumn("state", state).withColumn("bin", F.explode(F.sequence(lo, hi))).drop("_last")


def explode_output(results: DataFrame, column: str) -> DataFrame:
    """Rows of one nested list (segments or bins) of plug-in results."""
    return results.select("result_id", F.explode(column).alias("_x")).select("result_id", "_x.*")
