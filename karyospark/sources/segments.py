"""Segment and bin files of the different callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions.calls import copy_number
from karyospark.functions.chromosomes import to_number, to_number_text_nuclear
from karyospark.schema import CHROMOSOME_LENGTHS


def coerce_segments(df: DataFrame) -> DataFrame:
    """Text columns chrom_num, start, end, copy_number to numbers; unreadable, empty and sex-chromosome rows go."""
    out = df.withColumns({
        "chrom_num": F.col("chrom_num").try_cast("int"), "start": F.col("start").try_cast("bigint"),
        "end": F.col("end").try_cast("bigint"), "copy_number": F.col("copy_number").try_cast("double")})
    return out.na.drop(subset=["chrom_num", "start", "end", "copy_number"]).filter(
        (F.col("end") > F.col("start")) & F.col("chrom_num").between(1, 22))


def _csv(spark: SparkSession, path, sep: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def _log2_segments(df: DataFrame, chrom: str, start: str, end: str, ratio: str) -> DataFrame:
    """Canonical v1 segments from a log2-ratio file; a bad number becomes NULL."""
    return df.select(
        to_number_text_nuclear(F.col(chrom)).alias("chrom"), F.col(start).try_cast("bigint").alias("start"),
        F.col(end).try_cast("bigint").alias("end"),
        copy_number(F.col(ratio).try_cast("double")).alias("copy_number"), *_path(df)).filter("chrom IS NOT NULL")


def _path(df: DataFrame) -> list[Column]:
    return [F.col("_file")] if "_file" in df.columns else []


def with_file(df: DataFrame) -> DataFrame:
    """Keep the path of each row's file, from which sample, algorithm and experiment come."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"))


def read_clinical_segments(spark: SparkSession, path) -> DataFrame:
    """TSV with Chromosome, Start, End, Copy #; chromosomes 1..24."""
    df = with_file(_csv(spark, path, "\t"))
    return df.select(to_number(F.col("Chromosome")).alias("chrom_num"), F.col("Start").try_cast("bigint").alias("start"),
                     F.col("End").try_cast("bigint").alias("end"),
                     F.col("`Copy #`").try_cast("double").alias("copy_number"), "_file").filter("chrom_num IS NOT NULL")


def read_bic_segments(spark: SparkSession, path) -> DataFrame:
    """TSV with chrom, start, end, log2.copyRatio."""
    return _log2_segments(with_file(_csv(spark, path, "\t")), "chrom", "start", "end", "`log2.copyRatio`")


def read_cbs_segments(spark: SparkSession, path) -> DataFrame:
    """CSV with chrom, loc.start, loc.end, seg.mean."""
    return _log2_segments(with_file(_csv(spark, path, ",")), "chrom", "`loc.start`", "`loc.end`", "`seg.mean`")


def read_ratio_bed(spark: SparkSession, path, drop_missing: bool = True) -> DataFrame:
    """TSV with chr, start, end, ratio; rows without a copy number are dropped by default."""
    out = _log2_segments(with_file(_csv(spark, path, "\t")), "chr", "start", "end", "ratio")
    return out.filter("copy_number IS NOT NULL AND NOT isnan(copy_number)") if drop_missing else out


def parse_clinical_bins(lines: DataFrame, skip: int = 49) -> DataFrame:
    """Rows (file, n, value) of an export with `skip` leading lines: columns 3, 4, 2 are chrom, start, CN."""
    f = F.split("value", "\t")
    return lines.filter(F.col("n") >= skip).select(
        "file", F.get(f, F.lit(2)).try_cast("int").alias("chrom_num"),
        F.get(f, F.lit(3)).try_cast("bigint").alias("start"),
        F.get(f, F.lit(1)).try_cast("double").alias("copy_number")).filter(F.col("chrom_num").between(1, 24))


def end_from_next(bins: DataFrame, by: list[str]) -> DataFrame:
    """End of a bin is the next start on the chromosome, else the chromosome length."""
    lengths = F.create_map(*[x for i, n in enumerate(CHROMOSOME_LENGTHS.values()) for x in (F.lit(i + 1), F.lit(n))])
    order = Window.partitionBy(*by, "chrom_num").orderBy("start")
    return bins.withColumn("end", F.coalesce(
        F.lead("start").over(order), lengths[F.col("chrom_num")].cast("bigint"), F.col("start") + 1))


def read_bin_columns(spark: SparkSession, path) -> DataFrame:
    """Only CHROMOSOME and BIN COPY # of a bin table."""
    df = with_file(_csv(spark, path, "\t"))
    return df.select(F.col("CHROMOSOME").try_cast("int").alias("chrom_num"),
                     F.col("`BIN COPY #`").try_cast("double").alias("copy_number"), "_file")


def read_viewer_table(spark: SparkSession, path, keep_nan: bool = False) -> DataFrame:
    """Viewer TSV: chromosome, start, end, copy number, [type, mosaic]; malformed lines are skipped."""
    schema = "chrom string, start string, end string, copy_number string, type string, mosaic string"
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    out = df.select("chrom", F.col("start").try_cast("bigint").alias("start"),
                    F.col("end").try_cast("bigint").alias("end"),
                    F.col("copy_number").try_cast("double").alias("copy_number"), "type", "mosaic")
    out = out.filter("start IS NOT NULL AND end IS NOT NULL AND copy_number IS NOT NULL")
    return out if keep_nan else out.filter(~F.isnan("copy_number"))


def path_parts(df: DataFrame, pattern: str, names: list[str], column: str = "_file") -> DataFrame:
    """Columns from a path by a pattern with one group per name."""
    return df.withColumns({n: F.regexp_extract(column, pattern, i + 1) for i, n in enumerate(names)})
