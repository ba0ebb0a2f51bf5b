"""Writers: track cache, BED and TSV outputs, report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.functions.calls import copy_number
from karyospark.functions.numeric import fixed_text, unmask
from karyospark.schema import CHROM_NUM, CHROMOSOME_LENGTHS
from karyospark.session import spread

# Fixed value: bin size of the exported tracks.
EXPORT_BIN = 400_000


def write_tracks(tracks: DataFrame, path: str) -> None:
    """Bin tracks partitioned by sample; only the partitions present in `tracks` are replaced."""
    (tracks.repartition("sample").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("sample").parquet(path))


def done_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples whose track exists already; none when there is no cache yet."""
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "sample string")
    return spark.read.parquet(path).select(F.col("sample").cast("string")).distinct()


def pending(reads: DataFrame, path: str) -> DataFrame:
    """Rows of samples that still have no cached track."""
    return reads.join(done_samples(reads.sparkSession, path), "sample", "left_anti")


def bed_bins(tracks: DataFrame, bin_size: int = EXPORT_BIN) -> DataFrame:
    """Log2 tracks as bins with copy numbers; masked bins are left out, ends stop at the chromosome length."""
    length = F.create_map(*[x for c, n in CHROMOSOME_LENGTHS.items() for x in (F.lit(c), F.lit(n))])
    number = F.create_map(*[x for c, n in CHROM_NUM.items() for x in (F.lit(c), F.lit(n))])
    return tracks.filter(unmask(F.col("log2_ratio")).isNotNull()).select(
        "sample", number[F.col("chrom")].alias("chrom"), (F.col("bin") * bin_size).alias("chromStart"),
        F.least((F.col("bin") + 1) * bin_size, length[F.col("chrom")].cast("bigint")).alias("chromEnd"),
        copy_number(F.col("log2_ratio")).alias("copyNumber"))


def bed_segments(segments: DataFrame) -> DataFrame:
    """CBS segments as chrom, chromStart, chromEnd, copyNumber."""
    return segments.select("sample", F.col("chrom_num").alias("chrom"), F.col("start").alias("chromStart"),
                           F.col("end").alias("chromEnd"), copy_number(F.col("seg_mean")).alias("copyNumber"))


def write_delimited(df: DataFrame, path: str, partition_by: list[str] | None = None, sep: str | None = None) -> None:
    """Header and rows; the separator follows the suffix (.csv or tab) unless given."""
    if partition_by:  # one task writes a folder, or every task would leave a file in each
        df = spread(df, *partition_by)
    w = df.write.mode("overwrite").option("header", True).option(
        "sep", sep or ("," if path.rstrip("/").endswith(".csv") else "\t"))
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def xy_report(sex: DataFrame) -> DataFrame:
    """Sample, XY_ratio with six decimals, Gender."""
    return sex.select(F.col("sample").alias("Sample"), fixed_text(F.col("xy_ratio"), 6).alias("XY_ratio"), F.col("sex").alias("Gender"))


def append_run_log(rows: DataFrame, path: str) -> None:
    """Append experiment and elapsed_time (seconds) to the run log; a run logs a few rows."""
    rows.select("experiment", F.col("elapsed_time").cast("double")).coalesce(1).write.mode("append").option(
        "header", True).option("sep", "\t").csv(path)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """`df` written by the suffix rule and read again with its own types."""
    write_delimited(df, path)
    sep = "," if path.endswith(".csv") else "\t"
    return df.sparkSession.read.schema(df.schema).option("header", True).option("sep", sep).option("nullValue", "NULL").csv(path)
