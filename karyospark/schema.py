"""Data model: chromosome dimension, table schemas and the sentinels of the file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chromosome names and GRCh37 lengths.
CHROMOSOME_LENGTHS = {
    "1": 249250621, "2": 243199373, "3": 198022430, "4": 191154276, "5": 180915260, "6": 171115067,
    "7": 159138663, "8": 146364022, "9": 141213431, "10": 135534747, "11": 135006516, "12": 133851895,
    "13": 115169878, "14": 107349540, "15": 102531392, "16": 90354753, "17": 81195210, "18": 78077248,
    "19": 59128983, "20": 63025520, "21": 48129895, "22": 51304566, "X": 155270560, "Y": 59373566,
}
MT_LENGTH = 16569

AUTOSOMES = [str(i) for i in range(1, 23)]
CHROMOSOMES = AUTOSOMES + ["X", "Y"]
CHROM_NUM = {c: i + 1 for i, c in enumerate(CHROMOSOMES)}

# Number written to files for a masked or undefined log2 ratio.
MASKED_LOG2 = -10.0
LEGACY_MASKED_LOG2 = -2.0
DEFAULT_BIN_SIZE = 400_000

READS = T.StructType([
    T.StructField("sample", T.StringType()), T.StructField("chrom", T.StringType()),
    T.StructField("pos", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("mapq", T.IntegerType()), T.StructField("flag", T.IntegerType()),
])
BINS = T.StructType([
    T.StructField("sample", T.StringType()), T.StructField("chrom", T.StringType()),
    T.StructField("bin", T.LongType()), T.StructField("value", T.DoubleType()),
])
SEGMENTS = T.StructType([
    T.StructField("sample", T.StringType()), T.StructField("chrom_num", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("copy_number", T.DoubleType()),
])


def chromosome_dim(spark: SparkSession, mitochondrion: bool = False) -> DataFrame:
    """chrom, chrom_num, length; 24 (or 25) rows, so a broadcast of it is always bounded."""
    rows = [(c, CHROM_NUM[c], n) for c, n in CHROMOSOME_LENGTHS.items()]
    if mitochondrion:
        rows.append(("MT", 25, MT_LENGTH))
    return spark.createDataFrame(rows, "chrom string, chrom_num int, length bigint")


def bin_count(bin_size: int) -> int:
    """Bins of a whole genome; bounds the size of every per-bin dimension table."""
    return sum(n // bin_size for n in CHROMOSOME_LENGTHS.values())


def bin_grid(spark: SparkSession, bin_size: int) -> DataFrame:
    """chrom, bin for every full bin; a tail shorter than one bin is dropped."""
    dim = chromosome_dim(spark).filter(F.col("length") >= bin_size)
    last = F.expr(f"length div {int(bin_size)} - 1")
    return dim.select("chrom", "chrom_num", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bin"))
