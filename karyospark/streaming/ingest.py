"""File streams of reads and uploads; read counts of a sample add up over batches, each upload key enters once.

A micro-batch writes to its own `batch` folder in overwrite mode, so a batch that is repeated
after a failure replaces itself. What is stored is the memory of the stream: no state store grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.operators import counts


def _stored(batch: DataFrame, path: str, batch_id: int, columns: list[str]) -> DataFrame | None:
    """Keys written by earlier batches."""
    spark = batch.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).filter(F.col("batch") != batch_id).select(*columns).distinct()


def _new_only(batch: DataFrame, path: str, batch_id: int, key: list[str]) -> DataFrame:
    have = _stored(batch, path, batch_id, key)
    return batch if have is None else batch.join(have, key, "left_anti")


def _run(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_counts(stream: DataFrame, path: str, checkpoint: str, bin_size: int) -> None:
    """Count the reads of each micro-batch; counts add up, so the files of a sample may come in any batches."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        counts.count_reads(batch, bin_size).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run(stream, checkpoint, handle)


def stored_proportions(spark: SparkSession, path: str, bin_size: int) -> DataFrame:
    """Counts and proportions of every sample over all batches that `ingest_counts` stored so far."""
    bins = spark.read.parquet(path).groupBy("sample", "chrom", "bin").agg(F.sum("n").alias("n"))
    return counts.proportion(bins, bin_size, "n")


def ingest_uploads(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> None:
    """Keep the first upload per key, within a batch by `order` and across batches by what is stored."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
        _new_only(first, path, batch_id, key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _run(stream, checkpoint, handle)
