"""Helpers shared by the operators: tables, folds, scratch tables, bounded broadcasts, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.session import scratch_path

#: Rows under which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch table and read again: its lineage is cut and later jobs don't repeat its work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def bounded_sample(ids: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct values of ``key``, chosen by a hash of the value: the same at each call."""
    return ids.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(rows)


def in_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after the session's Arrow batches were cut to ``rows`` rows: whole texts of 10000 rows are too much for a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; nulls are empty."""
    return [t or "" for t in column.to_pylist()]


def batches(it: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and about ``size`` bytes, so memory doesn't follow long texts."""
    for b in it:
        step = rows
        if b.num_rows and b.nbytes > size:
            step = max(1, min(rows, int(b.num_rows * size / b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def kept(docs: DataFrame, choose: Callable[[list[str]], list[bool] | np.ndarray], rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` whose text ``choose`` keeps, with all their columns; nulls are passed as empty texts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows):
            yield b.filter(pa.array(np.asarray(choose(texts(b.column("text"))), bool)))
    return in_batches(docs).mapInArrow(run, docs.schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
