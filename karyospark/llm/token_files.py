"""Token ids as Parquet files: one list column, in id order, with delta encoding, small row groups and page indexes.

Rows are dealt by ranges of ``doc_id``, so file ``block`` holds ids in ascending order and all blocks follow each
other. Each row carries its block and the number of ids before it in the block; a document's place in the whole
corpus is that number plus the totals of the blocks before, which is a sum over one small row per block. Readers
that want only counts and places read three narrow columns; readers of a few documents skip pages by the index of
``doc_id``.

Defined results: a null text is an empty one, so only the end id; null ids come first, by text hash; rows of one id
are ordered by the hash of their text and equal rows stand side by side; an empty table gives an empty file set;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karyospark.llm import common, tokens
from karyospark.session import scratch_path

FILE_SCHEMA = "doc_id long, block int, local_start long, n_tokens long, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """How files are laid out: text bytes per file, bytes of a row group and of a page, rows of a page."""

    text_bytes: int = 32 << 20
    row_group_bytes: int = 16 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2000
    dictionary: bool = False  # else DELTA_BINARY_PACKED; a dictionary suits corpora of few distinct ids
    compression: str = "snappy"  # zstd takes 5 % off delta-packed ids, and more off a dictionary's

    def options(self) -> dict[str, str]:
        return {
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": str(self.dictionary).lower(),
            "compression": self.compression,
        }


def _encode(path: str, end_id: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, start = tokens.encoder(path), 0
        end = np.array([end_id], enc.kind)
        for b in common.batches(it, 1000):
            got = enc.encode(common.texts(b.column("text")))
            n = np.array([len(x) + 1 for x in got], np.int64)
            before = np.cumsum(n) - n + start
            start += int(n.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()),
                                             pa.array(np.concatenate([end[:0], *(part for x in got for part in (x, end))]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block"), pa.array(before), pa.array(n), lists],
                                             ["doc_id", "block", "local_start", "n_tokens", "ids"])
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, layout: Layout = Layout()) -> int:
    """Write the ids of every text under ``path``; returns the number of blocks."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // layout.text_bytes))
    rows = common.in_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    dealt = rows.repartitionByRange(blocks, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    placed = dealt.select("doc_id", "text", F.spark_partition_id().alias("block"))
    writer = placed.mapInArrow(_encode(vocabulary, end_id), FILE_SCHEMA).write.mode("overwrite")
    writer.options(**layout.options()).parquet(path)
    return blocks


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def block_starts(files: DataFrame) -> DataFrame:
    """block, block_start: ids in all blocks before; reads two narrow columns. One row per block goes to the window."""
    totals = files.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("block_start"))


def _checksums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        lists = b.column("ids")
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
        sums = [zlib.crc32(ids[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("block"), b.column("local_start"), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())],
            ["doc_id", "block", "local_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str, blocks: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = read_tokens(spark, path)
    sums = files.mapInArrow(_checksums, "doc_id long, block int, local_start long, n_tokens long, ids_crc32 long")
    starts = common.small(block_starts(files), blocks)
    return sums.join(starts, "block").select(
        "doc_id", (F.col("block_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    blocks = write_tokens(common.table(spark, sf_dir, "documents"), path, tokens.vocabulary_path("byte_bpe_50k.json"))
    return digests(spark, path, blocks)
