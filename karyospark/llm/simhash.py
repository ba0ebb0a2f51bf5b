"""SimHash near-dedup by multi-index hashing.

1. `fingerprints`: each document's word shingles are hashed; a bit of its fingerprint is the majority of that bit over
   all its shingles, repeats included. Equal fingerprints are one class from then on.
2. `near_pairs`: two fingerprints that differ in at most ``distance`` bits differ in at most half of them in the upper half
   or in fewer in the lower half. So a table per half is probed with the small Hamming ball around a fingerprint's half, and what
   meets is compared whole (Norouzi, Punjani and Fleet, "Fast exact search in Hamming space with multi-index hashing", 2014). A
   pair is probed from one side only: the first flip of a ball sets a bit.
3. A key that more than ``HOT`` fingerprints share is not joined: its rows go one level down, where half of the
   bits not yet fixed join the key and the rest of the distance is split again. At 8 open bits a key has at most 256 fingerprints, so no
   key ever grows with the data and no candidate is dropped.
4. Components of the verified links, then the least id of each.

Defined results: null texts are empty ones; a text without words has fingerprint zero and links like any other; fewer words than
a shingle make one of all; a row without an id has its fingerprint, which links, and the least id that it reaches (null
if there is none); repeated rows each get a row; an empty table gives none; other columns are never read. Whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common
from karyospark.llm.components import components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Fingerprints of one key that are joined; with more the key is split. Open bits at which every key is small by nature.
HOT, LAST_BITS = 64, 8
#: For each byte its bits as eight counters of a byte: up to 255 of them add up without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes, words: int = WORDS) -> bytes:
    """XXH64 of each shingle, big-endian, one after the other; A-Z are lower-cased, ASCII white space separates."""
    parts = text.lower().split()
    if not parts:
        return b""
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_digest(joined, SEED)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begin, end = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:z], SEED) for a, z in zip(begin, end[words - 1:])])  # noqa: B905  the last shingles are shorter


def majorities(hashes: list[bytes]) -> np.ndarray:
    """The fingerprint of each list of hashes as a signed 64-bit number."""
    out = np.zeros(len(hashes), np.int64)
    for k, h in enumerate(hashes):
        rows = np.frombuffer(h, np.uint8).reshape(-1, 8)
        count = np.zeros(64, np.int64)
        for at in range(0, len(rows), 255 * 512):
            lanes = _SPREAD[rows[at:at + 255 * 512]]
            count += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
        bits = (2 * count > len(rows)).reshape(8, 8)[:, ::-1]
        out[k] = np.packbits(bits).view(">i8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, print: the fingerprint as a signed long, of every row."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.batches(it):
            prints = majorities([shingle_hashes(t, words) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], ["doc_id", "print"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, print long")


def _bits(low: int, high: int) -> int:
    """Bits low..high-1 as a signed long."""
    mask = (1 << high) - (1 << low)
    return mask - (1 << 64) if mask >> 63 else mask


def _halves(table: int) -> list[tuple[int, int, int]]:
    """(child table, first bit, bit after the last) of the upper and the lower half of a table's open bits; table 1 has all open."""
    low, high = 0, 64
    for turn in bin(table)[3:]:  # a child keeps open the half that it does not fix
        low, high = (low, (low + high) // 2) if turn == "0" else ((low + high) // 2, high)
    middle = (low + high) // 2
    return [(2 * table, middle, high), (2 * table + 1, low, middle)]


def _children(table: int, distance: int, probing: bool) -> Column:
    """For rows of one table: array of (table, key, left) of the level below."""
    made = []
    for half, (child, low, high) in enumerate(_halves(table)):
        own = F.col("key").bitwiseOR(F.col("print").bitwiseAND(F.lit(_bits(low, high))))
        same = F.array(F.struct(F.lit(child).alias("table"), own.alias("key"), F.col("left").alias("left")))
        if not probing:
            made.append(same)
            continue
        # of ``left`` differing bits the upper half has at most left // 2, or the lower half less than the others
        radius = F.floor(F.col("left") / 2) if half == 0 else F.col("left") - F.floor(F.col("left") / 2) - 1
        flips = F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
        # the first flip sets a bit, which tells the two sides of a pair apart; later ones go either way
        clear = F.filter(flips, lambda bit: (F.col("left") < distance) | (F.col("print").bitwiseAND(bit) == 0))
        ball = F.transform(clear, lambda bit: F.struct(F.lit(child).alias("table"), own.bitwiseXOR(bit).alias("key"), (F.col("left") - 1).alias("left")))  # noqa: B023
        none = F.filter(same, lambda s: F.lit(False))
        made.append(F.when(radius >= 1, F.concat(same, ball)).when(radius >= 0, same).otherwise(none))
    return F.concat(*made)


def _below(rows: DataFrame, tables: list[int], distance: int, probing: bool) -> DataFrame:
    made = F.lit(None)
    for t in tables:
        made = F.when(F.col("table") == t, _children(t, distance, probing)).otherwise(made)
    return rows.select("print", F.explode(made).alias("c")).select("print", "c.table", "c.key", "c.left")


def near_pairs(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """a, b: all pairs of different fingerprints of ``prints`` (one column, print, distinct) within ``distance`` bits, at most 3."""
    if not 0 <= distance <= 3:
        raise ValueError(f"a distance of {distance} bits")
    start = prints.select("print", F.lit(1).alias("table"), F.lit(0).cast("long").alias("key"), F.lit(distance).alias("left"))
    index, probe, tables, open_bits, found = start, start, [1], 64, []
    while True:
        index, probe = _below(index, tables, distance, False).drop("left"), _below(probe, tables, distance, True)
        tables, open_bits = [c for t in tables for c, _, _ in _halves(t)], open_bits // 2
        counts = index.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("table", "key")
        crowded = common.written(counts, "simhash-hot") if open_bits > LAST_BITS else None
        rows = crowded.count() if crowded is not None else 0
        cold = (index, probe)
        if rows:
            crowded = common.small(crowded, rows)
            cold = tuple(x.join(crowded, ["table", "key"], "left_anti") for x in cold)
        other = cold[0].withColumnRenamed("print", "other")
        differ = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
        once = (F.col("left") < distance) | (F.col("print") < F.col("other"))  # a set bit tells the sides apart, else their order does
        met = cold[1].join(other, ["table", "key"]).where(once & (differ <= distance) & (differ > 0))
        found.append(met.select(F.col("print").alias("a"), F.col("other").alias("b")))
        if not rows:
            break
        index, probe = (common.written(x.join(crowded, ["table", "key"], "left_semi"), "simhash-split") for x in (index.withColumn("left", F.lit(distance)), probe))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, print, component_id of every row."""
    prints = common.written(fingerprints(docs, words), "simhash-prints")
    classes = common.written(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    labels = components(near_pairs(classes.select("print"), distance))
    rooted = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "least_id", F.coalesce("label", "print").alias("root"))
    rooted = common.written(rooted, "simhash-rooted")
    heads = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = common.written(rooted.join(heads, "root").select("print", "component_id"), "simhash-components")
    return prints.join(ids, "print").select("doc_id", "print", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
