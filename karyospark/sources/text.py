"""Line formats: alignments, sequences, intervals, lists, validated uploads, lane files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions.chromosomes import to_number_text
from karyospark.operators.running import carry_forward


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """file, n (0-based line number in the file), value, for files of any size.

    A text scan keeps the order inside a split and knows where the split starts. Its rows are numbered where they are read; only
    the first number and the lines of each split are collected and summed over the splits before, so no line is shuffled or sorted.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("_file"), F.col("_start").alias("_at"), "_first",
                           F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    same = (F.col("file") == F.col("_file")) & (F.col("_start") == F.col("_at"))
    return raw.join(F.broadcast(splits), same).select("file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("n"), "value")


# --- alignments -------------------------------------------------------------------------------

def parse_sam(lines: DataFrame, sample: Column) -> DataFrame:
    """SAM text to reads on chr-prefixed contigs: 0-based start, end from the CIGAR operations that use the reference."""
    f = F.split("value", "\t")
    spans = F.regexp_extract_all(f[5], F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    span = F.aggregate(F.transform(spans, lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    pos = f[3].cast("bigint") - 1
    df = lines.filter(~F.col("value").startswith("@") & (F.size(f) >= 6)).select(
        sample.alias("sample"), f[2].alias("rname"), pos.alias("pos"), (pos + F.greatest(span, F.lit(1))).alias("end"),
        f[4].cast("int").alias("mapq"), f[1].cast("int").alias("flag"))
    return df.filter(F.col("rname").startswith("chr")).select(
        "sample", F.substring("rname", 4, 100).alias("chrom"), "pos", "end", "mapq", "flag")


def read_positions(spark: SparkSession, path) -> DataFrame:
    """One numeric column; a second column or text is an error."""
    return spark.read.schema("pos bigint").option("mode", "FAILFAST").option("sep", "\t").csv(path)


# --- sequences --------------------------------------------------------------------------------

def fasta_chunks(lines: DataFrame) -> DataFrame:
    """Numbered FASTA lines to chrom, offset, seq (upper case); offsets restart at each header.

    Lines are assigned to the latest header by a running header count, and offsets are differences
    of running base counts, both carried block by block.
    """
    head = F.col("value").startswith(">")
    df = lines.withColumn("is_head", F.when(head, 1).otherwise(0)).withColumn(
        "bases", F.when(head, 0).otherwise(F.length(F.trim("value"))).cast("bigint")).withColumn(
        "_block", F.floor(F.col("n") / 1_000_000))
    run = carry_forward(df, ["file"], "_block", ["n"], ["is_head", "bases"])
    heads = run.filter("is_head = 1").select(
        "file", "run_is_head", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("chrom"), F.col("run_bases").alias("_base"))
    return (run.filter("is_head = 0 AND bases > 0").join(heads, ["file", "run_is_head"])
            .select("chrom", (F.col("run_bases") - F.col("bases") - F.col("_base")).alias("offset"),
                    F.upper(F.trim("value")).alias("seq")))


def read_fasta(spark: SparkSession, path, lengths: DataFrame | None = None) -> DataFrame:
    """Reference chunks; with a length table, bases past the shorter of table and file are cut."""
    chunks = fasta_chunks(numbered_lines(spark, path))
    if lengths is None:
        return chunks
    df = chunks.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).join(F.broadcast(lengths.select("chrom", "length")), "chrom")
    left = F.col("length") - F.col("offset")
    return df.filter(left > 0).select("chrom", "offset", F.substring(F.col("seq"), F.lit(1), F.least(left, F.length("seq")).cast("int")).alias("seq"))


# --- intervals --------------------------------------------------------------------------------

def parse_bed(lines: DataFrame) -> DataFrame:
    """First three whitespace columns; short lines and empty intervals are skipped, any-case 'chr' is stripped."""
    f = F.split(F.trim("value"), r"\s+")
    df = lines.filter(F.size(f) >= 3).select(
        F.regexp_replace(f[0], "(?i)^chr", "").alias("chrom"), f[1].try_cast("bigint").alias("start"),
        f[2].try_cast("bigint").alias("end"))
    return df.filter("start IS NOT NULL AND `end` > start")


def read_bed(spark: SparkSession, path) -> DataFrame:
    """BED, plain or gzip."""
    return parse_bed(spark.read.text(path))


def parse_blacklist(lines: DataFrame, known: list[str]) -> DataFrame:
    """BED whose first three characters of the name are dropped; unknown chromosomes are ignored."""
    f = F.split(F.trim("value"), r"\s+")
    df = lines.filter(F.size(f) >= 3).select(F.substring(f[0], 4, 100).alias("chrom"), f[1].try_cast("bigint").alias("start"),
                                             f[2].try_cast("bigint").alias("end"))
    return df.filter(F.col("chrom").isin(known) & F.col("start").isNotNull() & F.col("end").isNotNull())


def parse_regions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Six columns chrom, start, end, region, type, mosaic; comments, blanks and the header are skipped.

    Returns the regions and the rows that are too short or unreadable.
    """
    text = F.trim("value")
    f = F.split(text, r"\s+")
    body = lines.filter((text != "") & ~text.startswith("#") & ~F.lower(f[0]).isin("chrom", "chromosome"))
    wide = F.size(f) >= 6
    row = body.select("value", *[
        F.when(wide, F.get(f, F.lit(i))).alias(c) for i, c in enumerate(("chrom", "start", "end", "region", "type", "mosaic"))])
    row = row.select("value", to_number_text(F.col("chrom")).alias("chrom"), F.col("start").try_cast("bigint").alias("start"),
                     F.col("end").try_cast("bigint").alias("end"), F.col("region").try_cast("int").alias("region"), F.upper("type").alias("type"),
                     F.col("mosaic").try_cast("double").alias("mosaic"))
    ok = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("region").isNotNull() & F.col("mosaic").isNotNull()
    return row.filter(ok).drop("value"), row.filter(~ok).select(F.col("value").alias("_corrupt"))


def read_pairs(spark: SparkSession, path, chrom_pattern: str) -> DataFrame:
    """Two-column start, end files (mappable stretches or gaps) in one scan; the path names the chromosome."""
    df = spark.read.schema("start bigint, end bigint").option("sep", "\t").csv(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), chrom_pattern, 1).alias("chrom"), "start", "end")


def read_normalised_bins(spark: SparkSession, path) -> DataFrame:
    """start, end, obs, expected and optionally var, with the file they come from."""
    df = spark.read.schema("start bigint, end bigint, obs bigint, expected double, var double").option("sep", "\t").csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("_file"))


# --- lists, configurations, uploads --------------------------------------------------------------

def parse_list(lines: DataFrame) -> DataFrame:
    """Trimmed names; blank lines and comments are skipped."""
    name = F.trim("value")
    return lines.filter((name != "") & ~name.startswith("#")).select(name.alias("sample"))


def parse_config(lines: DataFrame, columns: int) -> DataFrame:
    """chrom -> files of a 2, 3 or n column configuration; the first line is a title.

    A changing number of columns or a repeated chromosome is an error.
    """
    f = F.split(F.trim("value"), r"\s+")
    df = lines.filter((F.col("n") > 0) & (F.trim("value") != ""))
    ok = F.when(F.size(f) == columns, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("configuration line has another number of columns: "), "value")).cast("boolean"))
    rows = df.filter(ok).select(f[0].alias("chrom"), F.slice(f, 2, columns - 1).alias("files"))
    once = F.when(F.count("*") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("chromosome listed twice: "), F.first("chrom"))).cast("boolean"))
    return rows.groupBy("chrom").agg(F.first("files").alias("files"), once.alias("_ok")).filter("_ok").drop("_ok")


def read_configured(spark: SparkSession, config: DataFrame, schema: str) -> DataFrame:
    """All files of a configuration (a short list of chromosomes) in one scan, with their chromosome and file column (from 1).

    A file that is listed more than once gives its rows for each place.
    """
    places: dict[str, list[tuple[str, int]]] = {}
    paths = {}
    for r in config.collect():
        for k, p in enumerate(r["files"], 1):
            name = re.sub("^[a-z0-9]+:/+", "/", p)
            paths.setdefault(name, p)
            places.setdefault(name, []).append((r["chrom"], k))
    bare = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/+", "/")
    df = spark.read.schema(schema).option("sep", "\t").csv(list(paths.values())).select("*", bare.alias("_file"))
    at = F.create_map(*[x for p, found in places.items() for x in (
        F.lit(p), F.array(*[F.struct(F.lit(c).alias("chrom"), F.lit(k).alias("column")) for c, k in found]))])
    return df.withColumn("_at", F.explode(at[F.col("_file")])).select("*", "_at.chrom", "_at.column").drop("_file", "_at")


# Headers that an upload must have.
UPLOAD_SEGMENTS = ["chromosome", "start", "end", "copy_number", "confidence"]
UPLOAD_BINS = ["chromosome", "start", "end", "copy_number", "read_count", "gc_content"]


def parse_upload(lines: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and row errors (with line numbers) of a TSV upload.

    Header problems and empty files raise at once. Cells are trimmed; chromosome, start and end must
    be readable, the other columns may be blank.
    """
    first = lines.filter("n = 0").select("value").first()
    if first is None:
        raise ValueError("file is empty")
    header = [h.strip() for h in first["value"].split("\t")]
    lacking = sorted(set(required) - set(header))
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    body = lines.filter((F.col("n") > 0) & (F.trim("value") != ""))
    if body.isEmpty():
        raise ValueError("file has a header but no rows")
    f = F.split("value", "\t")
    cells = {c: F.trim(F.get(f, F.lit(header.index(c)))) for c in required}
    kinds = {"start": "bigint", "end": "bigint", "read_count": "bigint"}
    row = body.select((F.col("n") + 1).alias("line"), *[c.alias(f"_{k}") for k, c in cells.items()])
    typed = row.select("line", *[f"_{c}" for c in required], F.col("_chromosome").alias("chromosome"), *[
        F.col(f"_{c}").try_cast(kinds.get(c, "double")).alias(c) for c in required if c != "chromosome"])
    bad = [F.when(F.col(f"_{c}").isNull() | ((F.col(f"_{c}") == "") & F.lit(c in ("start", "end", "copy_number")))
                  | ((F.col(f"_{c}") != "") & F.col(c).isNull()), c) for c in required if c != "chromosome"]
    bad.insert(0, F.when(F.coalesce(F.col("_chromosome"), F.lit("")) == "", "chromosome"))
    checked = typed.withColumn("_bad", F.array_compact(F.array(*bad)))
    errors = checked.filter(F.size("_bad") > 0).select("line", F.array_join("_bad", ",").alias("columns"))
    return checked.filter(F.size("_bad") == 0).select("line", *required), errors


# --- lane files ---------------------------------------------------------------------------------

def lane_groups(files: DataFrame, lanes: int = 4) -> DataFrame:
    """Lane files by prefix: complete groups (exactly `lanes` lanes) with their output name, others rejected."""
    parts = files.select("file", F.regexp_extract("file", r"^(.+)_L(\d{3})", 1).alias("prefix"),
                         F.regexp_extract("file", r"^(.+)_L(\d{3})", 2).alias("lane")).distinct()
    group = parts.groupBy("prefix").agg((F.count("*") == lanes).alias("complete"))
    return parts.join(group, "prefix").withColumn("output", F.regexp_replace("prefix", "_[^_]*$", ""))


def merge_lanes(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """Lines of complete groups in lane and line order, spread over tasks by range; sources are kept."""
    df = lines.join(groups.filter("complete").select("file", "output", "lane"), "file")
    return df.repartitionByRange("output", "lane", "n").sortWithinPartitions("output", "lane", "n").select(
        "output", "lane", "n", "value")


def coordinate_sorted(reads: DataFrame) -> DataFrame:
    """Reads in genome order: range partitions, sorted inside, so a hot chromosome is split by position."""
    return reads.repartitionByRange("chrom_num", "pos").sortWithinPartitions("chrom_num", "pos")
