"""Source, sink and streaming queries: tables are written in a file format, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.plans import projections as pj
from karyospark.plans.projections import (
    READ_BIN, add_cte, reads, regions, result_segments, samples, segments, table,
)
from karyospark.plans.registry import query
from karyospark.plans.track_queries import KEY, _first, _log2, r6
from karyospark.schema import CHROMOSOMES
from karyospark.session import materialise, scratch_path, spread
from karyospark.sources import segments as seg_io
from karyospark.sources import sinks, text
from karyospark.streaming import ingest

B = READ_BIN


def _written(df, name, header=True, sep="\t", by=None):
    """Path of `df` written as delimited text in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    w = df.write.option("header", header).option("sep", sep)
    (w.partitionBy(*by) if by else w).csv(path)
    return path


def _lines(df, name):
    path = scratch_path(df.sparkSession, name)
    df.select("value").write.text(path)
    return path


def _joined(*cols):
    return F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value")


@query("s01_sam_text", """
    SELECT sample, chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum("end" - pos) AS BIGINT) AS span,
           CAST(sum(mapq) AS BIGINT) AS mapq_sum FROM reads GROUP BY ALL""")
def _(spark, sf):
    r = reads(spark, sf)
    c = F.col
    span = c("end") - c("pos")
    cigar = F.concat(F.lit("5S"), (span - 10).cast("string"), F.lit("M3I4D"), F.lit("6M"))
    rows = r.select(F.explode(F.array(
        F.struct(F.concat(F.lit("@CO\t"), c("sample")).alias("value")),
        F.struct(_joined(c("sample"), c("flag"), F.concat(F.lit("chr"), c("chrom")), c("pos") + 1, c("mapq"), cigar, F.lit("*")))
    )).alias("v")).select("v.value")
    lines = spark.read.text(_lines(rows, "sam"))
    df = text.parse_sam(lines, F.split("value", "\t")[0])
    return df.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"),
                                             F.sum(F.col("end") - F.col("pos")).alias("span"), F.sum("mapq").alias("mapq_sum"))


@query("s02_position_list", "SELECT pos, count(*) AS n FROM reads GROUP BY pos")
def _(spark, sf):
    path = _written(reads(spark, sf).select("pos"), "positions", header=False)
    return text.read_positions(spark, path).groupBy("pos").agg(F.count("*").alias("n"))


@query("s03_fasta", """
    SELECT chrom, count(*) AS chunks, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum("offset") AS BIGINT) AS offset_sum
    FROM (SELECT chrom, "offset", trim(seq) AS seq FROM fasta_rows) GROUP BY chrom""")
def _(spark, sf):
    # Files of whole documents, as many as the data asks for; letters only, so that trimming and headers are unambiguous.
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "[^a-zA-Z\n]", "N"), "\n")).alias("i", "seq"))
    rows = d.select("doc_id", "i", "seq").unionByName(
        table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("i"), F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit(" text")).alias("seq")))
    path = scratch_path(spark, "fasta")
    rows.repartition("doc_id").sortWithinPartitions("doc_id", "i").select(F.col("seq").alias("value")).write.text(path)
    df = text.read_fasta(spark, path)
    return df.groupBy("chrom").agg(F.count("*").alias("chunks"), F.sum(F.length("seq")).cast("bigint").alias("bases"),
                                   F.sum("offset").alias("offset_sum"))


add_cte("fasta_rows", """
    SELECT * FROM (SELECT 'D' || doc_id AS chrom, seq, CAST(coalesce(sum(length(seq)) OVER (PARTITION BY doc_id ORDER BY i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM (SELECT doc_id, unnest(l) AS seq, generate_subscripts(l, 1) AS i
          FROM (SELECT doc_id, string_split(regexp_replace(text, '[^a-zA-Z\\n]', 'N', 'g'), chr(10)) AS l FROM documents))) WHERE seq <> ''""")


@query("s04_bed", """SELECT chrom, start, "end" FROM regions WHERE region_key % 7 <> 3 AND "end" > start""")
def _(spark, sf):
    r = regions(spark, sf)
    k = F.col("region_key") % 7
    prefix = F.when(k == 0, "chr").when(k == 1, "CHR").when(k == 2, "Chr").otherwise("")
    line = F.when(k == 3, F.concat_ws("\t", "chrom", "start")).otherwise(
        F.concat(F.lit(" "), F.concat_ws(" \t", F.concat(prefix, "chrom"), "start", "end", "type")))
    path = scratch_path(spark, "bed")
    r.select(line.alias("value")).write.option("compression", "gzip").text(path)
    return text.read_bed(spark, path)


@query("s05_blacklist_bed", """SELECT chrom, start, "end" FROM regions WHERE region_key % 5 <> 2""")
def _(spark, sf):
    name = F.concat(F.lit("chr"), F.when(F.col("region_key") % 5 == 2, F.lit("Un_1")).otherwise(F.col("chrom")))
    path = _lines(regions(spark, sf).select(F.concat_ws("\t", name, "start", "end").alias("value")), "blacklist")
    return text.parse_blacklist(spark.read.text(path), CHROMOSOMES)


@query("s06_region_bed", """
    SELECT CAST(chrom_num AS VARCHAR) AS chrom, start, "end", region, type, mosaic FROM regions WHERE region_key % 6 > 1""")
def _(spark, sf):
    k = F.col("region_key") % 6
    kind = F.when(k % 2 == 0, F.lower("type")).otherwise(F.col("type"))  # types are read in any case
    full = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), "start", "end", "region", kind, F.format_string("%.1f", "mosaic"))
    line = F.when(k == 0, F.concat(F.lit("# "), full)).when(k == 1, F.concat_ws("\t", "chrom", "start", "end")).otherwise(full)
    path = _lines(regions(spark, sf).select(line.alias("value")), "regions")
    return text.parse_regions(spark.read.text(path))[0]


@query("s06_region_bed_rejects", """
    SELECT chrom || chr(9) || start || chr(9) || "end" AS _corrupt FROM regions WHERE region_key % 6 = 1""")
def _(spark, sf):
    k = F.col("region_key") % 6
    full = F.concat_ws("\t", "chrom", "start", "end", "region", "type", "mosaic")
    line = F.when(k == 1, F.concat_ws("\t", "chrom", "start", "end")).otherwise(full)
    path = _lines(regions(spark, sf).select(line.alias("value")), "regions")
    return text.parse_regions(spark.read.text(path))[1]


@query("s07_clinical_segments", """SELECT chrom_num, start, "end", copy_number FROM segments""")
def _(spark, sf):
    s = segments(spark, sf).select(F.col("chrom_num").alias("Chromosome"), F.col("start").alias("Start"), F.col("end").alias("End"),
                                   F.col("copy_number").alias("Copy #"), F.lit("x").alias("Note"))
    return seg_io.read_clinical_segments(spark, _written(s, "clinical")).drop("_file")


add_cte("log2_rows", """SELECT seg_id, CASE WHEN chrom_num = 23 THEN 'chrX' WHEN chrom_num = 24 THEN 'chrY' ELSE 'chr' || chrom_num END AS name,
    CAST(chrom_num AS VARCHAR) AS chrom, start, "end", CASE WHEN seg_id % 9 <> 4 THEN (seg_id % 41) / 20.0::DOUBLE - 1 END AS ratio FROM segments""")


def _log2_rows(spark, sf):
    name = F.when(F.col("chrom_num") == 23, "chrX").when(F.col("chrom_num") == 24, "chrY").otherwise(
        F.concat(F.lit("chr"), F.col("chrom_num").cast("string")))
    ratio = F.when(F.col("seg_id") % 9 == 4, "nil").otherwise(((F.col("seg_id") % 41) / F.lit(20.0) - 1).cast("string"))
    return segments(spark, sf).select(name.alias("chrom"), "start", "end", ratio.alias("ratio"))


_LOG2_SQL = """SELECT chrom, start, "end", round(pow(2.0, ratio + 1), 6) AS copy_number FROM log2_rows"""


def _rounded(df):
    return df.drop("_file").withColumn("copy_number", r6(F.col("copy_number")))


@query("s08_bic_segments", _LOG2_SQL)
def _(spark, sf):
    return _rounded(seg_io.read_bic_segments(spark, _written(_log2_rows(spark, sf).withColumnRenamed("ratio", "log2.copyRatio"), "bic")))


@query("s09_cbs_segments", _LOG2_SQL)
def _(spark, sf):
    df = _log2_rows(spark, sf).toDF("chrom", "loc.start", "loc.end", "seg.mean")
    return _rounded(seg_io.read_cbs_segments(spark, _written(df, "cbs", sep=",")))


@query("s10_ratio_bed", _LOG2_SQL + " WHERE ratio IS NOT NULL")
def _(spark, sf):
    df = _log2_rows(spark, sf).withColumnRenamed("chrom", "chr")
    return _rounded(seg_io.read_ratio_bed(spark, _written(df, "wcx")))


@query("s11_w07_clinical_bins", """
    SELECT chrom_num, start, copy_number, coalesce(lead(start) OVER (PARTITION BY chrom_num, file ORDER BY start), length) AS "end" FROM (
      SELECT DISTINCT result_id % 8 AS file, s.chrom_num, start, length, max(copy_number) AS copy_number
      FROM result_segments s JOIN chromosomes c ON c.chrom_num = s.chrom_num GROUP BY ALL)""")
def _(spark, sf):
    bins = result_segments(spark, sf).groupBy((F.col("result_id") % 8).alias("file"), "chrom_num", "start").agg(
        F.max("copy_number").alias("copy_number"))
    body = bins.select("file", (F.lit(100) + F.row_number().over(Window.partitionBy("file").orderBy("chrom_num", "start"))).alias("i"),
                       F.concat_ws("\t", F.lit("id"), "copy_number", "chrom_num", "start").alias("value"))
    head = bins.select("file").distinct().select("file", F.explode(F.sequence(F.lit(1), F.lit(49))).alias("i")).withColumn(
        "value", F.concat_ws("\t", F.lit("head"), F.lit("9"), F.lit("1"), F.col("i").cast("string")))
    path = scratch_path(spark, "export")
    body.unionByName(head).repartition(8, "file").sortWithinPartitions("file", "i").select("file", "value").write.partitionBy("file").text(path)
    df = seg_io.parse_clinical_bins(text.numbered_lines(spark, path))
    return seg_io.end_from_next(df, ["file"]).select("chrom_num", "start", "end", "copy_number")


@query("s12_bin_columns", """SELECT chrom_num, copy_number, count(*) AS n FROM result_segments GROUP BY ALL""")
def _(spark, sf):
    df = result_segments(spark, sf).select(F.col("copy_number").alias("BIN COPY #"), F.col("chrom_num").alias("CHROMOSOME"), "start", "end")
    return seg_io.read_bin_columns(spark, _written(df, "bins")).groupBy("chrom_num", "copy_number").agg(F.count("*").alias("n"))


@query("s13_viewer_table", """
    SELECT chrom, start, "end", copy_number, 'x' AS type, '30%' AS mosaic FROM result_segments WHERE line NOT IN (3, 5)""")
def _(spark, sf):
    cn = F.when(F.col("line") == 3, "nan").when(F.col("line") == 5, "oops").otherwise(F.col("copy_number").cast("string"))
    df = result_segments(spark, sf).select("chrom", "start", "end", cn.alias("Copy Number"), F.lit("x").alias("Type"), F.lit("30%").alias("M"))
    return seg_io.read_viewer_table(spark, _written(df, "viewer"))


add_cte("upload_rows", """SELECT chrom, start, "end", copy_number, line, row_number() OVER (ORDER BY result_id, line, tag, tag2) AS i,
    CASE WHEN line = 4 THEN NULL ELSE confidence END AS confidence FROM result_segments""")


def _upload(spark, sf):
    """One upload file per flow of eight, numbered in the order of the table."""
    s = result_segments(spark, sf)
    start = F.when(F.col("line") == 6, "bad").otherwise(F.col("start").cast("string"))
    conf = F.when(F.col("line") == 4, " ").otherwise(F.col("confidence").cast("string"))
    body = s.select("result_id", "line", "tag", "tag2", F.concat_ws("\t", F.concat(F.lit(" "), "chrom"), start, "end", "copy_number", conf).alias("value"))
    rows = body.repartitionByRange(8, "result_id", "line", "tag", "tag2").sortWithinPartitions("result_id", "line", "tag", "tag2").select("value")
    return _lines(rows, "upload")


@query("s14_validated_upload", """
    SELECT chrom AS chromosome, start, "end", copy_number, confidence, count(*) AS n FROM upload_rows WHERE line <> 6 GROUP BY ALL""")
def _(spark, sf):
    body = text.numbered_lines(spark, _upload(spark, sf)).withColumn("n", F.col("n") + 1)
    head = spark.createDataFrame([("", 0, "\t".join(text.UPLOAD_SEGMENTS))], "file string, n bigint, value string")
    rows, _errors = text.parse_upload(head.unionByName(body), text.UPLOAD_SEGMENTS)
    return rows.groupBy(*text.UPLOAD_SEGMENTS).agg(F.count("*").alias("n"))


@query("s14_upload_errors", "SELECT 'start' AS columns, count(*) AS n FROM upload_rows WHERE line = 6")
def _(spark, sf):
    body = text.numbered_lines(spark, _upload(spark, sf)).withColumn("n", F.col("n") + 1)
    head = spark.createDataFrame([("", 0, "\t".join(text.UPLOAD_SEGMENTS))], "file string, n bigint, value string")
    return text.parse_upload(head.unionByName(body), text.UPLOAD_SEGMENTS)[1].groupBy("columns").agg(F.count("*").alias("n"))


@query("s15_s16_start_end_pairs", """
    SELECT chrom, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS length FROM regions GROUP BY chrom""")
def _(spark, sf):
    path = _written(regions(spark, sf).select("chrom", "start", "end"), "pairs", header=False, by=["chrom"])
    df = text.read_pairs(spark, f"{path}/*/*.csv", "chrom=([^/]+)/")
    return df.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("length"))


@query("s17_s18_configured_bins", """
    SELECT chrom, count(*) AS bins, CAST(sum(obs) AS BIGINT) AS obs, round(sum(expected), 6) AS expected FROM bic_bins GROUP BY chrom""")
def _(spark, sf):
    b = pj.bic_bins(spark, sf).select("chrom", "start", "end", "obs", "expected", "var")
    path = _written(b, "norm", header=False, by=["chrom"])
    rows = text.read_normalised_bins(spark, f"{path}/chrom=*/*.csv")
    # The configuration lists the files that were written, one line per file.
    files = rows.select("_file").distinct().withColumn("chrom", F.regexp_extract("_file", "chrom=([^/]+)/", 1))
    titled = spark.createDataFrame([("title file", 0)], "value string, n bigint").unionByName(
        files.select(F.concat_ws(" ", F.concat("chrom", F.lit("/"), F.sha1("_file")), "_file").alias("value"), F.lit(1).cast("bigint").alias("n")))
    config = text.parse_config(titled, 2)
    df = text.read_configured(spark, config, "start bigint, end bigint, obs bigint, expected double, var double")
    return df.groupBy(F.split("chrom", "/")[0].alias("chrom")).agg(F.count("*").alias("bins"), F.sum("obs").alias("obs"), r6(F.sum("expected")).alias("expected"))


@query("s19_s20_path_partitioned_merge", """
    SELECT experiment, algorithm, count(*) AS n, round(sum(copy_number), 6) AS cn FROM segments GROUP BY ALL""")
def _(spark, sf):
    s = segments(spark, sf).select("experiment", "algorithm", F.col("chrom_num").alias("Chromosome"), F.col("start").alias("Start"),
                                   F.col("end").alias("End"), F.col("copy_number").alias("Copy #"))
    path = _written(spread(s, "algorithm", "experiment"), "callers", by=["algorithm", "experiment"])
    df = seg_io.read_clinical_segments(spark, f"{path}/*/*")
    df = seg_io.path_parts(df, "algorithm=([^/]+)/experiment=([^/]+)/", ["algorithm", "experiment"])
    return df.groupBy("experiment", "algorithm").agg(F.count("*").alias("n"), r6(F.sum("copy_number")).alias("cn"))


@query("s21_lane_merge", """
    SELECT output, lane, CAST(turn AS BIGINT) AS n, text AS value FROM (
      SELECT 'FC_' || (conv_id // 4) AS output, lpad(CAST(conv_id % 4 + 1 AS VARCHAR), 3, '0') AS lane, turn, replace(text, chr(10), ' ') AS text,
             conv_id // 4 AS g FROM conversations)
    WHERE g IN (SELECT conv_id // 4 FROM conversations GROUP BY 1 HAVING count(DISTINCT conv_id) = 4)""")
def _(spark, sf):
    file = F.concat(F.lit("FC_"), F.expr("conv_id div 4").cast("string"), F.lit("_S1_L"), F.lpad((F.col("conv_id") % 4 + 1).cast("string"), 3, "0"), F.lit(".fastq"))
    lines = table(spark, sf, "conversations").select(file.alias("file"), F.col("turn").alias("n"), F.regexp_replace("text", "\n", " ").alias("value"))
    return text.merge_lanes(lines, text.lane_groups(lines.select("file").distinct()))


@query("s22_sample_list", "SELECT name AS sample FROM samples WHERE id % 4 < 2")
def _(spark, sf):
    k = F.col("id") % 4
    line = F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.lit("  "), "name", F.lit(" "))).when(k == 2, "  ").otherwise(F.concat(F.lit("# "), "name"))
    return text.parse_list(spark.read.text(_lines(samples(spark, sf).select(line.alias("value")), "list")))


@query("o02_coordinate_sort", """
    SELECT chrom_num, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, true AS ordered FROM reads GROUP BY chrom_num""")
def _(spark, sf):
    df = text.coordinate_sorted(reads(spark, sf).select("chrom_num", "pos"))
    at = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    # Inside each partition neither chromosome nor position ever steps back.
    w = Window.partitionBy("_p").orderBy("_i")
    key = F.col("chrom_num").cast("bigint") * 1_000_000_000 + F.col("pos")
    ok = at.withColumn("_ok", F.coalesce(key >= F.lag(key).over(w), F.lit(True)))
    return ok.groupBy("chrom_num").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.bool_and("_ok").alias("ordered"))


@query("k01_track_cache_and_skip", """
    SELECT sample, chrom, bin, round(log2_ratio, 6) + 0.0 AS log2_ratio FROM log2_track""")
def _(spark, sf):
    path = scratch_path(spark, "tracks")
    # Both writes start from the same tracks; without the cut the whole chain would run for each.
    log2 = materialise(_log2(spark, sf).select(*KEY, "log2_ratio"), "log2")
    sinks.write_tracks(log2.filter(F.col("sample") < "S000005"), path)
    sinks.write_tracks(sinks.pending(log2, path), path)
    return spark.read.parquet(path).select(F.col("sample").cast("string").alias("sample"), "chrom", "bin", r6(F.col("log2_ratio")).alias("log2_ratio"))


@query("k02_bed_bins", f"""
    SELECT sample, CAST(t.chrom_num AS INTEGER) AS chrom, bin * {B} AS "chromStart", least((bin + 1) * {B}, length) AS "chromEnd",
           round(pow(2.0, log2_ratio + 1), 6) AS "copyNumber" FROM log2_track t JOIN chromosomes c ON c.chrom = t.chrom WHERE log2_ratio IS NOT NULL""")
def _(spark, sf):
    path = _written(sinks.bed_bins(_log2(spark, sf), B), "bedbins")
    df = spark.read.schema("sample string, chrom int, chromStart bigint, chromEnd bigint, copyNumber double").option("header", True).option("sep", "\t").csv(path)
    return df.withColumn("copyNumber", r6(F.col("copyNumber")))


@query("k03_bed_segments", """
    SELECT sample, chrom_num AS chrom, start AS "chromStart", "end" AS "chromEnd", round(pow(2.0, copy_number - 1.0), 6) AS "copyNumber" FROM segments""")
def _(spark, sf):
    df = sinks.bed_segments(segments(spark, sf).withColumn("seg_mean", F.col("copy_number") - 2.0))
    path = scratch_path(spark, "segments") + ".bed"
    sinks.write_delimited(df, path)
    back = spark.read.schema("sample string, chrom int, chromStart bigint, chromEnd bigint, copyNumber double").option("header", True).option("sep", "\t").csv(path)
    return back.withColumn("copyNumber", r6(F.col("copyNumber")))


@query("k04_evaluation_files", """
    SELECT experiment, chromosome_type, algorithm, result, count(*) AS n FROM judged GROUP BY ALL""")
def _(spark, sf):
    from karyospark.plans.evaluation_queries import _judged
    path = scratch_path(spark, "evaluation")
    sinks.write_delimited(_judged(spark, sf).select("experiment", "chromosome_type", "algorithm", "sample", "chrom_num", "result"), path,
                          ["experiment", "chromosome_type"])
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    return df.groupBy("experiment", "chromosome_type", "algorithm", "result").agg(F.count("*").alias("n"))


@query("k06_xy_report", """SELECT sample AS "Sample", printf('%.6f', xy_ratio) AS "XY_ratio", sex AS "Gender" FROM sexes""")
def _(spark, sf):
    report = sinks.xy_report(_first(spark, sf).select("sample", "xy_ratio", "sex").distinct())
    return sinks.round_trip(report, scratch_path(spark, "xy") + ".tsv")


@query("s23_run_log", """
    SELECT experiment, count(*) / 4.0::DOUBLE AS elapsed_time FROM segments GROUP BY experiment""")
def _(spark, sf):
    times = segments(spark, sf).groupBy("experiment").agg((F.count("*") / F.lit(4.0)).alias("elapsed_time"))
    path, even = scratch_path(spark, "run-log"), F.pmod(F.substring("experiment", 2, 10).cast("bigint"), F.lit(2)) == 0
    for part in (even, ~even):  # two runs append to one log
        sinks.append_run_log(times.where(part), path)
    return spark.read.schema("experiment string, elapsed_time double").option("header", True).option("sep", "\t").csv(path)


@query("w08_genome_coordinate", """
    SELECT sample, chrom, pos, pos + CAST(coalesce(sum_before, 0) AS BIGINT) AS genome_pos FROM reads JOIN (
      SELECT chrom, sum(length) OVER (ORDER BY chrom_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sum_before FROM chromosomes) USING (chrom)""")
def _(spark, sf):
    from karyospark.operators.genome import genome_position
    return genome_position(reads(spark, sf).select("sample", "chrom", "pos"), "pos").select("sample", "chrom", "pos", "genome_pos")


@query("w08_genome_coordinate_observed", """
    SELECT sample, chrom_num, seg_id, start + CAST(coalesce(sum_before, 0) AS BIGINT) AS genome_start FROM segments JOIN (
      SELECT chrom_num, sum(m) OVER (ORDER BY chrom_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sum_before
      FROM (SELECT chrom_num, max("end") AS m FROM segments GROUP BY chrom_num)) USING (chrom_num)""")
def _(spark, sf):
    from karyospark.operators.genome import observed_position
    return observed_position(segments(spark, sf), "start", "end").select("sample", "chrom_num", "seg_id", F.col("genome_pos").alias("genome_start"))


@query("w09_segment_bin_states", f"""
    SELECT sample, algorithm, chrom_num, seg_id, bin, CASE WHEN copy_number > 2.45 - sh THEN 'gain' WHEN copy_number < 1.55 - sh THEN 'loss' ELSE 'neutral' END AS state
    FROM (SELECT s.*, CASE WHEN CAST(right(sample, 1) AS INTEGER) % 2 = 1 AND s.chrom_num > 22 THEN 1.0 ELSE 0.0 END AS sh,
                 unnest(range(least(start // {B}, length // {B} - 1), least("end" // {B}, length // {B} - 1) + 1)) AS bin
          FROM segments s JOIN chromosomes c ON c.chrom_num = s.chrom_num)""")
def _(spark, sf):
    from karyospark.operators.genome import segment_bins
    sex = F.when(F.substring("sample", -1, 1).cast("int") % 2 == 1, "male").otherwise("female")
    df = segment_bins(segments(spark, sf).withColumn("sex", sex), B)
    return df.select("sample", "algorithm", "chrom_num", "seg_id", "bin", "state")


@query("t01_incremental_samples", "SELECT sample, chrom, bin, n, round(proportion, 6) AS proportion FROM shares")
def _(spark, sf):
    path, mark = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-checkpoint")
    schema = table(spark, sf, "lineitem").schema
    # The projection of a stream: the same columns as `reads`, on a file stream of line items.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/lineitem*.parquet")
    ingest.ingest_counts(pj.reads_of(stream), path, mark, B)
    df = ingest.stored_proportions(spark, path, B)
    return df.select("sample", "chrom", "bin", "n", r6(F.col("proportion")).alias("proportion"))


@query("t02_incremental_uploads", """
    SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    path, mark = scratch_path(spark, "uploads"), scratch_path(spark, "uploads-checkpoint")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    ingest.ingest_uploads(stream.select("user_id", "event_type", "event_id", "value"), path, mark, ["user_id", "event_type"], "event_id")
    return spark.read.parquet(path).select("user_id", "event_type", "event_id", "value")


@query("u01_caller_plugin", """
    SELECT sample, chrom, CAST(floor(bin / 4) AS BIGINT) AS start_bin, count(*) AS n_bins, round(avg(n), 6) AS mean FROM counted GROUP BY ALL""")
def _(spark, sf):
    from karyospark.operators import counts
    from karyospark.operators.segmentation import run_caller

    def every_four(pdf, params):
        g = pdf.assign(start_bin=pdf["bin"] // params["width"]).groupby(["sample", "chrom", "start_bin"])["n"]
        return g.agg(n_bins="size", mean="mean").reset_index()

    bins = counts.count_reads(reads(spark, sf), B)
    df = run_caller(bins, every_four, "sample string, chrom string, start_bin bigint, n_bins bigint, mean double", {"width": 4})
    return df.withColumn("mean", r6(F.col("mean")))


@query("u02_plugin_result_aberrations", """
    SELECT result_id, aberration_code, count(*) AS n FROM aberrant GROUP BY ALL""")
def _(spark, sf):
    from karyospark.operators import reports
    from karyospark.operators.genome import explode_output
    item = F.struct("chrom", "chrom_num", "start", "end", "copy_number", "confidence", "line")
    nested = result_segments(spark, sf).groupBy("result_id").agg(F.collect_list(item).alias("segments"))
    segs = explode_output(nested, "segments")
    return reports.aberrations(segs).groupBy("result_id", "aberration_code").agg(F.count("*").alias("n"))
