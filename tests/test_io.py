"""Readers, writers and incremental ingest on real files."""

import gzip
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from karyospark.operators import counts
from karyospark.sources import segments as seg, sinks, text
from karyospark.streaming import ingest


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    return str(path)


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 13) for i in range(4000)]
    p = put(tmp_path / "t" / "a.txt", "\n".join(lines) + "\n")
    put(tmp_path / "t" / "b.txt", "only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = text.numbered_lines(spark, str(tmp_path / "t"))
        assert spark.read.text(p).rdd.getNumPartitions() > 5
        got = [(r.n, r.value) for r in df.filter(F.col("file").endswith("a.txt")).orderBy("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(lines))


def test_fasta_offsets_and_cut(spark, tmp_path):
    p = put(tmp_path / "g.fa", ">chr1 first\nacgt\nACGTN\n\n>chr2\nGG\n")
    got = sorted((r.chrom, r.offset, r.seq) for r in text.read_fasta(spark, p).collect())
    assert got == [("chr1", 0, "ACGT"), ("chr1", 4, "ACGTN"), ("chr2", 0, "GG")]
    lengths = spark.createDataFrame([("1", 6), ("2", 50)], "chrom string, length bigint")
    cut = sorted((r.chrom, r.offset, r.seq) for r in text.read_fasta(spark, p, lengths).collect())
    assert cut == [("1", 0, "ACGT"), ("1", 4, "AC"), ("2", 0, "GG")]


def test_gc_content_over_chunk_edges(spark):
    ch = spark.createDataFrame([("1", 0, "GGCCN"), ("1", 5, "NNNNNAAG"), ("1", 13, "cg")], "chrom string, offset bigint, seq string")
    got = {r.bin: (r.gc, r.n_ratio) for r in counts.gc_content(ch, 5).collect()}
    assert got == {0: (1.0, 0.2), 1: (0.0, 1.0), 2: (0.6, 0.0)}


def test_sam(spark, tmp_path):
    p = put(tmp_path / "a.sam", "@HD\tVN:1\nr1\t0\tchr1\t101\t60\t5S10M2I3D5M\t*\t0\t0\t*\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\nr3\t16\tchrX\t1\t3\t4M\n")
    df = text.parse_sam(spark.read.text(p), F.lit("s"))
    assert sorted((r.chrom, r.pos, r.end, r.mapq, r.flag) for r in df.collect()) == [("1", 100, 118, 60, 0), ("X", 0, 4, 3, 16)]


def test_bed_gz_and_blacklist(spark, tmp_path):
    with gzip.open(tmp_path / "a.bed.gz", "wt") as f:
        f.write("chr1\t5\t9\tx\nCHRX 7 9\n2\t9\t9\nshort 3\nchr3\tq\t9\n")
    assert sorted((r.chrom, r.start, r.end) for r in text.read_bed(spark, str(tmp_path / "a.bed.gz")).collect()) == [("1", 5, 9), ("X", 7, 9)]
    lines = spark.createDataFrame([("chr1\t1\t2",), ("xxx2\t3\t4",), ("chrUn\t1\t2",)], "value string")
    assert sorted(r.chrom for r in text.parse_blacklist(lines, ["1", "2"]).collect()) == ["1", "2"]
    with pytest.raises(PySparkException):
        text.read_bed(spark, str(tmp_path / "missing.bed"))


def test_regions_and_rejects(spark):
    lines = spark.createDataFrame([(v,) for v in ("# c", "", "chrom chromStart chromEnd region type mosaic", "chrX 1 9 1 G 0.3", "3 1 2", "4 1 2 x G 0.1")], "value string")
    good, bad = text.parse_regions(lines)
    assert [tuple(r) for r in good.collect()] == [("23", 1, 9, 1, "G", 0.3)]
    assert sorted(r._corrupt for r in bad.collect()) == ["3 1 2", "4 1 2 x G 0.1"]


def test_position_list_rejects_two_columns(spark, tmp_path):
    assert text.read_positions(spark, put(tmp_path / "ok.txt", "5\n9\n")).count() == 2
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILED_READ"):
        text.read_positions(spark, put(tmp_path / "bad.txt", "5\t6\n")).collect()
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILED_READ"):
        text.read_positions(spark, put(tmp_path / "bad2.txt", "x\n")).collect()


def test_clinical_bins_skip_and_ends(spark, tmp_path):
    head = "".join(f"h\t9\t1\t{i}\n" for i in range(49))
    p = put(tmp_path / "x.xls", head + "i\t2.0\t21\t100\ni\t1.5\t21\t300\ni\t1\t25\t5\ni\t1.1\t24\t7\n")
    df = seg.end_from_next(seg.parse_clinical_bins(text.numbered_lines(spark, p)), ["file"])
    assert sorted((r.chrom_num, r.start, r.end, r.copy_number) for r in df.collect()) == [
        (21, 100, 300, 2.0), (21, 300, 48129895, 1.5), (24, 7, 59373566, 1.1)]


def test_caller_files(spark, tmp_path):
    p = put(tmp_path / "b.tsv", "chrom\tstart\tend\tlog2.copyRatio\nchrX\t1\t5\t0\nchrM\t1\t5\t0\n3\t1\t5\tNA\n")
    got = sorted((r.chrom, r.copy_number) for r in seg.read_bic_segments(spark, p).collect())
    assert got == [("23", 2.0), ("3", None)]
    p = put(tmp_path / "c.csv", "sample,chrom,loc.start,loc.end,seg.mean\ns,24,1,5,-1\n")
    assert [(r.chrom, r.copy_number) for r in seg.read_cbs_segments(spark, p).collect()] == [("24", 1.0)]
    p = put(tmp_path / "w.bed", "chr\tstart\tend\tratio\n1\t1\t5\tnan\n1\t6\t9\t0.0\n")
    assert [r.start for r in seg.read_ratio_bed(spark, p).collect()] == [6]


def test_upload_checks(spark, tmp_path):
    def lines(content):
        return text.numbered_lines(spark, put(tmp_path / f"u{abs(hash(content))}.tsv", content))

    head = "chromosome\tstart\tend\tcopy_number\tconfidence\n"
    with pytest.raises(ValueError, match="empty"):
        text.parse_upload(lines(""), text.UPLOAD_SEGMENTS)
    with pytest.raises(ValueError, match="no rows"):
        text.parse_upload(lines(head), text.UPLOAD_SEGMENTS)
    with pytest.raises(ValueError, match="confidence"):
        text.parse_upload(lines("chromosome\tstart\tend\tcopy_number\n1\t1\t2\t2\n"), text.UPLOAD_SEGMENTS)
    rows, errors = text.parse_upload(lines(head + " 1 \t1\t2\t2.0\t\nX\tq\t2\t2.0\t0.5\n\n2\t1\t2\t\t0.5\n"), text.UPLOAD_SEGMENTS)
    assert [(r.chromosome, r.start, r.confidence) for r in rows.collect()] == [("1", 1, None)]
    assert sorted((r.line, r.columns) for r in errors.collect()) == [(3, "start"), (5, "copy_number")]


def test_config_errors(spark):
    def cfg(*body):
        return spark.createDataFrame([(i, v) for i, v in enumerate(("title", *body))], "n bigint, value string")

    assert {r.chrom: r.files for r in text.parse_config(cfg("1 a b", "2 c d"), 3).collect()} == {"1": ["a", "b"], "2": ["c", "d"]}
    with pytest.raises(PySparkException):
        text.parse_config(cfg("1 a", "1 b"), 2).collect()
    with pytest.raises(PySparkException):
        text.parse_config(cfg("1 a", "2 b c"), 2).collect()


def test_lane_merge_keeps_order_and_sources(spark, tmp_path):
    for p, lanes in (("FC_A_S1", 4), ("FC_B_S2", 3)):
        for k in range(1, lanes + 1):
            put(tmp_path / "fq" / f"{p}_L00{k}.fastq", f"@{p}{k}\nACGT\n+\n!!!!\n")
    n = text.numbered_lines(spark, str(tmp_path / "fq")).withColumn("file", F.element_at(F.split("file", "/"), -1))
    groups = text.lane_groups(n.select("file"))
    out = text.merge_lanes(n, groups)
    assert [r.value for r in out.collect()] == [v for k in range(1, 5) for v in (f"@FC_A_S1{k}", "ACGT", "+", "!!!!")]
    assert {r.output for r in out.collect()} == {"FC_A"}
    assert sorted({r.prefix for r in groups.filter("NOT complete").collect()}) == ["FC_B_S2"]
    assert len(os.listdir(tmp_path / "fq")) == 7


def test_track_cache_skips_done_samples(spark, tmp_path):
    path = str(tmp_path / "cache")
    t = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "sample string, bin int, value double")
    assert sinks.pending(t, path).count() == 2
    sinks.write_tracks(t.filter("sample = 'a'"), path)
    assert [r.sample for r in sinks.pending(t, path).collect()] == ["b"]
    sinks.write_tracks(t.filter("sample = 'b'"), path)
    assert spark.read.parquet(path).count() == 2


def test_run_log_appends(spark, tmp_path):
    p = str(tmp_path / "run_time")
    for row in (("e1", 1.5), ("e2", 2.5)):
        sinks.append_run_log(spark.createDataFrame([row], "experiment string, elapsed_time double"), p)
    assert sorted(r.experiment for r in spark.read.option("header", True).option("sep", "\t").csv(p).collect()) == ["e1", "e2"]


def test_bed_bins_clamp_and_skip(spark):
    t = spark.createDataFrame([("s", "21", 0, 0.0), ("s", "21", 1, None), ("s", "21", 120, 1.0)], "sample string, chrom string, bin bigint, log2_ratio double")
    assert sorted((r.chromStart, r.chromEnd, r.copyNumber) for r in sinks.bed_bins(t).collect()) == [
        (0, 400_000, 2.0), (48_000_000, 48_129_895, 4.0)]


def test_streams_take_each_key_once(spark, tmp_path):
    up, res = tmp_path / "up", str(tmp_path / "res")
    s = "sample string, algorithm string, id bigint"
    for rows in ([("x", "cbs", 2), ("x", "cbs", 1)], [("x", "cbs", 3), ("y", "cbs", 4)]):
        spark.createDataFrame(rows, s).coalesce(1).write.mode("append").parquet(str(up))
        ingest.ingest_uploads(spark.readStream.schema(s).parquet(str(up)), res, str(tmp_path / "cp2"), ["sample", "algorithm"], "id")
    assert sorted((r["sample"], r.id) for r in spark.read.parquet(res).collect()) == [("x", 1), ("y", 4)]


def test_every_file_column_of_a_configuration_is_read(spark, tmp_path):
    for name, rows in (("a1", "1\t5\n2\t6\n"), ("b1", "3\t7\n"), ("a2", "4\t8\n"), ("both", "5\t9\n")):
        put(tmp_path / f"{name}.csv", rows)
    lines = [("chrom case control other", 0), (f"1 {tmp_path}/a1.csv file://{tmp_path}/b1.csv {tmp_path}/both.csv", 1),
             (f"2 {tmp_path}/a2.csv {tmp_path}/both.csv {tmp_path}/both.csv", 2)]
    config = text.parse_config(spark.createDataFrame(lines, "value string, n bigint"), 4)
    got = text.read_configured(spark, config, "start bigint, obs bigint").collect()
    assert sorted((r.chrom, r["column"], r.start, r.obs) for r in got) == [
        ("1", 1, 1, 5), ("1", 1, 2, 6), ("1", 2, 3, 7), ("1", 3, 5, 9), ("2", 1, 4, 8), ("2", 2, 5, 9), ("2", 3, 5, 9)]


def test_late_files_of_a_sample_are_counted(spark, tmp_path):
    src, rd = tmp_path / "late", "sample string, chrom string, pos bigint, end bigint"
    runs = [(str(tmp_path / "late-out"), str(tmp_path / "late-cp")), (str(tmp_path / "once-out"), str(tmp_path / "once-cp"))]
    for rows in ([("a", "1", 5, 6), ("a", "2", 9, 10)], [("b", "1", 6, 7)], [("a", "1", 7, 8), ("a", "X", 70_000_000, 70_000_001)]):
        spark.createDataFrame(rows, rd).coalesce(1).write.mode("append").parquet(str(src))
        ingest.ingest_counts(spark.readStream.schema(rd).parquet(str(src)), *runs[0], 50_000_000)
    ingest.ingest_counts(spark.readStream.schema(rd).option("maxFilesPerTrigger", 1).parquet(str(src)), *runs[1], 50_000_000)
    want = counts.proportion(counts.count_reads(spark.read.parquet(str(src)), 50_000_000), 50_000_000, "n")
    keys = ["sample", "chrom", "bin", "n", "proportion"]
    for out, _ in runs:
        assert spark.read.parquet(out).select("batch").distinct().count() == 3
        got = ingest.stored_proportions(spark, out, 50_000_000)
        assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, want.select(keys).collect()))
    assert sum(r.n for r in got.collect() if r["sample"] == "a") == 4


def test_line_numbers_across_splits_without_sorting_lines(spark, tmp_path):
    for f in "ab":
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}{i}\n" for i in range(3000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = text.numbered_lines(spark, str(tmp_path))
        got = sorted((r.file[-5], r.n, r.value) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == sorted((f, i, f"{f}{i}") for f in "ab" for i in range(3000))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # over the splits only


def test_a_folder_of_a_partitioned_table_is_one_file(spark, tmp_path):
    rows = spark.range(400).selectExpr("id % 3 AS experiment", "id AS v").repartition(8)
    sinks.write_delimited(rows, str(tmp_path / "out"), ["experiment"])
    assert [len(list(d.glob("part-*"))) for d in sorted((tmp_path / "out").glob("experiment=*"))] == [1, 1, 1]


def test_both_writes_of_the_cached_tracks_read_one_run_of_the_chain(spark, monkeypatch):
    from karyospark.plans.catalogue import CATALOGUE
    plans, write = [], sinks.write_tracks

    def seen(df, path):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        write(df, path)

    monkeypatch.setattr(sinks, "write_tracks", seen)
    n = CATALOGUE["k01_track_cache_and_skip"].run(spark, "/root/testdata/sf0.001").count()
    assert len(plans) == 2 and not any("Window" in p for p in plans)
    assert n > 0
