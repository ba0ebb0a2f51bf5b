"""Scalar rules, evaluation and reports on hand-made rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from karyospark.functions import calls, chromosomes, names, numeric
from karyospark.operators import evaluate, reports


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


def test_chromosome_names(spark):
    assert one(spark, "chrX", chromosomes.to_number_text) == "23"
    assert one(spark, "chrMT", chromosomes.to_number_text_nuclear) is None
    assert one(spark, "Y", chromosomes.to_number) == 24
    assert one(spark, "25", chromosomes.to_number) is None
    assert one(spark, " CHR23", chromosomes.to_known_name) == "X"
    assert one(spark, "mt", chromosomes.to_known_name) == "MT"
    with pytest.raises(PySparkException):
        one(spark, "chr99", chromosomes.to_known_name)
    assert [one(spark, c, chromosomes.sort_key) for c in ("chr2", "x", "MT", "chrUn")] == [2, 23, 25, 999]


def test_sample_names(spark):
    assert tuple(one(spark, "FC1-CY-1-A-E2_S93.bam", names.parse_strict)) == ("FC1", "CY-1-A", "E2")
    with pytest.raises(PySparkException):
        one(spark, "nodash.bam", names.parse_strict)
    assert tuple(one(spark, "E2_S1.bam", names.parse_lenient)) == ("UNKNOWN", "UNKNOWN", "E2")
    assert tuple(one(spark, "F-E2_S1", names.parse_lenient)) == ("F", "UNKNOWN", "E2")
    assert tuple(one(spark, None, names.parse_lenient)) == ("UNKNOWN", "UNKNOWN", "UNKNOWN")
    assert tuple(one(spark, "A-B", names.parse_viewer)) == ("A-B", "A-B", "A-B", "A-B-A-B")
    assert one(spark, "F-C-1-E_S93.bam", names.cycle_embryo_key) == "C-1-E"
    assert tuple(one(spark, "a_b_cbs_bins.tsv", names.file_pair_part)) == ("a_b", "cbs", "bins")
    assert one(spark, " BIC seq2", names.normalise_algorithm) == "bicseq2"
    p = one(spark, "34-GL-30", names.parse_experiment)
    assert (p.chroms, p.types, p.mosaic) == ([3, 4], ["G", "L"], "30")


def test_calls(spark):
    df = spark.createDataFrame([(0, 4_999_999, 3.0), (0, 5_000_000, 2.5), (0, 5_000_000, 2.51), (0, 6_000_000, 1.4)], "s bigint, e bigint, c double")
    assert [r.o for r in df.select(calls.call_long_segment(F.col("s"), F.col("e"), F.col("c")).alias("o")).collect()] == [None, None, "DUP", "DEL"]
    assert [one(spark, v, calls.capped_level) for v in ("2.05", "0.2", "9", "bad")] == [2.1, 1.0, 3.0, 0.0]
    assert [one(spark, v, calls.assessment) for v in ("NA5", "Class 5", "4", "3", "2", "1", "")] == [
        "artefact", "pathogenic", "probably_pathogenic", "unknown", "probably_benign", "benign", "unknown"]
    assert [one(spark, v, calls.size_class, "bigint") for v in (0, 20_000_000, 79_999_999, 80_000_000)] == ["0-20M", "20-40M", "40-80M", ">80M"]


def test_numeric_edges(spark):
    assert one(spark, None, lambda c: numeric.fixed_text(c, 4), "double") is None
    assert one(spark, "12.5%", numeric.percent_number) == 12.5
    with pytest.raises(PySparkException):
        one(spark, "hg18", lambda c: numeric.one_of(c, ["hg19", "hg38"], "hg19"))
    assert one(spark, None, lambda c: numeric.one_of(c, ["hg19", "hg38"], "hg19")) == "hg19"


SEG = "experiment string, sample string, algorithm string, chrom_num int, seg_id bigint, start bigint, end bigint, copy_number double"


def test_longest_takes_first_of_equals_and_sex(spark):
    rows = [("e", "s", "t", 1, 1, 50, 100, 3.0), ("e", "s", "t", 1, 2, 0, 50, 1.0), ("e", "s", "t", 24, 3, 0, 50, 1.0), ("e", "f", "t", 1, 4, 0, 5, 2.0)]
    df = spark.createDataFrame(rows, SEG)
    assert {(r["sample"], r.chrom_num): r.copy_number for r in evaluate.longest_copy_number(df, ["sample"]).collect()}["s", 1] == 1.0
    assert {r["sample"]: r.sex for r in evaluate.sex_of_samples(df).collect()} == {"s": "Male", "f": "Female"}


def test_dominant_state_ties_and_empty(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.0, 10), (0.0, 0.5, 0.5, 10), (None, None, None, None)], "gain double, loss double, no_change double, length bigint")
    assert [r.state for r in evaluate.dominant_state(df).collect()] == ["Gain", "Loss", "No Change"]
    assert [r.state for r in evaluate.dominant_state(df, True).collect()][2] == "Gain"


def test_confusion_counts_all_chromosomes(spark):
    rows = [("e", "s", "t", 24, 0, 0, 10, 1.0), ("e", "s", "c", 1, 1, 0, 10, 3.0), ("e", "s", "t", 2, 2, 0, 10, 3.0), ("e", "s", "t", 3, 3, 0, 10, 1.0),
            ("e", "s", "c", 3, 4, 0, 10, 1.0)]
    j = evaluate.chromosome_confusion(spark.createDataFrame(rows, SEG), "t")
    assert j.count() == 24
    c = evaluate.confusion_counts(j, ["algorithm"]).first()
    assert (c.TP, c.FP, c.FN, c.TN) == (1, 1, 1, 21)
    m = {r["sample"]: r for r in evaluate.metric_table(j, ["algorithm"]).collect()}
    assert m["ALL"].recall == 0.5 and m["ALL"].precision == m["s"].precision == 0.5


def test_metrics_on_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "TP int, FP int, FN int, TN int")
    assert all(evaluate.with_metrics(df).first()[c] == 0.0 for c in ("precision", "recall", "specificity", "accuracy", "f1"))


def test_relative_is_null_for_zero_truth(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 2.0)], "d double, t double")
    assert [r.o for r in df.select(evaluate.relative(F.col("d"), F.col("t")).alias("o")).collect()] == [None, 25.0]


def test_aberrations(spark):
    s = "result_id bigint, chrom string, chrom_num int, start bigint, end bigint, copy_number double"
    rows = [(1, "1", 1, 0, 10, 2.5), (1, "1", 1, 20, 30, 2.0), (1, "Y", 24, 0, 10, 0.1), (1, "X", 23, 0, 9, 1.0), (2, "X", 23, 0, 9, 2.0)]
    got = {(r.result_id, r.chrom): (r.type, r.mosaicism, r.aberration_code) for r in reports.aberrations(spark.createDataFrame(rows, s)).collect()}
    assert got == {(1, "1"): ("gain", 0.5, "+1s"), (1, "X"): ("loss", 1.0, "-X")}


def test_containment_lookup_is_by_substring(spark):
    ids = spark.createDataFrame([("E1",), ("C-E2",), ("none",)], "id string")
    stats = spark.createDataFrame([("F-C-E12_S1.bam", 2, 0.2), ("F-C-E1", 5, 0.5), ("F-C-E2", 3, 0.3)], "stats_sample string, row_id int, ratio double")
    got = {r.id: (r.ratio, r.missing) for r in reports.lookup_by_containment(ids, stats, "row_id").collect()}
    assert got == {"E1": (0.2, False), "C-E2": (0.3, False), "none": (0.0, True)}


def test_parameters_compare_by_value(spark):
    a = '{"b":{"type":"int","default":"1","value":"2"},"a":{"type":"s","default":"","value":"x"}}'
    b = '{"a":{"type":"s","default":"","value":"x"},"b":{"type":"int","default":"1","value":"2"}}'
    p = spark.createDataFrame([(1, 7, a), (2, 7, b), (3, 8, b)], "parameter_id bigint, algorithm_id int, value string")
    assert {r.parameter_id: r.reused_id for r in reports.reuse_parameters(p, p).collect()} == {1: 1, 2: 1, 3: 3}
