"""Evaluation queries over all experiments, samples and callers at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from karyospark.functions import calls, numeric
from karyospark.operators import evaluate
from karyospark.plans.projections import add_cte, bic_bins, regions, scale_ratios, segments
from karyospark.plans.registry import query
from karyospark.plans.scalar_queries import _cn_text
from karyospark.plans.track_queries import r6

TRUTH = "clinical"

add_cte("longest", """
    SELECT experiment, sample, algorithm, chrom_num, max_by(copy_number, k) AS copy_number FROM (
      SELECT *, row_number() OVER (PARTITION BY sample, algorithm, chrom_num ORDER BY "end" - start, -start, -seg_id) AS k
      FROM segments) GROUP BY ALL""")
add_cte("truth_sex", """
    SELECT s.experiment, s.sample, CASE WHEN coalesce(y.copy_number, 0.0) < 0.45 THEN 'Female' ELSE 'Male' END AS sex
    FROM (SELECT DISTINCT experiment, sample FROM segments WHERE algorithm = 'clinical') s
    LEFT JOIN (SELECT * FROM longest WHERE algorithm = 'clinical' AND chrom_num = 24) y ON y.sample = s.sample""")
add_cte("state_share", """
    SELECT *, 1 AS one FROM (
      SELECT experiment, sample, algorithm, sex, chrom_num, sum(l) AS len,
             coalesce(sum(l) FILTER (copy_number >= e + 0.45) / CAST(nullif(sum(l), 0) AS DOUBLE), 0.0) AS gain,
             coalesce(sum(l) FILTER (copy_number <= e - 0.45) / CAST(nullif(sum(l), 0) AS DOUBLE), 0.0) AS loss,
             coalesce(sum(l) FILTER (copy_number > e - 0.45 AND copy_number < e + 0.45) / CAST(nullif(sum(l), 0) AS DOUBLE), 0.0) AS no_change
      FROM (SELECT s.*, sex, greatest("end" - start, 0) AS l,
                   CAST(CASE WHEN chrom_num = 23 THEN CASE WHEN sex = 'Female' THEN 2 ELSE 1 END
                        WHEN chrom_num = 24 THEN CASE WHEN sex = 'Female' THEN 0 ELSE 1 END ELSE 2 END AS DOUBLE) AS e
            FROM segments s JOIN truth_sex x ON x.sample = s.sample) GROUP BY ALL)""")
add_cte("dominant", """
    SELECT f.*, CASE WHEN coalesce(len, 0) = 0 THEN 'No Change' WHEN gain >= loss AND gain >= no_change THEN 'Gain'
                     WHEN loss >= no_change THEN 'Loss' ELSE 'No Change' END AS state,
           CASE WHEN coalesce(len, 0) = 0 THEN 0.0 ELSE greatest(gain, loss, no_change) END AS share
    FROM (SELECT DISTINCT s.experiment, s.sample, algorithm, sex, chrom_num FROM segments s
          JOIN truth_sex x ON x.sample = s.sample) c0
    RIGHT JOIN (SELECT a.experiment, a.sample, a.algorithm, a.sex, c.chrom_num FROM (
            SELECT DISTINCT s.experiment, s.sample, algorithm, sex FROM segments s
            JOIN truth_sex x ON x.sample = s.sample) a CROSS JOIN chromosomes c) f
      ON f.sample = c0.sample AND f.algorithm = c0.algorithm AND f.chrom_num = c0.chrom_num
    LEFT JOIN state_share p ON p.sample = f.sample AND p.algorithm = f.algorithm AND p.chrom_num = f.chrom_num""")
add_cte("judged", """
    SELECT a.*, t.state AS truth_state, t.share AS truth_share,
           CASE WHEN a.state = t.state THEN CASE WHEN t.state = 'No Change' THEN 'TN' ELSE 'TP' END
                WHEN t.state = 'No Change' THEN 'FP' ELSE 'FN' END AS result,
           CASE WHEN a.chrom_num <= 22 THEN 'Autosome' ELSE 'Gonosome' END AS chromosome_type
    FROM dominant a JOIN (SELECT * FROM dominant WHERE algorithm = 'clinical') t
      ON t.sample = a.sample AND t.chrom_num = a.chrom_num
    WHERE a.algorithm <> 'clinical' AND (a.chrom_num <= 22 OR a.sex = 'Male')""")


def _judged(spark, sf):
    return evaluate.chromosome_confusion(segments(spark, sf), TRUTH)


@query("a21_longest_segment", "SELECT sample, algorithm, chrom_num, copy_number FROM longest")
def _(spark, sf):
    return evaluate.longest_copy_number(segments(spark, sf), ["sample", "algorithm"])


@query("a22_sex_from_truth", "SELECT experiment, sample, sex FROM truth_sex")
def _(spark, sf):
    return evaluate.sex_of_samples(segments(spark, sf).filter(F.col("algorithm") == TRUTH))


@query("a23_state_shares", """
    SELECT sample, algorithm, chrom_num, round(gain, 6) AS gain, round(loss, 6) AS loss, round(no_change, 6) + 0.0 AS no_change
    FROM state_share""")
def _(spark, sf):
    seg = segments(spark, sf)
    sexed = seg.join(evaluate.sex_of_samples(seg.filter(F.col("algorithm") == TRUTH)), ["experiment", "sample"])
    call = calls.call_expected(F.col("copy_number"), calls.expected_evaluation(F.col("chrom_num"), F.col("sex")))
    df = evaluate.state_shares(sexed, call, ["sample", "algorithm"])
    return df.select("sample", "algorithm", "chrom_num", *[r6(F.col(c)).alias(c) for c in ("gain", "loss", "no_change")])


_V1 = """
    SELECT sample, algorithm, chrom_num, CASE WHEN len = 0 THEN {empty} WHEN g >= l AND g * 2 >= len - l THEN 'Gain'
           WHEN l * 2 >= len - g THEN 'Loss' ELSE 'No Change' END AS state
    FROM (SELECT f.sample, f.algorithm, f.chrom_num, coalesce(sum("end" - start), 0) AS len,
                 coalesce(sum("end" - start) FILTER (copy_number >= 2.45), 0) AS g,
                 coalesce(sum("end" - start) FILTER (copy_number <= 1.55), 0) AS l
          FROM (SELECT * FROM (SELECT DISTINCT sample, algorithm FROM segments) CROSS JOIN chromosomes) f
          LEFT JOIN segments s ON s.sample = f.sample AND s.algorithm = f.algorithm AND s.chrom_num = f.chrom_num
          GROUP BY ALL)"""


def _v1(spark, sf, empty_is_gain):
    seg = segments(spark, sf)
    shares = evaluate.state_shares(seg, calls.call_absolute(F.col("copy_number")), ["sample", "algorithm"])
    frame = evaluate.all_chromosomes(seg.select("sample", "algorithm").distinct())
    df = evaluate.dominant_state(frame.join(shares, ["sample", "algorithm", "chrom_num"], "left"), empty_is_gain)
    return df.select("sample", "algorithm", "chrom_num", "state")


@query("a24_dominant_state_v1", _V1.format(empty="'Gain'"))
def _(spark, sf):
    return _v1(spark, sf, True)


@query("a24_dominant_state_v2", _V1.format(empty="'No Change'"))
def _(spark, sf):
    return _v1(spark, sf, False)


@query("a25_chromosome_confusion", """
    SELECT sample, algorithm, chrom_num, state, round(share, 6) AS share, truth_state, round(truth_share, 6) AS truth_share, result
    FROM judged""")
def _(spark, sf):
    return _judged(spark, sf).select("sample", "algorithm", "chrom_num", "state", r6(F.col("share")).alias("share"),
                                     "truth_state", r6(F.col("truth_share")).alias("truth_share"), "result")


add_cte("metric_counts", """
    SELECT algorithm, coalesce(sample, 'ALL') AS sample, count(*) FILTER (result = 'TP') AS TP, count(*) FILTER (result = 'FP') AS FP,
           count(*) FILTER (result = 'FN') AS FN, count(*) FILTER (result = 'TN') AS TN
    FROM judged GROUP BY GROUPING SETS ((algorithm, sample), (algorithm))""")


@query("a28_a29_metric_table_with_total", """
    SELECT algorithm, sample, TP, FP, FN, TN, round(p, 6) AS "precision", round(r, 6) AS recall,
           round(coalesce(TN / nullif(TN + FP, 0), 0), 6) AS specificity,
           round(coalesce((TP + TN) / nullif(TP + TN + FP + FN, 0), 0), 6) AS accuracy,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1
    FROM (SELECT *, coalesce(TP / nullif(TP + FP, 0), 0) AS p, coalesce(TP / nullif(TP + FN, 0), 0) AS r FROM metric_counts)""")
def _(spark, sf):
    out = evaluate.metric_table(_judged(spark, sf), ["algorithm"])
    return out.select("algorithm", "sample", "TP", "FP", "FN", "TN", *[
        r6(F.col(c)).alias(c) for c in ("precision", "recall", "specificity", "accuracy", "f1")])


@query("a30_a31_confusion_pivot", """
    SELECT experiment, chromosome_type, algorithm, count(*) FILTER (result = 'TP') AS TP, count(*) FILTER (result = 'FP') AS FP,
           count(*) FILTER (result = 'FN') AS FN, count(*) FILTER (result = 'TN') AS TN FROM judged GROUP BY ALL""")
def _(spark, sf):
    return evaluate.confusion_counts(_judged(spark, sf), ["experiment", "chromosome_type", "algorithm"])


@query("a30_false_calls", """
    SELECT algorithm, sample, chrom_num, result, state, round(share, 6) AS share, truth_state
    FROM judged WHERE result IN ('FP', 'FN')""")
def _(spark, sf):
    return _judged(spark, sf).filter(F.col("result").isin("FP", "FN")).select(
        "algorithm", "sample", "chrom_num", "result", "state", r6(F.col("share")).alias("share"), "truth_state")


@query("a32_integrate_pivot", "SELECT sample, algorithm, " + ", ".join(
    f"max(copy_number) FILTER (chrom_num = {c}) AS c{c}" for c in range(1, 25)) + " FROM longest GROUP BY ALL")
def _(spark, sf):
    df = evaluate.longest_copy_number(segments(spark, sf), ["sample", "algorithm"])
    return df.withColumn("c", F.concat(F.lit("c"), "chrom_num")).groupBy("sample", "algorithm").pivot(
        "c", [f"c{c}" for c in range(1, 25)]).agg(F.max("copy_number"))


@query("a32_integrate_regions", "SELECT sample, algorithm, " + ", ".join(
    f"max(copy_number) FILTER (region = {c}) AS r{c}" for c in range(1, 101)) + " FROM region_cn GROUP BY ALL")
def _(spark, sf):
    df = evaluate.region_copy_numbers(segments(spark, sf), regions(spark, sf))
    return df.withColumn("r", F.concat(F.lit("r"), "region")).groupBy("sample", "algorithm").pivot(
        "r", [f"r{c}" for c in range(1, 101)]).agg(F.max("copy_number"))


add_cte("deviation", """
    SELECT *, CASE WHEN truth_cn <> 0 THEN round(deviation / truth_cn * 100, 2) END AS relative FROM (
      SELECT a.experiment, a.sample, a.algorithm, a.chrom_num, t.copy_number AS truth_cn, a.copy_number,
             CASE WHEN t.copy_number > e THEN a.copy_number - t.copy_number ELSE t.copy_number - a.copy_number END AS deviation
      FROM (SELECT l.*, sex, CAST(CASE WHEN chrom_num = 23 THEN CASE WHEN sex = 'Female' THEN 2 ELSE 1 END
                   WHEN chrom_num = 24 THEN CASE WHEN sex = 'Female' THEN 0 ELSE 1 END ELSE 2 END AS DOUBLE) AS e
            FROM longest l JOIN truth_sex x ON x.sample = l.sample) a
      JOIN (SELECT * FROM longest WHERE algorithm = 'clinical') t ON t.sample = a.sample AND t.chrom_num = a.chrom_num
      WHERE a.algorithm <> 'clinical' AND t.copy_number <> e AND (a.chrom_num <= 22 OR sex = 'Male'))""")


def _deviation(spark, sf):
    seg = segments(spark, sf)
    longest = evaluate.longest_copy_number(seg, ["experiment", "sample", "algorithm"])
    return evaluate.deviations(longest, TRUTH, evaluate.sex_of_samples(seg.filter(F.col("algorithm") == TRUTH)))


@query("a33_signed_deviation", """
    SELECT sample, algorithm, chrom_num, truth_cn, round(deviation, 6) + 0.0 AS deviation, relative + 0.0 AS relative FROM deviation""")
def _(spark, sf):
    return _deviation(spark, sf).select("sample", "algorithm", "chrom_num", "truth_cn",
                                        r6(F.col("deviation")).alias("deviation"),
                                        (F.col("relative") + F.lit(0.0)).alias("relative"))


add_cte("truth2", "SELECT *, ratio * 2.0 AS truth_cn FROM scale_ratios")
add_cte("truth_bf", """SELECT t.experiment, t.sample, t.region, ratio * copy_number AS truth_cn FROM scale_ratios t
    JOIN (SELECT * FROM region_cn WHERE algorithm = 'clinical') c USING (experiment, sample, region)""")
add_cte("region_dev", """
    SELECT *, CASE WHEN truth_cn <> 0 THEN round(deviation / truth_cn * 100, 2) END AS relative FROM (
      SELECT c.experiment, c.sample, c.algorithm, c.region, truth_cn,
             CASE WHEN type = 'G' THEN copy_number - truth_cn ELSE truth_cn - copy_number END AS deviation
      FROM region_cn c JOIN truth_bf t USING (experiment, sample, region))""")


def _region_cn(spark, sf):
    return evaluate.region_copy_numbers(segments(spark, sf), regions(spark, sf))


def _region_dev(spark, sf):
    return evaluate.region_deviations_measured(_region_cn(spark, sf), scale_ratios(spark, sf), TRUTH)


@query("a35_truth_flat", "SELECT experiment, sample, region, round(truth_cn, 6) AS truth_cn FROM truth2")
def _(spark, sf):
    df = evaluate.truth_flat(scale_ratios(spark, sf))
    return df.select("experiment", "sample", "region", r6(F.col("truth_cn")).alias("truth_cn"))


@query("a36_truth_measured", "SELECT experiment, sample, region, round(truth_cn, 6) AS truth_cn FROM truth_bf")
def _(spark, sf):
    df = evaluate.truth_measured(scale_ratios(spark, sf), _region_cn(spark, sf).filter(F.col("algorithm") == TRUTH))
    return df.select("experiment", "sample", "region", r6(F.col("truth_cn")).alias("truth_cn"))


@query("a34_region_deviation_flat_truth", """
    SELECT c.experiment, c.sample, c.algorithm, c.region, round(CASE WHEN type = 'G' THEN copy_number - truth_cn
           ELSE truth_cn - copy_number END, 6) + 0.0 AS deviation FROM region_cn c JOIN truth2 t USING (experiment, sample, region)""")
def _(spark, sf):
    df = evaluate.region_deviations(_region_cn(spark, sf), evaluate.truth_flat(scale_ratios(spark, sf)))
    return df.select("experiment", "sample", "algorithm", "region", r6(F.col("deviation")).alias("deviation"))


@query("a34_region_deviation", """
    SELECT experiment, sample, algorithm, region, round(deviation, 6) + 0.0 AS deviation, round(relative, 1) + 0.0 AS relative
    FROM region_dev""")
def _(spark, sf):
    return _region_dev(spark, sf).select(
        "experiment", "sample", "algorithm", "region", r6(F.col("deviation")).alias("deviation"),
        (F.round("relative", 1) + F.lit(0.0)).alias("relative"))


_TARGET = """
    SELECT experiment, chrom_num, any_value(type) AS type, min(mosaic) AS keep_ratio FROM (
      SELECT experiment, chrom_num, min_by(type, region) AS type, min_by(mosaic, region) AS mosaic
      FROM regions GROUP BY ALL) GROUP BY ALL"""
add_cte("targets", _TARGET)


def _targets(spark, sf):
    return regions(spark, sf).groupBy("experiment", "chrom_num").agg(
        F.min_by("type", "region").alias("type"), F.min_by("mosaic", "region").alias("keep_ratio"))


@query("a37_planted_truth_measured", """
    SELECT s.sample, s.seg_id, round(CASE type WHEN 'G' THEN copy_number / keep_ratio WHEN 'L' THEN copy_number * keep_ratio
           ELSE copy_number END, 6) AS truth_cn
    FROM (SELECT * FROM segments WHERE algorithm = 'clinical') s
    LEFT JOIN targets t ON t.experiment = s.experiment AND t.chrom_num = s.chrom_num""")
def _(spark, sf):
    seg = segments(spark, sf).filter(F.col("algorithm") == TRUTH)
    members = seg.select("experiment", "sample").distinct()
    df = evaluate.planted_truth(_targets(spark, sf).join(members, "experiment"), seg)
    return df.select("sample", "seg_id", r6(F.col("truth_cn")).alias("truth_cn"))


@query("a37_planted_truth_flat", """
    SELECT experiment, c.chrom_num, 1 AS start, c.length AS "end",
           round(CASE type WHEN 'G' THEN 2.0 / keep_ratio WHEN 'L' THEN 2.0 * keep_ratio ELSE 2.0 END, 6) AS truth_cn
    FROM (SELECT e.experiment, d.* FROM (SELECT DISTINCT experiment FROM regions) e
          CROSS JOIN (SELECT * FROM chromosomes WHERE chrom_num <= 22) d) c
    LEFT JOIN targets t USING (experiment, chrom_num)""")
def _(spark, sf):
    from karyospark.schema import chromosome_dim
    t = _targets(spark, sf)
    frame = t.select("experiment").distinct().withColumn("chrom_num", F.explode(F.sequence(F.lit(1), F.lit(22))))
    frame = frame.join(F.broadcast(chromosome_dim(spark)), "chrom_num").join(t, ["experiment", "chrom_num"], "left")
    df = evaluate.planted_truth(frame)
    return df.select("experiment", "chrom_num", F.lit(1).alias("start"), F.col("length").alias("end"),
                     r6(F.col("truth_cn")).alias("truth_cn"))


def _band_sql(source: str, by: str) -> str:
    ps = ", ".join(f"round(quantile_cont(deviation, {p}), 9) + 0.0 AS p{int(p * 100)}" for p in (.1, .2, .3, .4, .6, .7, .8, .9))
    return f"SELECT {by}, round(avg(deviation), 9) + 0.0 AS mean, {ps} FROM {source} WHERE deviation IS NOT NULL GROUP BY {by}"


def _bands(df, by):
    out = evaluate.bands(df, by)
    return out.select(*by, *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in out.columns if c not in by])


@query("a38_bands_real", _band_sql("deviation", "algorithm"))
def _(spark, sf):
    return _bands(_deviation(spark, sf), ["algorithm"])


@query("a38_bands_regions", _band_sql("region_dev", "algorithm, region"))
def _(spark, sf):
    return _bands(_region_dev(spark, sf), ["algorithm", "region"])


def _hist_sql(source: str, by: str) -> str:
    def c(name, cond):
        return f"round(count(*) FILTER ({cond}) * 100.0::DOUBLE / count(*), 6) AS {name}"
    return f"""SELECT {by}, {c('m10_m5', 'relative >= -10 AND relative < -5')}, {c('m5_0', 'relative >= -5 AND relative < 0')},
        {c('p0_5', 'relative >= 0 AND relative < 5')}, {c('p5_10', 'relative >= 5 AND relative <= 10')}
        FROM {source} WHERE relative IS NOT NULL GROUP BY {by}"""


def _hist(df, by):
    out = evaluate.relative_histogram(df, by)
    return out.select(*by, *[r6(F.col(c)).alias(c) for c in out.columns if c not in by])


@query("a39_relative_histogram_real", _hist_sql("deviation", "algorithm"))
def _(spark, sf):
    return _hist(_deviation(spark, sf), ["algorithm"])


@query("a39_relative_histogram_regions", _hist_sql("region_dev", "algorithm, region"))
def _(spark, sf):
    return _hist(_region_dev(spark, sf), ["algorithm", "region"])


@query("a40_mean_errors", """
    SELECT algorithm, region, round(avg(abs(deviation)), 9) AS mae, round(avg(abs(relative)), 9) AS mean_abs_relative,
           round(avg(deviation * deviation) + 1e-9, 5) AS mse FROM region_dev WHERE deviation IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    df = evaluate.mean_errors(_region_dev(spark, sf), ["algorithm", "region"])
    return df.select("algorithm", "region", F.round("mae", 9).alias("mae"),
                     F.round("mean_abs_relative", 9).alias("mean_abs_relative"), F.round(F.col("mse") + F.lit(1e-9), 5).alias("mse"))


@query("a41_squared_deviation", """
    SELECT experiment, algorithm, chrom_num, coalesce(sample, 'mean') AS sample, round(avg(sq), 9) AS squared_deviation FROM (
      SELECT l.experiment, l.algorithm, l.chrom_num, l.sample,
             pow(l.copy_number - CASE type WHEN 'G' THEN t.copy_number / keep_ratio ELSE t.copy_number * keep_ratio END, 2) AS sq
      FROM longest l JOIN targets g ON g.experiment = l.experiment AND g.chrom_num = l.chrom_num
      JOIN (SELECT * FROM longest WHERE algorithm = 'clinical') t ON t.sample = l.sample AND t.chrom_num = l.chrom_num)
    GROUP BY GROUPING SETS ((experiment, algorithm, chrom_num, sample), (experiment, algorithm, chrom_num))""")
def _(spark, sf):
    longest = evaluate.longest_copy_number(segments(spark, sf), ["experiment", "sample", "algorithm"])
    truth = longest.filter(F.col("algorithm") == TRUTH).drop("algorithm")
    targets = _targets(spark, sf).join(truth.select("experiment", "sample").distinct(), "experiment")
    planted = evaluate.planted_truth(targets, truth).filter("type IS NOT NULL").select(
        "experiment", "sample", "chrom_num", "truth_cn")
    pairs = longest.join(planted, ["experiment", "sample", "chrom_num"])
    df = evaluate.squared_deviation(pairs, ["experiment", "algorithm", "chrom_num"])
    return df.withColumn("squared_deviation", F.round("squared_deviation", 9))


def _matrix_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (sc = '{s}' AND lv = {round(c * 10)}) AS \"{s}_CN{round(c * 10)}\""
                     for s in calls.SIZE_CLASSES for c in calls.CN_LEVELS)
    return f"""SELECT sample, {cols} FROM (
      SELECT 'T' || tag AS sample, CASE WHEN raw <> 'n/a' THEN CAST(round(least(greatest(round(TRY_CAST(raw AS DECIMAL(18,6)), 1), 1.0), 3.0) * 10) AS INTEGER) END AS lv,
             CASE WHEN l < 20000000 THEN '0-20M' WHEN l < 40000000 THEN '20-40M' WHEN l < 80000000 THEN '40-80M' ELSE '>80M' END AS sc
      FROM (SELECT *, ("end" - start) * 100 AS l FROM cn_text)) GROUP BY sample"""


@query("a42_size_level_matrix", _matrix_sql())
def _(spark, sf):
    df = _cn_text(spark, sf).select(F.concat(F.lit("T"), "tag").alias("sample"), "raw", F.lit(0).alias("start"),
                                    ((F.col("end") - F.col("start")) * 100).alias("end"))
    out = evaluate.size_level_matrix(df, F.col("raw"))
    return out.toDF(*[c.replace(".", "") for c in out.columns])


@query("a43_p41_chromosome_means", "SELECT *, CASE WHEN c23 BETWEEN 1.8 AND 2.2 AND c24 < 0.2 THEN 'female' "
       "WHEN c23 BETWEEN 0.8 AND 1.2 AND c24 BETWEEN 0.8 AND 1.2 THEN 'male' ELSE 'Nan' END AS sex FROM ("
       "SELECT sample, algorithm, count(*) AS segment_number, " + ", ".join(
           f"CAST(round(CAST(sum(copy_number * (\"end\" - start)) FILTER (chrom_num = {c}) / sum(\"end\" - start) "
           f"FILTER (chrom_num = {c}) AS DECIMAL(18,9)), 1) AS DOUBLE) AS c{c}" for c in range(1, 25))
       + " FROM segments WHERE \"end\" > start GROUP BY sample, algorithm)")
def _(spark, sf):
    return evaluate.chromosome_means(segments(spark, sf), ["sample", "algorithm"])


add_cte("bin_cn", """SELECT sample, chrom_num, bin, round(obs / 25.0::DOUBLE + 1, 3) AS copy_number FROM bic_bins""")


@query("a44_candidate_stats", "SELECT sample, " + ", ".join(
    f"round(max(abs(d)) FILTER ({c}), 6) AS max_{n}, round(sum(d * d) FILTER ({c}), 6) AS sum_{n}, "
    f"round(abs(avg(d) FILTER ({c})), 6) AS mean_{n}"
    for n, c in [("autosome", "chrom_num <= 22"), *[(f"chr{i}", f"chrom_num = {i}") for i in range(1, 5)]])
    + " FROM (SELECT *, copy_number - 2 AS d FROM bin_cn) GROUP BY sample")
def _(spark, sf):
    cn = bic_bins(spark, sf).withColumn("copy_number", F.round(F.col("obs") / F.lit(25.0) + 1, 3))
    df = evaluate.candidate_stats(cn)
    return df.select("sample", *[r6(F.col(c)).alias(c) for c in df.columns if c != "sample"])


@query("a47_box_inputs", """
    SELECT algorithm, round(min(relative), 2) AS low, round(quantile_cont(relative, 0.25), 6) + 0.0 AS q1,
           round(quantile_cont(relative, 0.5), 6) + 0.0 AS median, round(quantile_cont(relative, 0.75), 6) + 0.0 AS q3,
           round(max(relative), 2) AS high FROM deviation WHERE relative IS NOT NULL GROUP BY algorithm""")
def _(spark, sf):
    box, _h = evaluate.value_distribution(_deviation(spark, sf), ["algorithm"])
    return box.select("algorithm", F.round("low", 2).alias("low"), r6(F.col("q1")).alias("q1"),
                      r6(F.col("median")).alias("median"), r6(F.col("q3")).alias("q3"), F.round("high", 2).alias("high"))


@query("a47_violin_inputs", """
    SELECT algorithm, CAST(CASE WHEN relative < -50 THEN 0 WHEN relative >= 50 THEN 21
           ELSE floor((relative + 50) / 5) + 1 END AS BIGINT) AS class, count(*) AS n
    FROM deviation WHERE relative IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return evaluate.value_distribution(_deviation(spark, sf), ["algorithm"])[1]


@query("a48_o07_experiments", """
    SELECT experiment, count(DISTINCT algorithm) AS algorithms, bool_or(has) AS has_regions FROM (
      SELECT s.experiment, algorithm, r.experiment IS NOT NULL AS has
      FROM (SELECT DISTINCT experiment, algorithm FROM segments) s
      LEFT JOIN (SELECT DISTINCT experiment FROM regions) r USING (experiment)) GROUP BY experiment""")
def _(spark, sf):
    s = segments(spark, sf).select("experiment", "algorithm").distinct()
    r = regions(spark, sf).select("experiment", F.lit(True).alias("has")).distinct()
    return s.join(r, "experiment", "left").groupBy("experiment").agg(
        F.count_distinct("algorithm").alias("algorithms"), F.bool_or(F.coalesce("has", F.lit(False))).alias("has_regions"))


@query("k05_rounded_metric_rows", """
    SELECT algorithm, sample, printf('%.6f', coalesce(TP / nullif(TP + FP, 0), 0)) AS "precision" FROM metric_counts""")
def _(spark, sf):
    out = evaluate.metric_table(_judged(spark, sf), ["algorithm"])
    return out.select("algorithm", "sample", numeric.fixed_text(F.col("precision"), 6).alias("precision"))
