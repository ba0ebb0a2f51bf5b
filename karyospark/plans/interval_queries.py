"""Interval and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from karyospark.functions import calls
from karyospark.operators import evaluate, intervals
from karyospark.plans.projections import (
    READ_BIN, add_cte, bic_bins, reads, regions, scale_ratios, segments,
)
from karyospark.plans.registry import query
from karyospark.plans.track_queries import r6
from karyospark.schema import bin_grid, chromosome_dim

B = READ_BIN


add_cte("seg_state", """
    SELECT *, CASE WHEN "end" - start >= 5000000 AND copy_number < 1.5 THEN 'DEL'
                   WHEN "end" - start >= 5000000 AND copy_number > 2.5 THEN 'DUP' ELSE 'none' END AS s
    FROM segments WHERE chrom_num <= 22""")
add_cte("region_cn", """
    SELECT a.experiment, a.sample, a.algorithm, a.region, a.chrom_num, a.type, copy_number FROM (
      SELECT DISTINCT s.experiment, s.sample, s.algorithm, r.region, r.chrom_num, r.type
      FROM segments s JOIN regions r ON r.experiment = s.experiment) a
    LEFT JOIN (SELECT s.sample, s.algorithm, r.experiment, r.region,
             max_by(copy_number, (least(s."end", r."end") - greatest(s.start, r.start)) * 10000000 - seg_id) AS copy_number
      FROM segments s JOIN regions r ON s.experiment = r.experiment AND s.chrom_num = r.chrom_num
           AND s.start < r."end" AND r.start < s."end" GROUP BY ALL) b
    ON a.experiment = b.experiment AND a.sample = b.sample AND a.algorithm = b.algorithm AND a.region = b.region""")


def _dim_bins(spark):
    return chromosome_dim(spark).select("chrom", F.expr(f"length div {B}").alias("n_bins"))


@query("j02_bins_of_intervals", f"""
    SELECT DISTINCT r.chrom, bin FROM (SELECT chrom, unnest(range(start // {B}, ("end" - 1) // {B} + 1)) AS bin
      FROM regions WHERE "end" > start) r JOIN chromosomes c ON c.chrom = r.chrom AND bin < length // {B}""")
def _(spark, sf):
    iv = regions(spark, sf).select("chrom", "start", "end").join(F.broadcast(_dim_bins(spark)), "chrom")
    return intervals.bins_of_intervals(iv, B, F.col("n_bins"))


@query("j03_bins_overlapping_bed", f"""
    SELECT chrom, bin, EXISTS (SELECT 1 FROM regions r WHERE r.chrom = g.chrom AND r.start < (g.bin + 1) * {B}
                               AND r."end" > g.bin * {B}) AS touched
    FROM (SELECT chrom, unnest(range(0, length // {B})) AS bin FROM chromosomes) g""")
def _(spark, sf):
    grid = bin_grid(spark, B).select("chrom", "bin", (F.col("bin") * B).alias("start"),
                                             ((F.col("bin") + 1) * B).alias("end"))
    return intervals.touched(grid, regions(spark, sf).select("chrom", "start", "end"), ["chrom"], ["bin"])


@query("j04_same_state_fraction", """
    SELECT a.algorithm, a.seg_id, round(coalesce(sum(CASE WHEN t.seg_id IS NOT NULL THEN least(a."end", t."end") - greatest(a.start, t.start) END), 0)
           / CAST(nullif(any_value(a."end" - a.start), 0) AS DOUBLE), 6) AS share
    FROM seg_state a LEFT JOIN (SELECT * FROM seg_state WHERE algorithm = 'clinical') t
    ON a.sample = t.sample AND a.chrom_num = t.chrom_num AND a.s = t.s AND a.start < t."end" AND t.start < a."end"
    WHERE a.algorithm <> 'clinical' GROUP BY a.algorithm, a.seg_id""")
def _(spark, sf):
    df = evaluate.segment_confusion(segments(spark, sf), "clinical")
    ok = F.when(F.col("end") > F.col("start"), r6(F.col("share")))
    return df.select("algorithm", "seg_id", ok.alias("share"))


@query("a26_a27_segment_confusion", """
    SELECT algorithm, TP, FP, FN, TN, round(p, 6) AS "precision", round(r, 6) AS recall,
           round(coalesce(TN / nullif(TN + FP, 0), 0), 6) AS specificity,
           round(coalesce((TP + TN) / nullif(TP + TN + FP + FN, 0), 0), 6) AS accuracy,
           round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1
    FROM (SELECT *, coalesce(TP / nullif(TP + FP, 0), 0) AS p, coalesce(TP / nullif(TP + FN, 0), 0) AS r FROM (
      SELECT algorithm, count(*) FILTER (s <> 'none' AND sh >= 0.5) AS TP, count(*) FILTER (s <> 'none' AND sh < 0.5) AS FP,
             count(*) FILTER (s = 'none' AND sh < 0.5) AS FN, count(*) FILTER (s = 'none' AND sh >= 0.5) AS TN
      FROM (SELECT a.algorithm, a.seg_id, any_value(a.s) AS s,
            coalesce(sum(CASE WHEN t.seg_id IS NOT NULL THEN least(a."end", t."end") - greatest(a.start, t.start) END)
                     / CAST(nullif(any_value(a."end" - a.start), 0) AS DOUBLE), 0) AS sh
            FROM seg_state a LEFT JOIN (SELECT * FROM seg_state WHERE algorithm = 'clinical') t
            ON a.sample = t.sample AND a.chrom_num = t.chrom_num AND a.s = t.s
               AND a.start < t."end" AND t.start < a."end"
            WHERE a.algorithm <> 'clinical' GROUP BY a.algorithm, a.seg_id) GROUP BY algorithm))""")
def _(spark, sf):
    judged = evaluate.segment_confusion(segments(spark, sf), "clinical")
    out = evaluate.with_metrics(evaluate.confusion_counts(judged, ["algorithm"]))
    return out.select("algorithm", "TP", "FP", "FN", "TN", *[
        r6(F.col(c)).alias(c) for c in ("precision", "recall", "specificity", "accuracy", "f1")])


@query("j05_best_overlap_segment", """
    SELECT experiment, sample, algorithm, region, copy_number FROM region_cn""")
def _(spark, sf):
    df = evaluate.region_copy_numbers(segments(spark, sf), regions(spark, sf))
    return df.select("experiment", "sample", "algorithm", "region", "copy_number")


def _read_experiment(spark, sf):
    """Reads with the experiment of their sample."""
    e = F.concat(F.lit("E"), F.lpad(F.expr("sample_idx").cast("string"), 5, "0"))
    return reads(spark, sf).withColumn("experiment", e)


add_cte("read_region", """
    SELECT *, coalesce(rg, 0) AS region, CASE t WHEN 'G' THEN 2.0 + m WHEN 'L' THEN 2.0 - m ELSE 2.0 END AS cn FROM (
      SELECT x.sample, x.sample_idx, x.chrom, x.pos, x."end", x.flag, x.read_id, rw, min(r.region) AS rg, min_by(type, region) AS t,
             min_by(mosaic, region) AS m
      FROM (SELECT *, 'E' || lpad(CAST(sample_idx AS VARCHAR), 5, '0') AS experiment,
                   row_number() OVER () AS rw FROM reads) x
      LEFT JOIN regions r ON r.experiment = x.experiment AND r.chrom = x.chrom AND x.flag & 4 = 0
           AND x.pos < r."end" AND x."end" > r.start GROUP BY ALL)""")


def _read_regions(spark, sf):
    """First region, by region number, that a mapped read touches; 0 for none. One read may be repeated exactly."""
    df = _read_experiment(spark, sf)
    key = ["experiment", "chrom", "pos", "end"]
    spots = df.filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).select(
        "experiment", "chrom", F.col("pos").alias("start"), "end").distinct()
    rg = regions(spark, sf).select("experiment", "chrom", "start", "end", F.struct("region", "type", "mosaic").alias("hit"),
                                   F.col("region").alias("region_order"))
    pairs = intervals.overlap_pairs(spots, rg, ["experiment", "chrom"])
    hit = pairs.groupBy("experiment", "chrom", "start", "end").agg(F.min_by("hit", "region_order").alias("hit"))
    joined = df.join(hit.withColumnRenamed("start", "pos"), key, "left")
    mapped = F.col("flag").bitwiseAND(F.lit(4)) == 0
    h = F.when(mapped, F.col("hit"))
    return joined.withColumn("region", F.coalesce(h["region"], F.lit(0))).withColumn(
        "cn", calls.region_copy_number(h["type"], h["mosaic"]))


@query("j06_read_to_region", """
    SELECT sample, region, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM read_region GROUP BY ALL""")
def _(spark, sf):
    return _read_regions(spark, sf).groupBy("sample", "region").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


add_cte("thinned", """
    SELECT sample, region, (read_id * 7919 + sample_idx * 104729) % 1000000
           < floor(cn / max(cn) OVER (PARTITION BY sample) * 1000000) AS kept FROM read_region""")


@query("a79_a78_thinning_and_scale_ratio", """
    SELECT sample, region, round(CASE WHEN k0 > 0 THEN kn * o0 / CAST(o * k0 AS DOUBLE) ELSE 0 END, 6) AS ratio
    FROM (SELECT sample, region, count(*) AS o, count(*) FILTER (kept) AS kn FROM thinned GROUP BY ALL) a
    LEFT JOIN (SELECT sample, count(*) AS o0, count(*) FILTER (kept) AS k0 FROM thinned WHERE region = 0 GROUP BY ALL) z
    USING (sample) WHERE region > 0""")
def _(spark, sf):
    df = _read_regions(spark, sf)
    top = df.groupBy("sample").agg(F.max("cn").alias("top"))
    df = df.join(top, "sample")
    h = (F.col("read_id") * 7919 + F.col("sample_idx") * 104729) % 1_000_000
    out = evaluate.scale_ratio(evaluate.thinning_keep(df, F.col("cn") / F.col("top"), h), ["sample"])
    return out.select("sample", "region", r6(F.col("ratio")).alias("ratio"))


@query("j07_a69_region_counts", """
    SELECT sample, region, CASE WHEN sz > 5 * (re - rs + 1) THEN 0 ELSE n END AS n,
           CASE WHEN sz > 5 * (re - rs + 1) THEN 0 ELSE sz END AS size,
           CASE WHEN sz > 5 * (re - rs + 1) THEN 0 ELSE obs END AS obs,
           round(CASE WHEN sz > 5 * (re - rs + 1) THEN 0.0 ELSE expected END, 6) + 0.0 AS expected
    FROM (SELECT m.sample, r.experiment, r.region, any_value(r.start) AS rs, any_value(r."end") AS re, count(b.obs) AS n,
                 CAST(coalesce(sum(b."end" - b.start + 1), 0) AS BIGINT) AS sz, CAST(coalesce(sum(b.obs), 0) AS BIGINT) AS obs,
                 coalesce(sum(b.expected), 0) AS expected
          FROM (SELECT DISTINCT sample, 'E' || lpad(CAST(sample_idx AS VARCHAR), 5, '0') AS experiment FROM reads) m
          JOIN regions r ON r.experiment = m.experiment
          LEFT JOIN bic_bins b ON b.sample = m.sample AND b.chrom = r.chrom AND b.start <= r."end" AND r.start <= b."end"
          GROUP BY m.sample, r.experiment, r.region)""")
def _(spark, sf):
    from karyospark.operators.bic import region_counts
    m = _read_experiment(spark, sf).select("sample", "experiment").distinct()
    asked = regions(spark, sf).join(m, "experiment").select("sample", "region", "chrom", "start", "end")
    df = region_counts(asked, bic_bins(spark, sf))
    return df.select("sample", "region", "n", "size", "obs", r6(F.col("expected")).alias("expected"))


add_cte("bin_at", """SELECT b.sample, b.chrom_num, b.bin, b.start, b."end", b.obs FROM bic_bins b""")


add_cte("callers", "SELECT DISTINCT sample, algorithm FROM segments")


def _bins_per_caller(spark, sf):
    """Bins of a sample once for each caller that has segments of it."""
    callers = segments(spark, sf).select("sample", "algorithm").distinct()
    return bic_bins(spark, sf).select("sample", "chrom_num", "bin", "start", "end").join(callers, "sample")


@query("j08_point_in_segment", """
    SELECT b.sample, b.algorithm, b.chrom_num, b.bin, coalesce(max_by(CASE WHEN copy_number >= 2.3 THEN 'gain'
           WHEN copy_number <= 1.7 THEN 'loss' ELSE 'normal' END, s.start * 10000000 + seg_id) FILTER (b.start <= s."end"),
           'no_change') AS state
    FROM (SELECT DISTINCT sample, algorithm, chrom_num, bin, start FROM bin_at JOIN callers USING (sample)) b
    LEFT JOIN segments s
      ON s.sample = b.sample AND s.algorithm = b.algorithm AND s.chrom_num = b.chrom_num AND s.start <= b.start AND b.start <= s."end"
    GROUP BY b.sample, b.algorithm, b.chrom_num, b.bin""")
def _(spark, sf):
    seg = segments(spark, sf).withColumn("state", calls.call_web(F.col("copy_number")))
    df = intervals.segment_at(_bins_per_caller(spark, sf).drop("end"), seg, ["sample", "algorithm", "chrom_num"], "start", "state")
    return df.select("sample", "algorithm", "chrom_num", "bin", F.coalesce("state", F.lit("no_change")).alias("state"))


@query("j09_bin_inside_segment", """
    SELECT b.sample, b.algorithm, b.chrom_num, b.bin, min_by(s.copy_number, s.seg_id) AS copy_number
    FROM (SELECT * FROM bin_at JOIN callers USING (sample)) b LEFT JOIN segments s
      ON s.sample = b.sample AND s.algorithm = b.algorithm AND s.chrom_num = b.chrom_num AND b.start >= s.start AND b."end" <= s."end"
    GROUP BY b.sample, b.algorithm, b.chrom_num, b.bin""")
def _(spark, sf):
    seg = segments(spark, sf).select("sample", "algorithm", "chrom_num", "start", "end", "copy_number", "seg_id")
    df = intervals.first_hit(_bins_per_caller(spark, sf), seg, ["sample", "algorithm", "chrom_num"], ["bin"], "copy_number", "seg_id",
                             inside=True, closed=True)
    return df.select("sample", "algorithm", "chrom_num", "bin", "copy_number")


@query("j10_positions_outside_intervals", """
    SELECT sample, chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM reads x
    WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = x.chrom AND x.pos BETWEEN r.start AND r."end")
    GROUP BY ALL""")
def _(spark, sf):
    df = intervals.positions_outside(reads(spark, sf).select("sample", "chrom", "pos"),
                                     regions(spark, sf).select("chrom", "start", "end"), ["chrom"])
    return df.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("j12_positions_far_from_gaps", """
    SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM reads x
    WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = x.chrom
                      AND x.pos BETWEEN r.start - 1000000 AND r."end" + 1000000) GROUP BY ALL""")
def _(spark, sf):
    from karyospark.operators.bic import far_from_gaps
    df = far_from_gaps(reads(spark, sf).select("chrom", "pos"), regions(spark, sf))
    return df.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("j13_gap_distance", """
    SELECT sample, b.chrom, bin, round(min(CASE WHEN r.start IS NULL THEN NULL WHEN b.start BETWEEN r.start AND r."end" THEN 0
           WHEN b.start < r.start THEN r.start - b.start ELSE b.start - r."end" END) / 1000.0::DOUBLE, 6) AS distance_kb
    FROM bic_bins b LEFT JOIN regions r ON r.chrom = b.chrom GROUP BY sample, b.chrom, bin""")
def _(spark, sf):
    from karyospark.operators.bic import gap_distance
    pts = bic_bins(spark, sf).select("sample", "chrom", "bin", F.col("start").alias("pos"))
    df = gap_distance(pts, regions(spark, sf).select("chrom", "start", "end"))
    return df.select("sample", "chrom", "bin", r6(F.col("distance_kb")).alias("distance_kb"))


@query("j14_aligned_combine", """
    SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.bin, b.bin) AS bin, a.obs AS obs_a, b.obs AS obs_b,
           a.obs IS NOT NULL AND b.obs IS NOT NULL AS aligned
    FROM (SELECT chrom, pos // 400000 AS bin, count(*) AS obs FROM reads WHERE flag & 16 = 0 GROUP BY ALL) a
    FULL JOIN (SELECT chrom, pos // 400000 AS bin, count(*) AS obs FROM reads WHERE flag & 16 <> 0 GROUP BY ALL) b
    ON a.chrom = b.chrom AND a.bin = b.bin""")
def _(spark, sf):
    from karyospark.operators.bic import combine_aligned
    b = reads(spark, sf).groupBy("chrom", F.expr(f"pos div {B}").alias("bin"), F.col("flag").bitwiseAND(F.lit(16)).alias("s")).agg(
        F.count("*").alias("obs"))
    return combine_aligned(b.filter("s = 0").drop("s"), b.filter("s <> 0").drop("s"), ["chrom", "bin"], "obs")


@query("j15_truth_per_region", """
    SELECT s.experiment, s.sample, s.algorithm, s.region, copy_number, ratio FROM region_cn s
    JOIN scale_ratios t ON t.experiment = s.experiment AND t.sample = s.sample AND t.region = s.region""")
def _(spark, sf):
    cn = evaluate.region_copy_numbers(segments(spark, sf), regions(spark, sf))
    return cn.join(scale_ratios(spark, sf), ["experiment", "sample", "region"]).select(
        "experiment", "sample", "algorithm", "region", "copy_number", "ratio")
