"""Bin-track queries: counting to log2 ratio, masks, smoothing, the older variant."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions import calls, numeric
from karyospark.operators import counts, masks, reference, smoothing
from karyospark.plans import ratio_chain
from karyospark.plans.projections import READ_BIN, add_cte, gc_of_bin, n_of_bin, reads, ref_chunks
from karyospark.plans.registry import query
from karyospark.schema import bin_grid

B = READ_BIN


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _cols(df, keys, **values):
    return df.select(*keys, *[c.alias(a) for a, c in values.items()])


KEY = ["sample", "chrom", "bin"]

add_cte("counted", f"""
    SELECT s.sample, g.chrom, g.chrom_num, g.bin, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT sample FROM reads) s CROSS JOIN grid g
    LEFT JOIN (SELECT sample, chrom, bin, count(*) AS n FROM (
        SELECT sample, chrom, unnest(range(pos // {B}, ("end" - 1) // {B} + 1)) AS bin FROM reads) GROUP BY ALL) c
    ON c.sample = s.sample AND c.chrom = g.chrom AND c.bin = g.bin""")
add_cte("shares", f"""
    SELECT *, CASE WHEN tot > own THEN n / CAST(tot - own AS DOUBLE) * {B} ELSE 0.0 END AS proportion
    FROM (SELECT *, sum(CASE WHEN chrom_num <= 22 THEN n ELSE 0 END) OVER (PARTITION BY sample) AS tot,
                 CASE WHEN chrom_num <= 22 THEN sum(n) OVER (PARTITION BY sample, chrom) ELSE 0 END AS own
          FROM counted)""")
add_cte("sexes", """
    SELECT sample, xy_ratio, CASE WHEN xy_ratio > 0.1 THEN 'male' ELSE 'female' END AS sex FROM (
      SELECT sample, CASE WHEN sum(proportion) FILTER (chrom = 'X') > 0 THEN
        (sum(proportion) FILTER (chrom = 'Y') * count(*) FILTER (chrom = 'X'))
        / (sum(proportion) FILTER (chrom = 'X') * count(*) FILTER (chrom = 'Y')) ELSE 0.0 END AS xy_ratio
      FROM shares GROUP BY sample)""")
add_cte("first_pass", "SELECT s.*, xy_ratio, sex FROM shares s JOIN sexes USING (sample)")
add_cte("reference_track", """
    SELECT chrom, bin, avg(proportion) AS reference FROM first_pass
    WHERE chrom_num <= 22 OR (chrom = 'X' AND sex = 'female') OR (chrom = 'Y' AND sex = 'male')
    GROUP BY chrom, bin""")
add_cte("ratio_track", """
    SELECT f.*, reference, CASE WHEN reference > 0 THEN proportion / reference
                                WHEN reference IS NOT NULL THEN 0.0 END AS ratio
    FROM first_pass f LEFT JOIN reference_track USING (chrom, bin)""")
add_cte("flagged_track", """
    SELECT *, CASE WHEN chrom_num > 22 OR nv = 0 THEN false WHEN nf * 2 > nv THEN true ELSE far END AS aberrant
    FROM (SELECT *, count(*) FILTER (reference > 0) OVER (PARTITION BY sample, chrom) AS nv,
                 count(*) FILTER (reference > 0 AND far) OVER (PARTITION BY sample, chrom) AS nf
          FROM (SELECT *, coalesce(abs(ratio - 1.0) > 0.35, true) AS far FROM ratio_track))""")
add_cte("scaled_track", """
    SELECT *, coalesce(CASE WHEN sr > 0 THEN sn / sr END, 1.0) AS scale FROM (
      SELECT *, sum(n) FILTER (good) OVER (PARTITION BY sample) AS sn,
             sum(reference) FILTER (good) OVER (PARTITION BY sample) AS sr
      FROM (SELECT *, chrom_num <= 22 AND reference > 0 AND NOT aberrant AS good FROM flagged_track))""")
add_cte("total_track", """
    SELECT *, sum(v) OVER (PARTITION BY sample) - sum(v) OVER (PARTITION BY sample, chrom) AS total FROM (
      SELECT *, CASE WHEN chrom_num <= 22 THEN CASE WHEN aberrant THEN coalesce(reference * scale, 0) ELSE n END
                     ELSE 0.0 END AS v FROM scaled_track)""")
add_cte("log2_track", f"""
    SELECT *, CASE WHEN total > 0 AND n > 0 AND reference > 0
       THEN log2(n / CAST(total AS DOUBLE) * {B} / reference) - CASE WHEN chrom = 'Y' THEN 1 ELSE 0 END END
       AS log2_ratio FROM total_track""")


def _first(spark, sf):
    return ratio_chain.first_pass(reads(spark, sf), B)


def _ratio(spark, sf):
    return ratio_chain.ratios(_first(spark, sf), B)


def _log2(spark, sf):
    return ratio_chain.second_pass(_ratio(spark, sf), B)


@query("a01_read_count_per_bin", "SELECT sample, chrom, bin, n FROM counted")
def _(spark, sf):
    return counts.count_reads(reads(spark, sf), B).select(*KEY, "n")


@query("p11_read_filter_then_count", f"""
    SELECT sample, chrom, pos // {B} AS bin, count(*) AS n FROM reads
    WHERE mapq >= 30 AND flag & 4 = 0 GROUP BY ALL""")
def _(spark, sf):
    df = reads(spark, sf).filter(numeric.read_passes(F.col("mapq"), F.col("flag")))
    return df.groupBy("sample", "chrom", F.expr(f"pos div {B}").alias("bin")).agg(F.count("*").alias("n"))


@query("p12_contig_whitelist", """
    SELECT contig, count(*) AS n FROM (
      SELECT CASE WHEN flag = 20 THEN 'chrUn_' || chrom WHEN flag = 16 THEN 'chrMT' ELSE 'chr' || chrom END AS contig
      FROM reads) WHERE contig NOT LIKE 'chrUn%' GROUP BY contig""")
def _(spark, sf):
    from karyospark.functions.chromosomes import is_nuclear_contig
    contig = (F.when(F.col("flag") == 20, F.concat(F.lit("chrUn_"), "chrom")).when(F.col("flag") == 16, "chrMT")
              .otherwise(F.concat(F.lit("chr"), "chrom")))
    df = reads(spark, sf).select(contig.alias("contig")).filter(is_nuclear_contig(F.col("contig")))
    return df.groupBy("contig").agg(F.count("*").alias("n"))


@query("p13_mapped_positions", "SELECT sample, chrom, pos FROM reads WHERE flag & 4 = 0")
def _(spark, sf):
    return reads(spark, sf).filter(F.col("flag").bitwiseAND(F.lit(4)) == 0).select("sample", "chrom", "pos")


@query("a02_gc_and_n_content", """
    SELECT chrom, CAST(p // 1000 AS BIGINT) AS bin,
           round(CASE WHEN count(*) FILTER (c <> 'N') > 0
                 THEN count(*) FILTER (c = 'G' OR c = 'C') / CAST(1000 - count(*) FILTER (c = 'N') AS DOUBLE)
                 ELSE 0.0 END, 6) AS gc,
           round(count(*) FILTER (c = 'N') / 1000.0::DOUBLE, 6) AS n_ratio
    FROM (SELECT chrom, "offset" + generate_subscripts(s, 1) - 1 AS p, unnest(s) AS c
          FROM (SELECT chrom, "offset", regexp_extract_all(seq, '(?s).') AS s FROM ref_chunks WHERE length(seq) > 0))
    GROUP BY ALL HAVING count(*) = 1000""")
def _(spark, sf):
    df = counts.gc_content(ref_chunks(spark, sf), 1000)
    return _cols(df, ["chrom", "bin"], gc=r6(F.col("gc")), n_ratio=r6(F.col("n_ratio")))


@query("a03_frequency", f"""
    SELECT sample, chrom, bin, round(n / CAST(tot AS DOUBLE) * {B}, 6) AS frequency FROM (
      SELECT *, sum(CASE WHEN chrom_num <= 22 THEN n ELSE 0 END) OVER (PARTITION BY sample) AS tot FROM counted)
    WHERE tot > 0""")
def _(spark, sf):
    df = counts.frequency(counts.count_reads(reads(spark, sf), B), B, "n")
    return _cols(df, KEY, frequency=r6(F.col("frequency")))


@query("a04_xy_ratio_and_sex", "SELECT sample, round(xy_ratio, 6) AS xy_ratio, sex FROM sexes")
def _(spark, sf):
    return _first(spark, sf).select("sample", r6(F.col("xy_ratio")).alias("xy_ratio"), "sex").distinct()


@query("a05_leave_one_out_proportion", "SELECT sample, chrom, bin, round(proportion, 6) AS proportion FROM shares")
def _(spark, sf):
    bins = counts.count_reads(reads(spark, sf), B)
    return _cols(counts.proportion(bins, B, "n"), KEY, proportion=r6(F.col("proportion")))


@query("a06_sex_aware_reference", "SELECT chrom, bin, round(reference, 6) AS reference FROM reference_track")
def _(spark, sf):
    df = reference.reference_mean(_first(spark, sf), "proportion")
    return _cols(df, ["chrom", "bin"], reference=r6(F.col("reference")))


add_cte("variation", f"""
    SELECT chrom, chrom_num, bin, avg(f) AS mean, stddev_pop(f) AS std,
           CASE WHEN avg(f) <> 0 THEN stddev_pop(f) / avg(f) ELSE 0.0 END AS cv
    FROM (SELECT *, n / CAST(sum(CASE WHEN chrom_num <= 22 THEN n ELSE 0 END) OVER (PARTITION BY sample) AS DOUBLE)
                 * {B} AS f FROM first_pass)
    WHERE chrom_num <= 22 OR (chrom = 'X' AND sex = 'female') OR (chrom = 'Y' AND sex = 'male') GROUP BY ALL""")
add_cte("base_filter", """
    SELECT chrom, chrom_num, bin, (n_ratio >= 0.1 OR gc <= 0) AS masked FROM (
      SELECT *, ((bin * 13 + chrom_num * 7) % 12) / 100.0::DOUBLE AS n_ratio,
             0.2::DOUBLE + ((bin * 37 + chrom_num * 11) % 61) / 100.0::DOUBLE AS gc FROM grid)""")
add_cte("zmasked", """
    SELECT chrom, bin, cv, masked OR coalesce(sd > 0 AND abs((mean - mu) / sd) > 3, false) AS masked FROM (
      SELECT v.*, masked, avg(mean) FILTER (NOT masked) OVER (PARTITION BY chrom) AS mu,
             stddev_pop(mean) FILTER (NOT masked) OVER (PARTITION BY chrom) AS sd
      FROM variation v JOIN base_filter USING (chrom, bin))""")
add_cte("cvmasked", """
    SELECT chrom, bin, cv, masked OR rk <= ceil(0.1::DOUBLE * k) AS masked FROM (
      SELECT *, row_number() OVER (PARTITION BY g, masked ORDER BY cv DESC, chrom, bin) AS rk,
             count(*) OVER (PARTITION BY g, masked) AS k
      FROM (SELECT *, CASE WHEN chrom IN ('X', 'Y') THEN chrom ELSE 'autosome' END AS g FROM zmasked))""")


def _variation(spark, sf):
    return reference.bin_variation(counts.frequency(_first(spark, sf), B), "frequency")


def _base(spark):
    track = bin_grid(spark, B).withColumn("gc", gc_of_bin()).withColumn("n_ratio", n_of_bin())
    return masks.base_mask(track)


def _zmasked(spark, sf):
    joined = _variation(spark, sf).join(_base(spark).select("chrom", "bin", "masked"), ["chrom", "bin"])
    return masks.zscore_mask(joined)


@query("a07_bin_variation", """SELECT chrom, bin, round(mean, 6) AS mean, round(std, 6) AS std, round(cv, 6) AS cv
    FROM variation""")
def _(spark, sf):
    df = _variation(spark, sf)
    return _cols(df, ["chrom", "bin"], mean=r6(F.col("mean")), std=r6(F.col("std")), cv=r6(F.col("cv")))


@query("j01_a08_linear_ratio", """SELECT sample, chrom, bin, round(ratio, 6) AS ratio FROM ratio_track""")
def _(spark, sf):
    return _cols(_ratio(spark, sf), KEY, ratio=r6(F.col("ratio")))


@query("a09_aberrant_bins", "SELECT sample, chrom, bin, aberrant FROM flagged_track")
def _(spark, sf):
    return reference.aberrant_bins(_ratio(spark, sf)).select(*KEY, "aberrant")


@query("a10_global_scale", "SELECT sample, round(min(scale), 6) AS scale FROM scaled_track GROUP BY sample")
def _(spark, sf):
    df = reference.rescale(reference.aberrant_bins(_ratio(spark, sf)))
    return df.groupBy("sample").agg(r6(F.min("scale")).alias("scale"))


@query("a11_adjusted_totals",
       "SELECT sample, chrom, round(min(total), 6) AS total FROM total_track GROUP BY sample, chrom")
def _(spark, sf):
    df = reference.adjusted_totals(reference.rescale(reference.aberrant_bins(_ratio(spark, sf))))
    return df.groupBy("sample", "chrom").agg(r6(F.min("total")).alias("total"))


@query("a12_recomputed_log2", "SELECT sample, chrom, bin, round(log2_ratio, 6) + 0.0 AS log2_ratio FROM log2_track")
def _(spark, sf):
    return _cols(_log2(spark, sf), KEY, log2_ratio=r6(F.col("log2_ratio")))


@query("flagship_bin_calls", """
    SELECT sample, chrom, bin, sex, round(log2_ratio, 6) + 0.0 AS log2_ratio, round(cn, 6) AS copy_number,
           CASE WHEN cn >= 2.45 THEN 'Gain' WHEN cn <= 1.55 THEN 'Loss' WHEN cn IS NOT NULL THEN 'No Change' END AS call
    FROM (SELECT *, pow(2.0, log2_ratio + 1) AS cn FROM log2_track)""")
def flagship(spark, sf):
    df = ratio_chain.bin_calls(reads(spark, sf), B)
    return df.withColumn("log2_ratio", r6(F.col("log2_ratio"))).withColumn("copy_number", r6(F.col("copy_number")))


@query("p09_base_mask_over_counts", """
    SELECT sample, masked, count(*) AS bins, CAST(sum(n) AS BIGINT) AS n
    FROM counted JOIN base_filter USING (chrom, bin) GROUP BY ALL""")
def _(spark, sf):
    bins = counts.count_reads(reads(spark, sf), B)
    flags = reference.per_bin(_base(spark).select("chrom", "bin", "masked"), B)
    return bins.join(flags, ["chrom", "bin"]).groupBy("sample", "masked").agg(
        F.count("*").alias("bins"), F.sum("n").alias("n"))


@query("p10_combined_mask", """
    SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.bin, b.bin) AS bin,
           coalesce(a.masked, false) OR coalesce(b.masked, false) AS masked
    FROM base_filter a FULL JOIN (SELECT chrom, bin, count(*) < 280 AS masked FROM (
        SELECT chrom, pos // 400000 AS bin FROM reads) GROUP BY ALL) b ON a.chrom = b.chrom AND a.bin = b.bin""")
def _(spark, sf):
    sparse = reads(spark, sf).groupBy("chrom", F.expr(f"pos div {B}").alias("bin")).agg(
        (F.count("*") < 280).alias("masked"))
    return masks.combine_masks(_base(spark), sparse)


@query("a14_zscore_mask", "SELECT chrom, bin, masked FROM zmasked")
def _(spark, sf):
    return _zmasked(spark, sf).select("chrom", "bin", "masked")


@query("a13_o04_cv_mask", "SELECT chrom, bin, masked FROM cvmasked")
def _(spark, sf):
    return masks.cv_mask(_zmasked(spark, sf)).select("chrom", "bin", "masked")


@query("w01_blacklist_dilated", """
    SELECT chrom, bin, max(masked) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
           AS masked FROM cvmasked""")
def _(spark, sf):
    return ratio_chain.blacklist(_first(spark, sf), _base(spark), B).select("chrom", "bin", "masked")


@query("w02_dilate_k", """
    SELECT chrom, bin, max(masked) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
           AS masked FROM zmasked""")
def _(spark, sf):
    return masks.dilate(_zmasked(spark, sf), 2).select("chrom", "bin", "masked")


add_cte("keep_filter", """
    SELECT chrom, bin, max(NOT kept) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
           AS masked
    FROM (SELECT *, elig AND row_number() OVER (PARTITION BY chrom, elig ORDER BY cv, bin)
                    <= greatest(ceil(round(n * 0.8::DOUBLE, 9)), 1) AS kept
      FROM (SELECT *, ok OR NOT max(ok) OVER (PARTITION BY chrom) AS elig
        FROM (SELECT *, NOT masked AND row_number() OVER (PARTITION BY chrom ORDER BY z DESC, bin)
                        > ceil(round(n * (1 - 0.8::DOUBLE), 9)) AS ok
          FROM (SELECT chrom, bin, cv, masked, count(*) OVER (PARTITION BY chrom) AS n,
                       round(abs((cv - avg(cv) OVER (PARTITION BY chrom))
                       / CASE WHEN stddev_pop(cv) OVER (PARTITION BY chrom) = 0 THEN 1e-12
                         ELSE stddev_pop(cv) OVER (PARTITION BY chrom) END), 9) AS z
                FROM (SELECT v.chrom, v.bin, round(v.cv, 9) AS cv, masked
                      FROM variation v JOIN base_filter USING (chrom, bin))))))""")


@query("a15_keep_ratio_filter", """
    SELECT chrom, count(*) AS bins, count(*) FILTER (masked) AS removed,
           round(count(*) FILTER (masked) * 100.0::DOUBLE / count(*), 6) AS removed_percent
    FROM keep_filter GROUP BY chrom""")
def _(spark, sf):
    df = (_variation(spark, sf).withColumn("cv", F.round("cv", 9))
          .join(_base(spark).select("chrom", "bin", "masked"), ["chrom", "bin"]))
    out = masks.removed_share(masks.keep_ratio_filter(df, 0.8))
    return out.withColumn("removed_percent", r6(F.col("removed_percent")))


# The older variant uses every started bin and the whole-file total.
add_cte("old_fraction", f"""
    SELECT sample, chrom, bin, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS fraction FROM (
      SELECT sample, chrom, pos // {B} AS bin, count(*) AS n FROM reads GROUP BY ALL)""")
add_cte("old_stats", """
    SELECT chrom, bin, avg(fraction) AS mean, stddev_pop(fraction) AS std FROM old_fraction
    JOIN (SELECT chrom, min(b) AS cut FROM (SELECT chrom, sample, max(bin) AS b FROM old_fraction GROUP BY ALL)
          GROUP BY chrom) USING (chrom) WHERE bin <= cut GROUP BY chrom, bin""")
add_cte("old_log2", """
    SELECT sample, chrom, bin, CASE WHEN m > 0 AND fraction > 0 THEN log2(fraction / m) END AS log2_ratio
    FROM old_fraction JOIN (SELECT *, CASE WHEN std > 5.0 THEN -1.0 ELSE mean END AS m FROM old_stats)
    USING (chrom, bin)""")


def _old_fraction(spark, sf):
    n = reads(spark, sf).groupBy("sample", "chrom", F.expr(f"pos div {B}").alias("bin")).agg(F.count("*").alias("n"))
    return counts.fraction_of_total(n)


def _old_log2(spark, sf):
    f = _old_fraction(spark, sf)
    return reference.legacy_log2(f, reference.drop_unstable(reference.control_stats(f)), B)


@query("a16_fraction_of_total", "SELECT sample, chrom, bin, round(fraction, 9) AS fraction FROM old_fraction")
def _(spark, sf):
    return _cols(_old_fraction(spark, sf), KEY, fraction=F.round("fraction", 9))


@query("a17_control_stats", "SELECT chrom, bin, round(mean, 9) AS mean, round(std, 9) AS std FROM old_stats")
def _(spark, sf):
    df = reference.control_stats(_old_fraction(spark, sf))
    return _cols(df, ["chrom", "bin"], mean=F.round("mean", 9), std=F.round("std", 9))


@query("a18_std_filter", """SELECT chrom, bin, round(CASE WHEN std > 5.0 THEN -1.0 ELSE mean END, 9) AS mean
    FROM old_stats""")
def _(spark, sf):
    df = reference.drop_unstable(reference.control_stats(_old_fraction(spark, sf)))
    return _cols(df, ["chrom", "bin"], mean=F.round("mean", 9))


@query("a19_legacy_log2", "SELECT sample, chrom, bin, round(coalesce(log2_ratio, -2.0), 6) + 0.0 AS value FROM old_log2")
def _(spark, sf):
    return _cols(_old_log2(spark, sf), KEY, value=r6(numeric.remask(F.col("log2_ratio"), -2.0)))


@query("a20_box_summary", """
    SELECT chrom, n, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
           round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high
    FROM (SELECT chrom, count(*) AS n, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
                 min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
                 max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high
          FROM (SELECT chrom, log2_ratio AS x, quantile_cont(log2_ratio, 0.25) OVER (PARTITION BY chrom) AS q1,
                       quantile_cont(log2_ratio, 0.5) OVER (PARTITION BY chrom) AS q2,
                       quantile_cont(log2_ratio, 0.75) OVER (PARTITION BY chrom) AS q3
                FROM old_log2 WHERE log2_ratio IS NOT NULL) GROUP BY chrom)""")
def _(spark, sf):
    df = reference.box_summary(_old_log2(spark, sf), ["chrom"], "log2_ratio")
    return _cols(df, ["chrom", "n"], **{c: r6(F.col(c)) for c in ("q1", "median", "q3", "low", "high")})


_NEAREST = """
    SELECT sample, chrom, bin, round({stat}, 6) + 0.0 AS smoothed FROM (
      SELECT *, row_number() OVER (PARTITION BY sample, chrom, bin ORDER BY d, s) AS rk FROM (
        SELECT a.sample, a.chrom, a.bin, b.log2_ratio AS v, abs(a.bin - b.bin) AS d,
               CASE WHEN b.bin < a.bin THEN 0 ELSE 1 END AS s
        FROM log2_track a LEFT JOIN log2_track b
        ON a.sample = b.sample AND a.chrom = b.chrom AND b.log2_ratio IS NOT NULL))
    WHERE rk <= 4 GROUP BY sample, chrom, bin"""


@query("w03_nearest_valid_mean", _NEAREST.format(stat="avg(v)"))
def _(spark, sf):
    return _cols(smoothing.nearest_valid(_log2(spark, sf), 4), KEY, smoothed=r6(F.col("smoothed")))


@query("w04_nearest_valid_median", _NEAREST.format(stat="quantile_cont(v, 0.5)"))
def _(spark, sf):
    return _cols(smoothing.nearest_valid(_log2(spark, sf), 4, "median"), KEY, smoothed=r6(F.col("smoothed")))


@query("w05_bilateral", """
    SELECT sample, chrom, bin, round(CASE WHEN x IS NOT NULL THEN coalesce(sum(w * v) / nullif(sum(w), 0), x) END, 6)
           + 0.0 AS smoothed
    FROM (SELECT a.sample, a.chrom, a.bin, a.log2_ratio AS x, b.log2_ratio AS v,
                 exp(-0.5 * pow((b.bin - a.bin) / 1.0::DOUBLE, 2))
                 * exp(-0.5 * pow((b.log2_ratio - a.log2_ratio) / srng, 2)) AS w
          FROM log2_track a
          LEFT JOIN log2_track b ON a.sample = b.sample AND a.chrom = b.chrom AND abs(a.bin - b.bin) <= 2
                                 AND b.log2_ratio IS NOT NULL
          LEFT JOIN (SELECT sample, chrom, CASE WHEN mad > 0 THEN 1.5 * mad ELSE 0.2 END AS srng FROM (
              SELECT sample, chrom, quantile_cont(abs(log2_ratio - med), 0.5) AS mad FROM (
                SELECT *, quantile_cont(log2_ratio, 0.5) OVER (PARTITION BY sample, chrom) AS med FROM log2_track)
              GROUP BY ALL)) r ON r.sample = a.sample AND r.chrom = a.chrom)
    GROUP BY sample, chrom, bin, x""")
def _(spark, sf):
    return _cols(smoothing.bilateral(_log2(spark, sf), 5), KEY, smoothed=r6(F.col("smoothed")))


@query("p05_copy_number_per_bin", """
    SELECT sample, chrom, bin, round(pow(2.0, log2_ratio + 1), 6) AS copy_number FROM log2_track""")
def _(spark, sf):
    return _cols(_log2(spark, sf), KEY, copy_number=r6(calls.copy_number(F.col("log2_ratio"))))


@query("p06_p07_p08_segmenter_input", f"""
    SELECT sample, chrom_num, bin * {B} + {B} // 2 AS maploc, round(log2_ratio, 6) + 0.0 AS log2_ratio,
           row_number() OVER (PARTITION BY sample ORDER BY chrom_num, bin) AS ord
    FROM log2_track WHERE log2_ratio IS NOT NULL""")
def _(spark, sf):
    from karyospark.functions.chromosomes import to_number
    df = _log2(spark, sf).filter(F.col("log2_ratio").isNotNull())
    df = df.withColumn("chrom_num", to_number(F.col("chrom")))
    order = Window.partitionBy("sample").orderBy("chrom_num", "maploc")
    df = df.withColumn("maploc", numeric.midpoint(F.col("bin"), B))
    return df.select("sample", "chrom_num", "maploc", r6(F.col("log2_ratio")).alias("log2_ratio"),
                     F.row_number().over(order).cast("bigint").alias("ord"))


@query("p24_plot_call", """
    SELECT sample, chrom, bin, CASE WHEN cn > 2.45 - sh THEN 'gain' WHEN cn < 1.55 - sh THEN 'loss' ELSE 'neutral' END
           AS call
    FROM (SELECT *, pow(2.0, log2_ratio + 1) AS cn,
                 CASE WHEN sex = 'male' AND chrom IN ('X', 'Y') THEN 1.0 ELSE 0.0 END AS sh FROM log2_track)""")
def _(spark, sf):
    df = _log2(spark, sf)
    return _cols(df, KEY, call=calls.call_plot(calls.copy_number(F.col("log2_ratio")), F.col("chrom"), F.col("sex")))
