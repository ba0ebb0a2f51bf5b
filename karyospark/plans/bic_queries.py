"""BIC-track queries: positions, bins, bias models, mixture, segment statistics, segmentation."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from karyospark.operators import bias, bic, segmentation
from karyospark.operators.intervals import track_overlap_sum
from karyospark.operators.reference import per_bin
from karyospark.plans import ratio_chain
from karyospark.plans.projections import (
    READ_BIN, add_cte, bic_bins, gc_of_bin, reads, ref_chunks, regions, table,
)
from karyospark.plans.registry import query
from karyospark.schema import bin_grid
from karyospark.session import materialise
from karyospark.plans.track_queries import _first, _log2, r6

add_cte("pos_counts", "SELECT sample, chrom, pos, count(*) AS n FROM reads GROUP BY ALL")
add_cte("islands", """
    SELECT chrom, min(start) AS start, max("end") AS "end" FROM (
      SELECT *, sum(CASE WHEN start > prev OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end") AS g
      FROM (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            AS prev FROM regions WHERE "end" > start)) GROUP BY chrom, g""")
add_cte("ranked_islands", """
    SELECT *, CAST(coalesce(sum("end" - start) OVER (PARTITION BY chrom ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS BIGINT) AS before FROM islands""")


def _mappable(spark, sf):
    return regions(spark, sf).select("chrom", "start", "end")


def _pos_counts(spark, sf):
    return bic.position_counts(reads(spark, sf))


@query("a50_position_counts", "SELECT sample, chrom, pos, n FROM pos_counts")
def _(spark, sf):
    return _pos_counts(spark, sf)


@query("a51_mappable_totals", """
    SELECT sample, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(positions) AS BIGINT) AS positions,
           CASE WHEN sum(reads) > 0 THEN greatest(1000, CAST(ceil(1000.0::DOUBLE * sum(positions) / sum(reads)) AS BIGINT)) END AS bin_size
    FROM (SELECT c.sample, c.chrom, coalesce(r, 0) AS reads, positions
          FROM (SELECT DISTINCT sample, chrom FROM pos_counts) c
          JOIN (SELECT chrom, sum("end" - start) AS positions FROM islands GROUP BY chrom) z ON z.chrom = c.chrom
          LEFT JOIN (SELECT p.sample, p.chrom, sum(n) AS r FROM pos_counts p JOIN islands i ON i.chrom = p.chrom
                     AND p.pos >= i.start AND p.pos < i."end" GROUP BY ALL) x ON x.sample = c.sample AND x.chrom = c.chrom)
    GROUP BY sample""")
def _(spark, sf):
    return bic.adaptive_bin_size(bic.mappable_totals(_pos_counts(spark, sf), _mappable(spark, sf)), ["sample"])


@query("a52_equal_mappability_bins", """
    SELECT chrom, bin, min(lo + start - before) AS start, max(hi + start - before - 1) AS "end", CAST(sum(hi - lo) AS BIGINT) AS positions
    FROM (SELECT *, greatest(before, bin * 400000) AS lo,
                 least(before + "end" - start, CASE WHEN bin = lst THEN tot ELSE (bin + 1) * 400000 END) AS hi
          FROM (SELECT *, unnest(range(least(before // 400000, lst), least((before + "end" - start - 1) // 400000, lst) + 1)) AS bin
                FROM (SELECT i.*, tot, greatest(tot // 400000 - 1, 0) AS lst FROM ranked_islands i
                      JOIN (SELECT chrom, CAST(sum("end" - start) AS BIGINT) AS tot FROM islands GROUP BY chrom) t ON t.chrom = i.chrom)))
    GROUP BY chrom, bin""")
def _(spark, sf):
    pieces = bic.ranked_pieces(_mappable(spark, sf), ["chrom"])
    return bic.equal_mappability_bins(pieces, ["chrom"], READ_BIN)


@query("a52_counts_per_mappability_bin", """
    SELECT sample, p.chrom, (before + pos - start) // 400000 AS bin, CAST(sum(n) AS BIGINT) AS obs
    FROM pos_counts p JOIN ranked_islands i ON i.chrom = p.chrom AND pos >= start AND pos < "end" GROUP BY ALL""")
def _(spark, sf):
    pieces = bic.ranked_pieces(_mappable(spark, sf), ["chrom"])
    df = bic.position_rank(_pos_counts(spark, sf), pieces, ["chrom"])
    return df.groupBy("sample", "chrom", F.expr(f"rank div {READ_BIN}").alias("bin")).agg(F.sum("n").alias("obs"))


@query("a53_fixed_bins", """
    SELECT sample, chrom, CAST(floor((pos - 1) / 400000) AS BIGINT) AS bin, CAST(sum(n) AS BIGINT) AS obs FROM pos_counts GROUP BY ALL""")
def _(spark, sf):
    return bic.fixed_bins(_pos_counts(spark, sf), READ_BIN).groupBy("sample", "chrom", "bin").agg(F.sum("n").alias("obs"))


_RATE = {"gc": 1.5, "late": -0.3}


def _rated(spark, sf):
    df = _pos_counts(spark, sf).withColumn("gc", F.lit(0.2) + (F.expr("pos div 1000") % 61) / F.lit(100.0)).withColumn(
        "late", F.col("pos") % 2)
    return df.withColumn("rate", bic.rate_from_terms(-1.0, _RATE))


add_cte("rated", """SELECT *, exp(-1.0 + (0.2::DOUBLE + ((pos // 1000) % 61) / 100.0::DOUBLE) * 1.5 + (pos % 2) * -0.3::DOUBLE) AS rate
    FROM pos_counts""")


@query("a54_a58_expected_per_bin", """
    SELECT sample, chrom, pos // 400000 AS bin, CAST(sum(n) AS BIGINT) AS obs, round(sum(rate), 6) AS expected,
           round(sum(rate + rate * rate / 4.0), 6) AS var FROM rated GROUP BY ALL""")
def _(spark, sf):
    df = bic.bin_expectation(_rated(spark, sf).withColumn("bin", F.expr(f"pos div {READ_BIN}")), ["sample", "chrom", "bin"], 4.0)
    return df.withColumn("expected", r6(F.col("expected"))).withColumn("var", r6(F.col("var")))


@query("j11_mappable_positions_with_counts", """
    SELECT m.chrom, m.positions, CAST(coalesce(c.n, 0) AS BIGINT) AS n, m.positions - coalesce(c.covered, 0) AS empty
    FROM (SELECT chrom, CAST(sum("end" - start) AS BIGINT) AS positions FROM islands GROUP BY chrom) m
    LEFT JOIN (SELECT p.chrom, sum(n) AS n, count(*) AS covered
               FROM (SELECT chrom, pos, CAST(sum(n) AS BIGINT) AS n FROM pos_counts GROUP BY ALL) p
               JOIN islands i ON i.chrom = p.chrom AND p.pos >= i.start AND p.pos < i."end" GROUP BY p.chrom) c ON c.chrom = m.chrom""")
def _(spark, sf):
    c = _pos_counts(spark, sf).groupBy("chrom", "pos").agg(F.sum("n").alias("n"))
    runs = bic.mappable_runs(c, bic.disjoint_pieces(_mappable(spark, sf), ["chrom"]), ["chrom"])
    size = F.col("end") - F.col("start")
    return runs.groupBy("chrom").agg(F.sum(size).alias("positions"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") == 0, size).otherwise(0)).alias("empty"))


# Samples of one sex together, as a single one has fewer covered positions on a chromosome than the window.
add_cte("pooled_counts", """SELECT sample, chrom, pos, CASE WHEN pos % 11 = 0 THEN n * 40 ELSE n END AS n FROM (
    SELECT CASE WHEN CAST(substring(sample, 2) AS BIGINT) % 2 = 0 THEN 'female' ELSE 'male' END AS sample, chrom, pos,
           CAST(sum(n) AS BIGINT) AS n FROM pos_counts GROUP BY 1, 2, 3)""")


@query("w10_outlier_cap", """
    SELECT sample, chrom, pos, least(n, CAST(q * 5 AS BIGINT)) AS n FROM (
      SELECT *, list_sort(list(n) OVER w)[CAST(ceil(0.95::DOUBLE * len(list(n) OVER w)) AS BIGINT)] AS qq,
             CASE WHEN rk < 99 THEN max(CASE WHEN rk = 99 THEN qq0 END) OVER e
                  WHEN rk > greatest(sz - 101, 99) THEN max(CASE WHEN rk = greatest(sz - 101, 99) THEN qq0 END) OVER e END AS qe,
             coalesce(qe, qq) AS q
      FROM (SELECT *, CASE WHEN rk = 99 OR rk = greatest(sz - 101, 99) THEN
                   list_sort(list(n) OVER (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN 99 PRECEDING AND 100 FOLLOWING)) END AS full_w,
                   full_w[CAST(ceil(0.95::DOUBLE * len(full_w)) AS BIGINT)] AS qq0
            FROM (SELECT sample, chrom, pos, n, row_number() OVER (PARTITION BY sample, chrom ORDER BY pos) - 1 AS rk,
                         count(*) OVER (PARTITION BY sample, chrom) AS sz FROM pooled_counts))
      WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN 99 PRECEDING AND 100 FOLLOWING),
             e AS (PARTITION BY sample, chrom))""")
def _(spark, sf):
    sex = F.when(F.substring("sample", 2, 10).cast("bigint") % 2 == 0, "female").otherwise("male")
    pooled = _pos_counts(spark, sf).groupBy(sex.alias("sample"), "chrom", "pos").agg(F.sum("n").alias("n"))
    return bic.cap_outliers(pooled.withColumn("n", F.when(F.col("pos") % 11 == 0, F.col("n") * 40).otherwise(F.col("n"))))


add_cte("contigs", """SELECT chrom, string_agg(seq, '' ORDER BY "offset") AS s, CAST(sum(length(seq)) AS BIGINT) AS len
    FROM ref_chunks GROUP BY chrom""")


@query("w14_gc_windows", """
    SELECT chrom, count(*) AS positions, CAST(sum(g) AS BIGINT) AS gc_sum, CAST(sum(g * (p % 1009)) AS BIGINT) AS mark FROM (
      SELECT chrom, p, sum(CASE WHEN c IN ('G', 'C', 'g', 'c') THEN 1 ELSE 0 END) OVER w AS g, count(*) OVER w AS k
      FROM (SELECT chrom, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS c
            FROM (SELECT chrom, regexp_extract_all(s, '(?s).') AS l FROM contigs))
      WINDOW w AS (PARTITION BY chrom ORDER BY p ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING)) WHERE k = 601 GROUP BY chrom""")
def _(spark, sf):
    zero = F.lit(0).cast("bigint")
    marked = F.transform("counts", lambda g, i: g * ((F.col("first") + i) % 1009))
    t = bias.gc_window_tiles(ref_chunks(spark, sf), 300).select(
        "chrom", F.size("counts").alias("k"), F.aggregate("counts", zero, lambda a, g: a + g).alias("g"), F.aggregate(marked, zero, lambda a, g: a + g).alias("m"))
    return t.groupBy("chrom").agg(F.sum("k").alias("positions"), F.sum("g").alias("gc_sum"), F.sum("m").alias("mark"))


# Events as read positions anywhere on the document contigs.
add_cte("marked", """
    SELECT event_id, chrom, (event_id * 7919) % len AS pos, user_id % 5 AS n, len, s
    FROM (SELECT *, 'D' || (event_id // 10) AS chrom FROM events) JOIN contigs USING (chrom) WHERE len > 0""")


def _marked(spark, sf, length=None):
    """`length` has the bases of each contig as `_length`, where they are known already."""
    if length is None:
        length = ref_chunks(spark, sf).groupBy("chrom").agg(F.sum(F.length("seq")).cast("bigint").alias("_length"))
    e = table(spark, sf, "events").select(F.concat(F.lit("D"), F.expr("event_id div 10").cast("string")).alias("chrom"), "event_id",
                                          (F.col("user_id") % 5).alias("n"))
    return e.join(length.filter("_length > 0"), "chrom").withColumn("pos", (F.col("event_id") * 7919) % F.col("_length")).drop("_length")


FRAGMENT, FLANK, READ_LENGTH = 300, 5, 50
OFFSETS = bias.read_offsets(FLANK, READ_LENGTH)
_SEEN = ["G-5", "C-1", "T0", "G4", "C45", "T50", "G54"]


@query("a55_training_covariates", """
    SELECT event_id, chrom, pos, round(length(regexp_replace(substring(s, pos - 299, 601), '[^GCgc]', '', 'g')) / 601.0::DOUBLE, 6) AS gc, """ + ", ".join(
    f"""CASE WHEN upper(substring(s, pos + {int(c[1:]) + 1}, 1)) = '{c[0]}' THEN 1 ELSE 0 END AS {c.replace("-", "m").lower()}""" for c in _SEEN) + """
    FROM marked WHERE pos >= 300 AND pos + 300 < len""")
def _(spark, sf):
    df = bias.training_covariates(_marked(spark, sf), ref_chunks(spark, sf), FRAGMENT, FLANK, read_length=READ_LENGTH)
    return df.select("event_id", "chrom", "pos", r6(F.col("gc")).alias("gc"), *[F.col(c).alias(c.replace("-", "m").lower()) for c in _SEEN])


@query("a55_whole_read_covariates", """
    SELECT event_id, pos, length(regexp_replace(upper(substring(s, pos - 4, 60)), '[^G]', '', 'g')) AS g,
           length(regexp_replace(upper(substring(s, pos - 4, 60)), '[^T]', '', 'g')) AS t
    FROM marked WHERE pos >= 300 AND pos + 300 < len""")
def _(spark, sf):
    offsets = bias.read_offsets(FLANK, READ_LENGTH, whole_read=True)
    df = bias.covariates(_marked(spark, sf), ref_chunks(spark, sf), FRAGMENT, offsets)
    held = {c: F.aggregate("letters", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x == k, 1).otherwise(0)) for c, k in (("g", 1), ("t", 3))}  # noqa: B023
    return df.select("event_id", "pos", *[n.alias(c) for c, n in held.items()])


@query("a56_hash_sample", """
    SELECT sample, chrom, pos, n FROM pos_counts WHERE (pos * 7919 + 7 * 104729) % 1000003 < CAST(floor(0.02 * 1000003) AS BIGINT)""")
def _(spark, sf):
    return bic.hash_sample(_pos_counts(spark, sf), F.col("pos"), 0.02, 7)


def _cells(spark, sf):
    return bias.covariate_cells(bias.covariates(_marked(spark, sf), ref_chunks(spark, sf), FRAGMENT, OFFSETS))


@query("a57_bias_regression_curve")
def _(spark, sf):
    cells = _cells(spark, sf)
    model = bias.fit_bias(cells, FRAGMENT, OFFSETS)
    grid = cells.groupBy("gc_count").agg(F.sum("positions").alias("positions"), (F.sum("reads") / F.sum("positions")).alias("observed"))
    flat = grid.withColumn("letters", F.array_repeat(F.lit(0).cast("tinyint"), len(OFFSETS)))
    return flat.select((F.col("gc_count") / 601.0).alias("gc"), "positions", "observed", model.rate().alias("rate"), F.lit(model.theta).alias("theta"))


# The fit itself cannot be SQL, but its score equations can: for each term the expected reads of a Poisson fit equal the observed ones.
@query("a57_score_equations", """
    SELECT term, positions, CAST(reads AS DOUBLE) AS reads, CAST(reads AS DOUBLE) AS expected FROM (
      SELECT 'all' AS term, count(*) AS positions, sum(n) AS reads FROM marked WHERE pos >= 300 AND pos + 300 < len""" + "".join(
    f"""
      UNION ALL SELECT '{letter}{k}', count(*), coalesce(sum(n), 0) FROM marked
      WHERE pos >= 300 AND pos + 300 < len AND upper(substring(s, pos + {k + 1}, 1)) = '{letter}'""" for k in OFFSETS for letter in "GCT") + ")")
def _(spark, sf):
    cells = _cells(spark, sf)
    model = bias.fit_bias(cells, FRAGMENT, OFFSETS)
    judged = cells.select("positions", "reads", (F.col("positions") * model.rate()).alias("expected"), "letters")
    names = [F.when(F.get("letters", F.lit(i)) == code, f"{letter}{k}") for i, k in enumerate(OFFSETS) for code, letter in enumerate("GCT", 1)]
    held = judged.select("positions", "reads", "expected", F.explode(F.concat(F.array(F.lit("all")), F.array_compact(F.array(*names)))).alias("term"))
    sums = held.groupBy("term").agg(F.sum("positions").alias("positions"), F.sum("reads").alias("reads"), F.round(F.sum("expected"), 4).alias("expected"))
    every = spark.createDataFrame([("all",), *((f"{letter}{k}",) for k in OFFSETS for letter in "GCT")], "term string")
    zero = F.lit(0.0)
    return F.broadcast(every).join(sums, "term", "left").select("term", F.coalesce("positions", F.lit(0).cast("bigint")).alias("positions"),
                                                                 F.coalesce("reads", zero).alias("reads"), F.coalesce("expected", zero).alias("expected"))


# A model in round numbers, so that SQL can work out the same rates: GC spline, letters at both read ends, refine curve.
_GC_TERMS, _REFINE_TERMS = [0.9, -0.4, 0.2, 1.5, -2.0, 0.5, 0.3], [0.05, 0.02, -0.03, 0.1, 0.0, 0.0, -0.2]
LITERAL_MODEL = bias.BiasModel(
    FRAGMENT, OFFSETS, bias.Spline(0.0, 0.5), -3.0, _GC_TERMS, np.array([[((3 * i + j) % 7 - 3) / 100 for j in range(3)] for i in range(len(OFFSETS))]),
    4.0, (bias.Spline(0.0, 0.5), 0.01, _REFINE_TERMS))


def _spline_sql(terms: list[float]) -> str:
    parts = ["u", "u * u", "u * u * u", *(f"pow(greatest(x - {k}, 0), 3)" for k in bias.KNOTS)]
    return " + ".join(f"({c}::DOUBLE) * {p}" for c, p in zip(terms, parts, strict=True))


def _letter_sql(i: int, k: int) -> str:
    at = f"lead(c, {k}) OVER o" if k >= 0 else f"lag(c, {-k}) OVER o"
    g, c, t = (((3 * i + j) % 7 - 3) / 100 for j in range(3))
    return f"CASE {at} WHEN 'G' THEN {g}::DOUBLE WHEN 'C' THEN {c}::DOUBLE WHEN 'T' THEN {t}::DOUBLE ELSE 0.0::DOUBLE END"


@query("a58_expected_per_bin_from_sequence", f"""
    SELECT chrom, p // 1000 AS bin, count(*) AS positions, round(sum(rate), 6) AS expected, round(sum(rate + rate * rate / 4.0::DOUBLE), 6) AS var,
           round(avg(g / 601.0::DOUBLE), 6) AS gc
    FROM (SELECT chrom, p, g, exp(-3.0::DOUBLE + {_spline_sql(_GC_TERMS)} + 0.01::DOUBLE + {_spline_sql(_REFINE_TERMS)} + letters) AS rate
          FROM (SELECT *, 2 * x - 1 AS u FROM (SELECT chrom, p, g, letters, least(g / 601.0::DOUBLE / 0.5::DOUBLE, 1.0::DOUBLE) AS x
            FROM (SELECT chrom, p, sum(CASE WHEN c IN ('G', 'C') THEN 1 ELSE 0 END) OVER w AS g, count(*) OVER w AS k,
                         {" + ".join(_letter_sql(i, k) for i, k in enumerate(OFFSETS))} AS letters
                  FROM (SELECT chrom, generate_subscripts(l, 1) - 1 AS p, upper(unnest(l)) AS c
                        FROM (SELECT chrom, regexp_extract_all(s, '(?s).') AS l FROM contigs))
                  WINDOW w AS (PARTITION BY chrom ORDER BY p ROWS BETWEEN 300 PRECEDING AND 300 FOLLOWING), o AS (PARTITION BY chrom ORDER BY p))
            WHERE k = 601)))
    GROUP BY ALL""")
def _(spark, sf):
    df = bias.bin_rates(ref_chunks(spark, sf), LITERAL_MODEL, 1000)
    return df.select("chrom", "bin", "positions", r6(F.col("expected")).alias("expected"), r6(F.col("var")).alias("var"), r6(F.col("gc")).alias("gc"))


@query("a58_bias_chain")
def _(spark, sf):
    """Counts to normalised bins: fit, rates, bins, outlier cut, refine curve, rates and bins with it.

    The sequence, the read positions and the first bins are written once; every later step reads those tables.
    """
    chunks = ref_chunks(spark, sf)
    tiles = materialise(bias.sequence_tiles(chunks, bias.TILE, bias.window_halo(FRAGMENT, OFFSETS)), "sequence-tiles")
    spots = bias.spots(_marked(spark, sf, tiles.groupBy("chrom").agg(F.max(F.col("lo") + F.length("seq")).alias("_length"))))
    model = bias.fit_bias(bias.covariate_cells(bias.covariates(spots, chunks, FRAGMENT, OFFSETS, tiles=tiles)), FRAGMENT, OFFSETS)
    reads = spots.select("chrom", "pos", F.col("reads").alias("n"))
    first = materialise(bias.observed_bins(bias.bin_rates(chunks, model, 1000, tiles=tiles), reads, 1000), "first-bins").withColumn("all", F.lit(1))
    curve = bias.fit_refine_curve(bic.ratio_outlier_cut(first.filter("expected > 0"), ["all"]))
    bins = bias.observed_bins(bias.bin_rates(chunks, dataclasses.replace(model, refine=curve), 1000, tiles=tiles), reads, 1000)
    return bins.select("chrom", "bin", "positions", "gc", "obs", "expected", "var")


@query("a59_refine_curve")
def _(spark, sf):
    cut = bic.ratio_outlier_cut(bic_bins(spark, sf).filter("expected > 0"), ["sample"])
    spline, intercept, coefficients = bias.fit_refine_curve(cut)
    grid = cut.groupBy(F.round("gc", 2).alias("gc")).agg(F.count("*").alias("bins"), F.avg("log_ratio").alias("mean_log_ratio"))
    return grid.select("gc", "bins", "mean_log_ratio", (F.lit(intercept) + spline.column(F.col("gc"), coefficients)).alias("curve"))


@query("a59_ratio_outlier_cut", """
    SELECT sample, chrom, bin, round(lr, 6) + 0.0 AS log_ratio FROM (
      SELECT *, quantile_cont(lr, 0.25) OVER (PARTITION BY sample) AS a, quantile_cont(lr, 0.75) OVER (PARTITION BY sample) AS b
      FROM (SELECT *, ln(obs / expected + 1e-10) AS lr FROM bic_bins WHERE obs > 0))
    WHERE lr BETWEEN a - 2 * (b - a) AND b + 2 * (b - a)""")
def _(spark, sf):
    df = bic.ratio_outlier_cut(bic_bins(spark, sf), ["sample"])
    return df.select("sample", "chrom", "bin", r6(F.col("log_ratio")).alias("log_ratio"))


@query("a60_gc_loess_ratio")
def _(spark, sf):
    return segmentation.gc_loess_ratio(bic_bins(spark, sf)).select("sample", "chrom", "bin", "ratio")


def _ratios(spark, sf):
    return bic_bins(spark, sf).withColumn("ratio", F.col("obs") / F.col("expected"))


@query("a61_a62_mixture_models")
def _(spark, sf):
    m = segmentation.copy_ratio_models(_ratios(spark, sf))
    return m.select("sample", "n", "alpha", "xi", "bic", "ploidy", "D", "omega", "impurity")


_P = [0.05, 0.15, 0.5, 0.2, 0.1]


def _literal_model(df):
    p = F.array(*[F.lit(x) for x in _P])
    mu = bic.component_means(F.lit(0.2), F.lit(0.05), len(_P))
    return df.withColumn("p", p).withColumn("mu", mu).withColumn("var", F.array(*[F.lit(0.04)] * len(_P)))


add_cte("mix_scores", "SELECT sample, chrom, bin, ratio, " + ", ".join(
    f"{p}::DOUBLE * exp(-pow(ratio - ({i / 2} + 0.2 * (1 - {i / 2}) + 0.05), 2) / 0.08) / sqrt(2 * pi() * 0.04) AS d{i}"
    for i, p in enumerate(_P)) + " FROM (SELECT *, obs / expected AS ratio FROM bic_bins)")
add_cte("mix_copy", """
    SELECT sample, chrom, bin, ratio, CAST(CASE WHEN m > 1e-6 THEN CASE m WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 WHEN d3 THEN 3 ELSE 4 END
           ELSE CASE WHEN near = 5 THEN 5 ELSE near - 1 END END AS INTEGER) AS copy_number
    FROM (SELECT *, greatest(d0, d1, d2, d3, d4) AS m, list_position(dist, list_min(dist)) AS near FROM (
      SELECT *, [""" + ", ".join(f"abs(ratio - ({i / 2} + 0.2 * (1 - {i / 2}) + 0.05))" for i in range(5)) + """] AS dist FROM mix_scores))""")


@query("a63_copy_number_from_mixture", "SELECT sample, chrom, bin, copy_number FROM mix_copy")
def _(spark, sf):
    df = _literal_model(_ratios(spark, sf))
    cn = bic.predicted_copy_number(F.col("ratio"), F.col("p"), F.col("mu"), F.col("var"))
    return df.select("sample", "chrom", "bin", cn.cast("int").alias("copy_number"))


@query("a59_neutral_bins", """
    SELECT m.sample, chrom, bin FROM mix_copy m JOIN (
      SELECT sample, arg_max(copy_number, k * 100 - copy_number) AS ploidy, coalesce(sum(k) FILTER (copy_number = 2), 0) / sum(k) AS two
      FROM (SELECT sample, copy_number, count(*) AS k FROM mix_copy GROUP BY ALL) GROUP BY sample) p ON p.sample = m.sample
    WHERE NOT (ploidy = 2 OR two > 0.2) OR copy_number = 2""")
def _(spark, sf):
    df = _literal_model(_ratios(spark, sf))
    cn = bic.predicted_copy_number(F.col("ratio"), F.col("p"), F.col("mu"), F.col("var"))
    return bic.neutral_bins(df.withColumn("copy_number", cn.cast("int")), ["sample"]).select("sample", "chrom", "bin")


@query("a64_non_neutral_bins", "SELECT sample, chrom, bin, copy_number FROM mix_copy WHERE copy_number <> 2")
def _(spark, sf):
    df = _literal_model(_ratios(spark, sf)).withColumn("ploidy", F.lit(2))
    cn = bic.predicted_copy_number(F.col("ratio"), F.col("p"), F.col("mu"), F.col("var"))
    return bic.non_neutral(df.withColumn("copy_number", cn.cast("int"))).select("sample", "chrom", "bin", "copy_number")


@query("a62_ploidy_purity", """
    SELECT sample, round(D, 6) AS "D", round(1 - (1 - alpha) * D / 2, 6) AS omega, CAST(2 AS INTEGER) AS ploidy,
           round((1 - (1 - alpha) * D / 2) * D / (2 + (D - 2) * (1 - (1 - alpha) * D / 2)), 6) AS impurity
    FROM (SELECT sample, 0.1 + (count(*) % 50) / 100.0::DOUBLE AS alpha, 2.15::DOUBLE AS D FROM bic_bins GROUP BY sample)""")
def _(spark, sf):
    df = bic_bins(spark, sf).groupBy("sample").agg((F.lit(0.1) + (F.count("*") % 50) / F.lit(100.0)).alias("alpha"))
    m = bic.ploidy_and_purity(df.withColumn("p", F.array(*[F.lit(x) for x in _P])))
    return m.select("sample", r6(F.col("D")).alias("D"), r6(F.col("omega")).alias("omega"), "ploidy", r6(F.col("impurity")).alias("impurity"))


@query("a65_mad_cut", """
    SELECT sample, chrom, bin FROM (
      SELECT *, quantile_cont(abs(ratio - med), 0.5) OVER (PARTITION BY sample) AS mad FROM (
        SELECT *, quantile_cont(ratio, 0.5) OVER (PARTITION BY sample) AS med FROM (SELECT *, obs / expected AS ratio FROM bic_bins)))
    WHERE abs(ratio - med) <= 10.0 * 1.4826 * mad""")
def _(spark, sf):
    return bic.mad_cut(_ratios(spark, sf), ["sample"], "ratio").select("sample", "chrom", "bin")


add_cte("noise", """SELECT sample, avg((pow(obs - expected, 2) - expected) / (expected * expected)) AS theta, avg(var / expected) AS vmr
    FROM bic_bins WHERE expected > 0 GROUP BY sample""")


@query("a66_a67_noise_and_penalty", """
    SELECT sample, round(theta, 6) + 0.0 AS theta, round(vmr, 6) AS var_mean_ratio, round(2.0 * (greatest(theta, 0) + 1), 6) AS lam,
           round(2.0 * pow(greatest(theta, 0) + 1, 2), 6) AS lam_strict FROM noise""")
def _(spark, sf):
    df = bic.noise_factor(bic_bins(spark, sf), ["sample"])
    return df.select("sample", r6(F.col("theta")).alias("theta"), r6(F.col("var_mean_ratio")).alias("var_mean_ratio"),
                     r6(bic.penalty(F.col("theta"), 2.0)).alias("lam"), r6(bic.penalty(F.col("theta"), 2.0, True)).alias("lam_strict"))


# Runs of four bins stand for segments of the statistics below.
add_cte("runs", """
    SELECT sample, chrom, chrom_num, chrom_num * 1000 + bin // 4 AS seg_id, min(start) AS start, max("end") AS "end", count(*) AS bin_num,
           CAST(sum(obs) AS BIGINT) AS obs, sum(expected) AS expected FROM bic_bins GROUP BY ALL""")


def _runs(spark, sf):
    return (bic_bins(spark, sf).groupBy("sample", "chrom", "chrom_num", (F.col("chrom_num") * 1000 + F.expr("bin div 4")).alias("seg_id"))
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("bin_num"), F.sum("obs").alias("obs"),
                 F.sum("expected").alias("expected")))


_ERFC = ("t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 "
         "+ t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))")
add_cte("numbered", "SELECT *, row_number() OVER (PARTITION BY sample ORDER BY chrom_num, start) - 1 AS idx, "
        "count(*) OVER (PARTITION BY sample) AS n_bins FROM bic_bins")
add_cte("drawn", """
    SELECT sample, seg_id, avg(f) AS mu, stddev_samp(f) AS sd FROM (
      SELECT d.sample, d.seg_id, d.draw, sum(b.obs) / (sum(b.obs) + sum(b.expected) + 1e-10) AS f
      FROM (SELECT *, ((seg_id * 7368787 + draw * 1299709 + k * 15485863) % 2147483647 * 48271) % 2147483647 % nb AS idx FROM (
              SELECT r.sample, seg_id, nb, draw, unnest(range(1, bin_num + 1)) AS k FROM (
                SELECT sample, seg_id, bin_num, unnest(range(1, 101)) AS draw FROM runs) r
              JOIN (SELECT sample, count(*) AS nb FROM bic_bins GROUP BY sample) z ON z.sample = r.sample)) d
      JOIN numbered b ON b.sample = d.sample AND b.idx = d.idx GROUP BY ALL) GROUP BY ALL""")


@query("a68_segment_significance", f"""
    SELECT sample, seg_id, round(z, 6) + 0.0 AS z, round({_ERFC}, 6) AS pvalue FROM (
      SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + abs(z) / sqrt(2.0) / 2) AS t FROM (
        SELECT r.sample, r.seg_id, (obs / (obs + expected + 1e-10) - mu) / greatest(sd, 0.01) AS z
        FROM runs r JOIN drawn d ON d.sample = r.sample AND d.seg_id = r.seg_id))""")
def _(spark, sf):
    df = bic.resampled_significance(_runs(spark, sf), bic_bins(spark, sf))
    return df.select("sample", "seg_id", r6(F.col("z")).alias("z"), r6(F.col("pvalue")).alias("pvalue"))


add_cte("counted_regions", """
    SELECT m.sample, r.region, count(b.obs) AS n, CAST(coalesce(sum(b.obs), 0) AS BIGINT) AS obs, coalesce(sum(b.expected), 0) AS expected
    FROM (SELECT DISTINCT sample, 'E' || lpad(CAST(sample_idx AS VARCHAR), 5, '0') AS experiment FROM reads) m
    JOIN regions r ON r.experiment = m.experiment
    LEFT JOIN bic_bins b ON b.sample = m.sample AND b.chrom = r.chrom AND b.start <= r."end" AND r.start <= b."end"
    GROUP BY m.sample, r.region""")
add_cte("circular_runs", """
    SELECT s.sample, s.n, a.idx, round((sum(b.obs) + 1e-10) / (sum(b.obs) + sum(b.expected) + 1e-10), 9) AS f
    FROM (SELECT DISTINCT sample, n FROM counted_regions WHERE n > 0) s JOIN numbered a ON a.sample = s.sample
    JOIN numbered b ON b.sample = a.sample AND (b.idx - a.idx + a.n_bins) % a.n_bins < s.n GROUP BY s.sample, s.n, a.idx""")


@query("a70_region_significance", f"""
    SELECT sample, region, round(log2_ratio, 6) + 0.0 AS log2_ratio,
           round(CASE WHEN n = 0 THEN 1.0 WHEN expected > 100 THEN {_ERFC}
                 WHEN least(lo, hi) > 0 THEN least(1.0, 2 * least(lo, hi) / CAST(m AS DOUBLE)) ELSE 1 / CAST(m AS DOUBLE) END, 6) AS pvalue
    FROM (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + abs(z) / sqrt(2.0) / 2) AS t FROM (
      SELECT c.sample, c.region, any_value(c.n) AS n, any_value(c.expected) AS expected, any_value(log2_ratio) AS log2_ratio, count(f) AS m,
             count(*) FILTER (f <= round(fr + 0.01, 9)) AS lo, count(*) FILTER (f >= round(fr - 0.01, 9)) AS hi,
             (any_value(fr) - avg(f)) / greatest(stddev_samp(f), 0.01) AS z
      FROM (SELECT *, round(CASE WHEN obs + expected = 0 THEN t_obs / (t_obs + t_exp) ELSE (obs + 1e-10) / (obs + expected + 1e-10) END, 9) AS fr,
                   CASE WHEN obs + expected = 0 THEN 0.0 ELSE log2((obs + 1e-10) / (expected + 1e-10) + 1e-10)
                        - log2(t_obs / (t_exp + 1e-10) + 1e-10) END AS log2_ratio
            FROM counted_regions JOIN (SELECT sample, sum(obs) AS t_obs, sum(expected) AS t_exp FROM bic_bins GROUP BY sample) USING (sample)) c
      LEFT JOIN circular_runs r ON r.sample = c.sample AND r.n = c.n GROUP BY c.sample, c.region))""")
def _(spark, sf):
    from karyospark.plans.interval_queries import _read_experiment
    m = _read_experiment(spark, sf).select("sample", "experiment").distinct()
    asked = regions(spark, sf).join(m, "experiment").select("sample", "region", "chrom", "start", "end")
    # Regions are short against the bins here, so the plain overlap counts are the input.
    b = bic_bins(spark, sf)
    counted = track_overlap_sum(asked, b, ["sample", "chrom"], {"obs": "obs", "expected": "expected"}, closed=True).drop("chrom", "start", "end")
    df = bic.region_significance(counted.withColumn("expected", F.round("expected", 9)), b)
    return df.select("sample", "region", r6(F.col("log2_ratio")).alias("log2_ratio"), r6(F.col("pvalue")).alias("pvalue"))


@query("a71_low_expectation_drop", """
    SELECT sample, seg_id FROM (SELECT *, sum(expected) OVER (PARTITION BY sample) / sum("end" - start + 1) OVER (PARTITION BY sample) AS m
      FROM runs) WHERE expected / ("end" - start + 1) >= m / 5""")
def _(spark, sf):
    return bic.drop_low_expectation(_runs(spark, sf), ["sample"]).select("sample", "seg_id")


add_cte("centred", """SELECT *, log2((obs + 1e-10) / (expected + 1e-10)) - log2(sum(obs) OVER (PARTITION BY sample)
    / sum(expected) OVER (PARTITION BY sample) + 1e-10) AS log2_ratio FROM runs""")


@query("a72_centred_log2", "SELECT sample, seg_id, round(log2_ratio, 6) + 0.0 AS log2_ratio FROM centred")
def _(spark, sf):
    df = bic.centred_log2(_runs(spark, sf), ["sample"])
    return df.select("sample", "seg_id", r6(F.col("log2_ratio")).alias("log2_ratio"))


@query("a72_many_sample_log2", """
    SELECT seg_id, round(log2((obs + 1e-10) / (expected + 1e-10)) - log2(sum(obs) OVER () / sum(expected) OVER () + 1e-10), 6) + 0.0 AS log2_ratio
    FROM (SELECT seg_id, sum(obs) AS obs, sum(expected) AS expected FROM runs GROUP BY seg_id)""")
def _(spark, sf):
    both = _runs(spark, sf).groupBy("seg_id").agg(F.sum("obs").alias("obs"), F.sum("expected").alias("expected")).withColumn("all", F.lit(1))
    return bic.centred_log2(both, ["all"]).select("seg_id", r6(F.col("log2_ratio")).alias("log2_ratio"))


add_cte("role_bins", """
    SELECT * FROM (SELECT sample, chrom, chrom_num, bin, start, "end", obs AS tumor, expected AS tumor_expected,
           CASE WHEN bin % 2 = 0 THEN obs + 1 ELSE obs END AS normal, expected + 0.25 AS normal_expected FROM bic_bins)""")
add_cte("role_runs", """
    SELECT sample, chrom, chrom_num, chrom_num * 1000 + bin // 4 AS seg_id, min(start) AS start, max("end") AS "end", count(*) AS bin_num,
           sum(tumor) AS tumor, sum(tumor_expected) AS tumor_expected, sum(normal) AS normal, sum(normal_expected) AS normal_expected
    FROM role_bins GROUP BY ALL""")


def _role_bins(spark, sf):
    normal = F.when(F.col("bin") % 2 == 0, F.col("obs") + 1).otherwise(F.col("obs"))
    return bic_bins(spark, sf).select("sample", "chrom", "chrom_num", "bin", "start", "end", F.col("obs").alias("tumor"),
                                      F.col("expected").alias("tumor_expected"), normal.alias("normal"),
                                      (F.col("expected") + 0.25).alias("normal_expected"))


ROLES = ["tumor", "tumor_expected", "normal", "normal_expected"]


def _role_runs(spark, sf):
    return _role_bins(spark, sf).groupBy("sample", "chrom", "chrom_num", (F.col("chrom_num") * 1000 + F.expr("bin div 4")).alias("seg_id")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("bin_num"), *[F.sum(c).alias(c) for c in ROLES])


@query("a72_two_sample_log2", """
    SELECT sample, seg_id, round(log2(tumor / tumor_expected / (normal / normal_expected + 1e-10) + 1e-10) - log2(wt / wn + 1e-10), 6) + 0.0 AS log2_ratio,
           round(log2(tumor / tumor_expected / (normal / normal_expected) + 1e-10) - log2(wt + 1e-10), 6) + 0.0 AS log2_tumor_expected
    FROM (SELECT *, sum(tumor) OVER (PARTITION BY sample) / sum(tumor_expected) OVER (PARTITION BY sample) AS wt,
                 sum(normal) OVER (PARTITION BY sample) / sum(normal_expected) OVER (PARTITION BY sample) AS wn FROM role_runs)""")
def _(spark, sf):
    df = bic.two_sample_log2(_role_runs(spark, sf), ["sample"])
    return df.select("sample", "seg_id", r6(F.col("log2_ratio")).alias("log2_ratio"), r6(F.col("log2_tumor_expected")).alias("log2_tumor_expected"))


@query("a73_neutral_recentring", """
    SELECT sample, seg_id, round(adjust, 6) + 0.0 AS adjust, round(log2(obs / expected + 1e-10) - adjust, 6) + 0.0 AS log2_ratio FROM (
      SELECT *, CASE WHEN coalesce(o, 0) >= 1000 THEN log2(o / e) ELSE 0.0 END AS adjust FROM (
        SELECT *, sum(obs) FILTER (abs(log2_ratio) <= 0.3) OVER (PARTITION BY sample) AS o,
               sum(expected) FILTER (abs(log2_ratio) <= 0.3) OVER (PARTITION BY sample) AS e FROM centred))""")
def _(spark, sf):
    df = bic.recentre_on_neutral(bic.centred_log2(_runs(spark, sf), ["sample"]), ["sample"])
    return df.select("sample", "seg_id", r6(F.col("adjust")).alias("adjust"), r6(F.col("log2_ratio")).alias("log2_ratio"))


@query("a74_role_renormalisation", """
    SELECT sample, seg_id, round(tumor / tumor_expected * bin_num * (sum(tumor) OVER w / sum(bin_num) OVER w), 6) AS tumor_value,
           round(normal / normal_expected * bin_num * (sum(normal) OVER w / sum(bin_num) OVER w), 6) AS normal_value
    FROM role_runs WINDOW w AS (PARTITION BY sample)""")
def _(spark, sf):
    df = bic.renormalise_roles(_role_runs(spark, sf), ["sample"])
    return df.select("sample", "seg_id", r6(F.col("tumor_value")).alias("tumor_value"), r6(F.col("normal_value")).alias("normal_value"))


@query("a75_roll_up", """
    SELECT sample, chrom_num, start, "end", bin_num, CAST(tumor AS BIGINT) AS tumor, CAST(normal AS BIGINT) AS normal, true AS agrees FROM role_runs""")
def _(spark, sf):
    fine = _role_bins(spark, sf).withColumn("bin_num", F.lit(1).cast("bigint"))
    df = bic.roll_up(fine, _role_runs(spark, sf), ["sample"], ["tumor", "normal"])
    return df.select("sample", "chrom_num", "start", "end", "bin_num", "tumor", "normal", "agrees")


@query("a76_common_cnv", """
    SELECT seg_id, bool_and(up) AND count(DISTINCT sample) > 1 AS common FROM (
      SELECT sample, seg_id, log2(tumor / normal + 0.001) >= 0.5 OR log2(tumor / normal + 0.001)
             >= log2(sum(tumor) OVER (PARTITION BY sample) / sum(normal) OVER (PARTITION BY sample) + 0.001) + 0.5 AS up FROM role_runs)
    GROUP BY seg_id""")
def _(spark, sf):
    return bic.common_cnv(_role_runs(spark, sf), ["seg_id"])


# Samples of one sex together: a single sample of the given tables has at most a read or two in most bins.
add_cte("pooled_bins", """SELECT CASE WHEN CAST(substring(sample, 2) AS BIGINT) % 2 = 0 THEN 'female' ELSE 'male' END AS sample, chrom, bin,
    CAST(sum(obs) AS BIGINT) AS obs, any_value(gc) AS gc FROM bic_bins GROUP BY 1, 2, 3""")


def _pooled(spark, sf):
    sex = F.when(F.substring("sample", 2, 10).cast("bigint") % 2 == 0, "female").otherwise("male")
    return bic_bins(spark, sf).groupBy(sex.alias("sample"), "chrom", "bin").agg(F.sum("obs").alias("obs"), F.max("gc").alias("gc"))


@query("a77_count_gc_histogram", """
    SELECT sample, least(CAST(floor(gc * 20) AS BIGINT), 19) AS gc_class, least(CAST(floor((obs - lo) / (hi - lo) * 20) AS BIGINT), 19) AS n_class,
           count(*) AS bins
    FROM (SELECT *, a - 0.6 * (b - a) AS lo, b + 0.6 * (b - a) AS hi FROM (
      SELECT *, quantile_cont(obs::DOUBLE, 0.05) OVER (PARTITION BY sample) AS a, quantile_cont(obs::DOUBLE, 0.95) OVER (PARTITION BY sample) AS b FROM pooled_bins))
    WHERE obs >= lo AND obs <= hi AND hi > lo GROUP BY ALL""")
def _(spark, sf):
    return bic.count_gc_histogram(_pooled(spark, sf))


# --- sequential solvers: rows-only here, tested against planted answers -------------------------

def _gc_track(spark):
    return bin_grid(spark, READ_BIN).select("chrom", "bin", gc_of_bin().alias("gc"))


@query("w06_gc_lowess")
def _(spark, sf):
    track = per_bin(_gc_track(spark), READ_BIN)
    bins = _first(spark, sf).join(track, ["chrom", "bin"])
    return segmentation.gc_lowess(bins).select("sample", "chrom", "bin", "value")


@query("w11_u01_cbs_segments")
def _(spark, sf):
    return segmentation.cbs_segments(_log2(spark, sf))


@query("w12_bic_segments")
def _(spark, sf):
    bins = bic.with_theta(bic_bins(spark, sf), "sample").withColumn("lam", bic.penalty(F.col("theta"), 2.0))
    return segmentation.bic_segments(bins, [("obs", "expected")])


# One merge of a chromosome a step; lists hold its segments in order.
@query("w13_close_neighbour_merge", """
    SELECT sample, chrom, unnest(s) AS start, unnest(e) AS "end", unnest(nb) AS bin_num, unnest(o) AS obs,
           unnest(list_transform(x, lambda v: round(v, 6) + 0.0)) AS expected, unnest(list_transform(l, lambda v: round(v, 6) + 0.0)) AS log2_ratio
    FROM (
      WITH RECURSIVE merged AS (
        SELECT sample, chrom, any_value(adjust) AS adjust, list(start ORDER BY start) AS s, list("end" ORDER BY start) AS e,
               list(bin_num ORDER BY start) AS nb, list(CAST(obs AS DOUBLE) ORDER BY start) AS o, list(expected ORDER BY start) AS x,
               list(log2(obs / expected + 1e-10) - adjust ORDER BY start) AS l
        FROM (SELECT *, CASE WHEN coalesce(no, 0) >= 1000 THEN log2(no / ne) ELSE 0.0 END AS adjust FROM (
                SELECT *, sum(obs) FILTER (abs(log2_ratio) <= 0.3) OVER (PARTITION BY sample) AS no,
                       sum(expected) FILTER (abs(log2_ratio) <= 0.3) OVER (PARTITION BY sample) AS ne FROM centred))
        GROUP BY sample, chrom
        UNION ALL
        SELECT sample, chrom, adjust, s[:i] || s[i + 2:], e[:i - 1] || e[i + 1:], nb[:i - 1] || [nb[i] + nb[i + 1]] || nb[i + 2:],
               o[:i - 1] || [oi] || o[i + 2:], x[:i - 1] || [xi] || x[i + 2:], l[:i - 1] || [log2(oi / xi + 1e-10) - adjust] || l[i + 2:]
        FROM (SELECT *, list_position(d, list_min(d)) AS i, o[i] + o[i + 1] AS oi, x[i] + x[i + 1] AS xi
              FROM (SELECT *, list_transform(range(1, len(l)), lambda k: abs(l[k + 1] - l[k])) AS d FROM merged)
              WHERE list_min(d) <= 0.1))
      SELECT * FROM merged QUALIFY len(s) = min(len(s)) OVER (PARTITION BY sample, chrom))""")
def _(spark, sf):
    df = segmentation.merge_close(bic.recentre_on_neutral(bic.centred_log2(_runs(spark, sf), ["sample"]), ["sample"]))
    return df.withColumns({c: r6(F.col(c)) for c in ("expected", "log2_ratio")})


@query("a01_to_w11_whole_chain")
def _(spark, sf):
    """Reads to CBS segments with a blacklist, GC correction and the second pass."""
    from karyospark.plans.track_queries import _base
    first = ratio_chain.first_pass(reads(spark, sf), READ_BIN, gc=_gc_track(spark))
    black = ratio_chain.blacklist(first, _base(spark), READ_BIN)
    masked = ratio_chain.first_pass(reads(spark, sf), READ_BIN, black, _gc_track(spark))
    log2 = ratio_chain.second_pass(ratio_chain.ratios(masked, READ_BIN), READ_BIN)
    return segmentation.cbs_segments(log2.filter("NOT masked"))
