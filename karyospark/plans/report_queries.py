"""Stored-result queries: aberrations, reports, listings, parameter sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions import calls
from karyospark.operators import reports
from karyospark.plans.projections import (
    add_cte, algorithms, annotations, parameters, result_segments, results, samples, segments, table,
)
from karyospark.plans.registry import query
from karyospark.plans.track_queries import r6
from karyospark.session import scratch_path
from karyospark.sources import sinks

add_cte("result_sex", """
    SELECT result_id, y_mean, CASE WHEN y_mean IS NULL THEN 'unknown' WHEN y_mean < 0.3 THEN 'female' ELSE 'male' END AS sex
    FROM (SELECT result_id, sum(copy_number * greatest("end" - start, 1)) FILTER (chrom = 'Y')
                 / sum(greatest("end" - start, 1)) FILTER (chrom = 'Y') AS y_mean FROM result_segments GROUP BY result_id)""")
add_cte("aberrant", """
    SELECT *, CASE WHEN copy_number > e THEN 'gain' ELSE 'loss' END AS type, "end" - start AS size,
           (CASE WHEN copy_number > e THEN '+' ELSE '-' END) || chrom || (CASE WHEN k > 1 THEN 's' ELSE '' END) AS aberration_code
    FROM (SELECT *, round_even(abs(copy_number - e), 1) AS mosaicism FROM (
      SELECT s.*, sex, count(*) OVER (PARTITION BY s.result_id, chrom) AS k,
             CAST(CASE WHEN sex = 'female' AND chrom = 'Y' THEN 0 WHEN sex = 'male' AND chrom IN ('X', 'Y') THEN 1 ELSE 2 END
                  AS DOUBLE) AS e
      FROM result_segments s JOIN result_sex x ON x.result_id = s.result_id)) WHERE mosaicism >= 0.3""")
add_cte("listing", """
    SELECT r.*, p.algorithm_id, algorithm_name, version, s.name AS sample_name, flowcell_id, cycle_id, embryo_id,
           cell_type, reference_genome
    FROM results r JOIN parameters p USING (parameter_id) JOIN algorithms a ON a.algorithm_id = p.algorithm_id
    JOIN samples s ON s.id = r.sample_id""")


def _aberrant(spark, sf):
    return reports.aberrations(result_segments(spark, sf))


def _listing(spark, sf):
    return reports.result_listing(results(spark, sf), samples(spark, sf), parameters(spark, sf), algorithms(spark, sf))


@query("a45_result_sex", "SELECT result_id, round(y_mean, 6) AS y_mean, sex FROM result_sex")
def _(spark, sf):
    df = reports.sex_of_results(result_segments(spark, sf))
    return df.withColumn("y_mean", r6(F.col("y_mean")))


@query("a46_p32_p33_aberrations", """
    SELECT result_id, chrom, start, "end", line, type, mosaicism, size, aberration_code FROM aberrant""")
def _(spark, sf):
    return _aberrant(spark, sf).select("result_id", "chrom", "start", "end", "line", "type", "mosaicism", "size",
                                       "aberration_code")


@query("a46_aberration_summary", """
    SELECT result_id, string_agg(aberration_code, ',' ORDER BY chrom_num, start, line, aberration_code) AS codes
    FROM aberrant GROUP BY result_id""")
def _(spark, sf):
    df = reports.aberration_summary(_aberrant(spark, sf), ["chrom_num", "start", "line"])
    return df.withColumn("codes", F.array_join("codes", ","))


@query("j24_p35_o05_annotation", """
    SELECT g.result_id, g.chrom, g.start, g.line, n_annotations, first_id, labels FROM (
      SELECT DISTINCT result_id, chrom, start, "end", line, tag, tag2 FROM aberrant) g
    LEFT JOIN (SELECT result_id, chrom, start, "end", line, tag, tag2, count(*) AS n_annotations,
               min(annotation_id) AS first_id, string_agg(label, '|' ORDER BY annotation_id) FILTER (rk <= 10) AS labels
        FROM (SELECT a.result_id, a.chrom, a.start, a."end", a.line, a.tag, a.tag2, n.annotation_id,
                     n.phenotype || ' (' || n.omim_id || ')' AS label,
                     row_number() OVER (PARTITION BY a.result_id, a.chrom, a.start, a."end", a.line, a.tag, a.tag2
                                        ORDER BY n.annotation_id) AS rk
              FROM (SELECT DISTINCT result_id, chrom, start, "end", line, tag, tag2 FROM aberrant) a
              JOIN annotations n ON n.chrom = a.chrom AND n.start < a."end" AND a.start < n."end") GROUP BY ALL) h
    ON h.result_id = g.result_id AND h.chrom = g.chrom AND h.start = g.start AND h."end" = g."end" AND h.line = g.line
       AND h.tag = g.tag AND h.tag2 = g.tag2""")
def _(spark, sf):
    key = ["result_id", "chrom", "start", "end", "line", "tag", "tag2"]
    seg = _aberrant(spark, sf).select(*key).distinct()
    df = reports.annotate(seg, annotations(spark, sf))
    return df.select("result_id", "chrom", "start", "line", "n_annotations", F.get("annotation", F.lit(0))["annotation_id"].alias("first_id"),
                     F.array_join("labels", "|").alias("labels"))


@query("j24_assessment_from_annotation", """
    SELECT chrom, assessment, count(*) AS n FROM (
      SELECT g.chrom, CASE h.acmg WHEN '5' THEN 'pathogenic' WHEN '4' THEN 'probably_pathogenic' WHEN '2' THEN 'probably_benign'
             WHEN '1' THEN 'benign' ELSE 'unknown' END AS assessment
      FROM (SELECT DISTINCT result_id, chrom, start, "end", line, tag, tag2 FROM aberrant) g
      LEFT JOIN (SELECT a.result_id, a.line, a.tag, a.tag2, min_by(acmg, annotation_id) AS acmg FROM aberrant a
                 JOIN annotations n ON n.chrom = a.chrom AND n.start < a."end" AND a.start < n."end" GROUP BY ALL) h
      ON h.result_id = g.result_id AND h.line = g.line AND h.tag = g.tag AND h.tag2 = g.tag2) GROUP BY ALL""")
def _(spark, sf):
    key = ["result_id", "chrom", "start", "end", "line", "tag", "tag2"]
    df = reports.annotate(_aberrant(spark, sf).select(*key).distinct(), annotations(spark, sf), top=1)
    # Segments of one number, if a table repeats it, share their annotations.
    one = Window.partitionBy("result_id", "line", "tag", "tag2")
    first = F.min(F.get(F.col("annotation"), F.lit(0))).over(one)
    df = df.withColumn("assessment", F.coalesce(calls.assessment(first["acmg"]), F.lit("unknown")))
    return df.groupBy("chrom", "assessment").agg(F.count("*").alias("n"))


@query("j16_ratio_by_containment", """
    SELECT id, coalesce(min_by(ratio, row_id), 0.0) AS ratio, min(row_id) IS NULL AS missing FROM (
      SELECT embryo_id AS id FROM samples UNION SELECT 'Q' || id FROM samples) i
    LEFT JOIN (SELECT o_orderkey AS row_id, 'FC' || (o_custkey // 100) || '-CY-' || (o_custkey // 10) || '-E' || o_custkey AS nm,
               (o_orderkey % 100) / 100.0::DOUBLE AS ratio FROM orders) s
      ON contains(s.nm, i.id) GROUP BY id""")
def _(spark, sf):
    s = samples(spark, sf)
    ids = s.select(F.col("embryo_id").alias("id")).union(s.select(F.concat(F.lit("Q"), F.col("id").cast("string")))).distinct()
    who = F.col("o_custkey")
    stats = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.concat(
            F.lit("FC"), F.expr("o_custkey div 100").cast("string"), F.lit("-CY-"), F.expr("o_custkey div 10").cast("string"),
            F.lit("-E"), who.cast("string")).alias("stats_sample"), ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("ratio"))
    return reports.lookup_by_containment(ids, stats, "row_id").select("id", "ratio", "missing")


@query("j17_j18_file_selection", """
    SELECT coalesce(f.cycle_key, w.key) AS key, CASE WHEN f.cycle_key IS NULL THEN 'missing' ELSE 'selected' END AS status,
           f.file_name AS file FROM (
      SELECT regexp_replace(regexp_replace(file_name, '_S\\d+\\.bam$', ''), '^[^-]*-', '') AS cycle_key, file_name FROM samples) f
    RIGHT JOIN (SELECT DISTINCT 'CY-' || (o_custkey // 10) || '-E' || (o_custkey + o_orderkey % 2 * 1000000000) AS key FROM orders) w
    ON w.key = f.cycle_key""")
def _(spark, sf):
    from karyospark.functions.names import cycle_embryo_key
    files = samples(spark, sf).select(cycle_embryo_key(F.col("file_name")).alias("key"), F.col("file_name").alias("file"))
    wanted = table(spark, sf, "orders").select(F.concat(
        F.lit("CY-"), F.expr("o_custkey div 10").cast("string"), F.lit("-E"),
        (F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000_000).cast("string")).alias("key")).distinct()
    chosen, missing = reports.select_files(files, wanted, "key")
    return chosen.select("key", F.lit("selected").alias("status"), "file").unionByName(
        missing.select("key", F.lit("missing").alias("status"), F.lit(None).cast("string").alias("file")))


@query("j19_o03_result_listing", """
    SELECT result_id, sample_name, algorithm_name, version, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
           row_number() OVER (PARTITION BY sample_id ORDER BY created_at DESC, result_id DESC) AS newest FROM listing""")
def _(spark, sf):
    w = Window.partitionBy("sample_id").orderBy(F.desc("created_at"), F.desc("result_id"))
    df = _listing(spark, sf).withColumn("newest", F.row_number().over(w).cast("bigint"))
    return df.select("result_id", "sample_name", "algorithm_name", "version",
                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "newest")


@query("j20_result_detail", """
    SELECT l.result_id, sample_name, n_segments, round(cn, 6) AS cn_sum, first_chrom FROM listing l
    LEFT JOIN (SELECT result_id, count(*) AS n_segments, sum(copy_number) AS cn,
                      min_by(chrom_num, chrom_num::BIGINT * 1000000000 + start) AS first_chrom FROM result_segments GROUP BY result_id) d
    ON d.result_id = l.result_id""")
def _(spark, sf):
    seg = result_segments(spark, sf)
    df = reports.result_detail(_listing(spark, sf), seg, seg.select("result_id", "chrom_num", "start", "end", "copy_number"))
    total = F.aggregate(F.transform("segments", lambda s: s["copy_number"]), F.lit(0.0), lambda a, x: a + x)
    return df.select("result_id", "sample_name", F.when(F.col("segments").isNotNull(), F.size("segments")).cast("bigint").alias("n_segments"),
                     r6(total).alias("cn_sum"), F.get("bins", F.lit(0))["chrom_num"].alias("first_chrom"))


@query("j21_sample_report", """
    SELECT l.result_id, sample_name, algorithm_name, 'bin_size=' || bin_size || ';method=' || method AS parameters,
           coalesce(n, 0) AS n_aberrations, codes FROM listing l JOIN parameters p USING (parameter_id)
    LEFT JOIN (SELECT result_id, count(*) AS n, string_agg(aberration_code, ',' ORDER BY chrom_num, start, "end", type, mosaicism)
               AS codes FROM aberrant GROUP BY result_id) a ON a.result_id = l.result_id""")
def _(spark, sf):
    df = reports.sample_report(_listing(spark, sf), parameters(spark, sf), _aberrant(spark, sf))
    ps = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    codes = F.array_join(F.transform("aberrations", lambda a: a["aberration_code"]), ",")
    n = F.when(F.col("aberrations").isNotNull(), F.size("aberrations")).otherwise(0).cast("bigint")
    return df.select("result_id", "sample_name", "algorithm_name", ps.alias("parameters"), n.alias("n_aberrations"),
                     codes.alias("codes"))


@query("j22_cycle_report", """
    SELECT request, l.result_id, embryo_id, coalesce(n, 0) AS n_aberrations,
           CASE WHEN n > 0 THEN 'Abnormal' ELSE 'Normal' END AS conclusion, consistent
    FROM (SELECT *, result_id // 4 AS request FROM listing) l
    JOIN (SELECT result_id // 4 AS request, count(DISTINCT cycle_id) = 1 AND count(DISTINCT flowcell_id) = 1 AS consistent
          FROM listing GROUP BY 1) c USING (request)
    LEFT JOIN (SELECT result_id, count(*) AS n FROM aberrant GROUP BY result_id) a ON a.result_id = l.result_id""")
def _(spark, sf):
    rows = _listing(spark, sf).withColumn("request", F.expr("result_id div 4"))
    df = reports.cycle_report(rows, _aberrant(spark, sf)).join(reports.same_cycle(rows), "request")
    return df.select("request", "result_id", "embryo_id", "n_aberrations", "conclusion", "consistent")


@query("j23_uniqueness_guard", """
    SELECT o_orderkey AS upload, EXISTS (SELECT 1 FROM results r WHERE r.sample_id = o_custkey AND r.parameter_id = p
           AND r.created_at < TIMESTAMP '1996-01-01') AS known
    FROM (SELECT *, (o_orderkey + 1) % 10 AS p FROM orders)""")
def _(spark, sf):
    stored = results(spark, sf).filter("created_at < TIMESTAMP '1996-01-01'")
    up = table(spark, sf, "orders").select(F.col("o_orderkey").alias("upload"), F.col("o_custkey").alias("sample_id"),
                                           ((F.col("o_orderkey") + 1) % 10).alias("parameter_id"))
    new, skip = reports.new_rows(up, stored, ["sample_id", "parameter_id"])
    return new.select("upload", F.lit(False).alias("known")).unionByName(skip.select("upload", F.lit(True).alias("known")))


@query("j25_bootstrap_attach", """
    SELECT a.seg_id, a.copy_number, b.pvalue FROM segments a JOIN (
      SELECT sample, algorithm, chrom_num, start, "end", seg_id, (seg_id % 97) / 97.0::DOUBLE AS pvalue FROM segments) b
    ON a.sample = b.sample AND a.algorithm = b.algorithm AND a.chrom_num = b.chrom_num AND a.start = b.start
       AND a."end" = b."end" AND a.seg_id = b.seg_id""")
def _(spark, sf):
    a = segments(spark, sf)
    b = a.select("sample", "algorithm", "chrom_num", "start", "end", "seg_id", ((F.col("seg_id") % 97) / F.lit(97.0)).alias("pvalue"))
    return a.join(b, ["sample", "algorithm", "chrom_num", "start", "end", "seg_id"]).select("seg_id", "copy_number", "pvalue")


@query("j26_algorithm_availability", """
    SELECT experiment, algorithm, count(*) FILTER (ok) = any_value(k) AS valid FROM (
      SELECT experiment, sample, algorithm, count(DISTINCT seg_id % 2) = 2 AS ok FROM segments GROUP BY ALL)
    JOIN (SELECT experiment, count(DISTINCT sample) AS k FROM segments GROUP BY experiment) USING (experiment) GROUP BY ALL""")
def _(spark, sf):
    kind = F.when(F.col("seg_id") % 2 == 0, "bins").otherwise("segments")
    files = segments(spark, sf).select("experiment", "sample", "algorithm", kind.alias("kind"))
    av = reports.available_algorithms(files).join(files.select("sample", "experiment").distinct(), "sample")
    return reports.valid_for_all(av, ["experiment"])


@query("a49_hierarchy", """
    SELECT flowcell_id, cycle_id, string_agg(name, ',' ORDER BY name) AS samples FROM samples GROUP BY ALL""")
def _(spark, sf):
    return reports.hierarchy(samples(spark, sf)).withColumn("samples", F.array_join("samples", ","))


@query("p39_parameter_rows", """
    SELECT parameter_id, algorithm_id, 'bin_size' AS name, 'int' AS type, '400000' AS default_value, bin_size AS value FROM parameters
    UNION ALL SELECT parameter_id, algorithm_id, 'method', 'str', 'cbs', method FROM parameters""")
def _(spark, sf):
    return reports.parameter_rows(parameters(spark, sf))


@query("p39_effective_parameters", """
    SELECT parameter_id, 'bin_size=' || bin_size || ';method=' || method || ';seed=' || parameter_id AS effective FROM parameters""")
def _(spark, sf):
    over = F.create_map(F.lit("method"), F.lit("ignored"), F.lit("seed"), F.col("parameter_id").cast("string"))
    df = reports.effective_parameters(parameters(spark, sf), over)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("effective")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return df.select("parameter_id", text.alias("effective"))


@query("p45_algorithm_key", "SELECT algorithm_id, algorithm_name || '_' || version AS key FROM algorithms")
def _(spark, sf):
    return algorithms(spark, sf).select(
        "algorithm_id", reports.algorithm_key(F.col("algorithm_name"), F.col("version")).alias("key"))


@query("o07_u03_parameter_reuse", """
    SELECT s.parameter_id, min(o.parameter_id) AS reused_id FROM parameters s
    JOIN parameters o ON o.algorithm_id = s.algorithm_id AND o.bin_size = s.bin_size AND o.method = s.method GROUP BY 1""")
def _(spark, sf):
    p = parameters(spark, sf)
    return reports.reuse_parameters(p, p).select("parameter_id", "reused_id")


@query("o07_unused_parameters", """
    SELECT parameter_id FROM parameters WHERE parameter_id NOT IN (SELECT parameter_id FROM results)""")
def _(spark, sf):
    return reports.unused_parameters(parameters(spark, sf), results(spark, sf)).select("parameter_id")


@query("u03_last_used_parameters", """
    SELECT algorithm_id, arg_max(parameter_id, (epoch(created_at)::BIGINT) * 1000000000 + result_id) AS last_parameter_id
    FROM results JOIN parameters USING (parameter_id) GROUP BY 1""")
def _(spark, sf):
    return reports.last_used(results(spark, sf), parameters(spark, sf))


@query("o06_union_of_rows", """
    SELECT source, count(*) AS n, CAST(sum(start) AS BIGINT) AS s FROM (
      SELECT algorithm AS source, start FROM segments UNION ALL SELECT 'result', start FROM result_segments) GROUP BY source""")
def _(spark, sf):
    a = segments(spark, sf).select(F.col("algorithm").alias("source"), "start")
    b = result_segments(spark, sf).select(F.lit("result").alias("source"), "start")
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"), F.sum("start").alias("s"))


@query("o08_missing_columns", """
    SELECT 'confidence' AS column_name, count(*) AS rows FROM segments GROUP BY 1
    UNION ALL SELECT 'end', 0 WHERE false""")
def _(spark, sf):
    seg = segments(spark, sf)
    lacking = reports.missing_columns(seg, ["chrom_num", "start", "end", "copy_number", "confidence"])
    return seg.select(F.explode(F.array(*[F.lit(c) for c in lacking])).alias("column_name")).groupBy("column_name").agg(
        F.count("*").alias("rows"))


@query("k07_csv_export", """
    SELECT result_id, chrom, start, "end", copy_number, printf('%.4f', confidence) AS confidence,
           CASE WHEN tag % 2 = 0 THEN 'Yes' ELSE 'No' END AS man_change FROM result_segments""")
def _(spark, sf):
    return sinks.round_trip(reports.export_segments(result_segments(spark, sf).withColumn("man_change", F.col("tag") % 2 == 0)), scratch_path(spark, "export") + ".csv")


@query("k07_csv_export_bins", """
    SELECT result_id, chrom, start, "end", copy_number, tag AS read_count,
           CASE WHEN line = 1 THEN '' ELSE printf('%.2f', (tag2 % 1000) / 1000.0::DOUBLE * 100) END AS gc_content
    FROM result_segments""")
def _(spark, sf):
    df = result_segments(spark, sf).withColumn("read_count", F.col("tag")).withColumn(
        "gc_content", F.when(F.col("line") != 1, (F.col("tag2") % 1000) / F.lit(1000.0)))
    return sinks.round_trip(reports.export_bins(df), scratch_path(spark, "export") + ".csv")


@query("k08_sample_table", """
    SELECT l.result_id, sample_name, algorithm_name, version, aberration_code, chrom, start, "end", type,
           printf('%.2f', size / 1000000.0::DOUBLE) AS size_mbp, printf('%.0f%%', mosaicism * 100) AS mosaic
    FROM listing l JOIN aberrant a ON a.result_id = l.result_id""")
def _(spark, sf):
    return sinks.round_trip(reports.sample_table(_listing(spark, sf), _aberrant(spark, sf)), scratch_path(spark, "export") + ".csv")


@query("k08_cycle_table", """
    SELECT l.result_id, flowcell_id, cycle_id, embryo_id, coalesce(codes, '') AS codes,
           CASE WHEN codes IS NULL THEN 'Normal' ELSE 'Abnormal' END AS conclusion FROM listing l
    LEFT JOIN (SELECT result_id, string_agg(aberration_code, '; ' ORDER BY chrom_num, start, line, aberration_code) AS codes
               FROM aberrant GROUP BY 1) a ON a.result_id = l.result_id""")
def _(spark, sf):
    return sinks.round_trip(reports.cycle_table(_listing(spark, sf), _aberrant(spark, sf)), scratch_path(spark, "export") + ".csv")


@query("genome_edit_by_id", """
    SELECT id, CASE WHEN id % 10 = 3 THEN 'hg38' ELSE reference_genome END AS reference_genome FROM samples""")
def _(spark, sf):
    s = samples(spark, sf)
    edits = s.filter("id % 10 = 3").select("id", F.lit("hg38").alias("new_genome"))
    return reports.update_genome(s, edits).select("id", "reference_genome")
