"""Scalar-rule queries: names, chromosomes, calls, conversions, sort orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions import calls, chromosomes, names, numeric
from karyospark.plans.projections import add_cte, regions, result_segments, samples, segments, table
from karyospark.plans.registry import query
from karyospark.plans.track_queries import r6

add_cte("labelled", """
    SELECT result_id, line, tag, CASE line WHEN 1 THEN 'chr' || chrom WHEN 2 THEN chrom WHEN 3 THEN CAST(chrom_num AS VARCHAR)
           WHEN 4 THEN 'CHR' || chrom WHEN 5 THEN 'chrM' WHEN 6 THEN '25' ELSE 'chrUn_' || (tag % 7) END AS raw
    FROM result_segments""")


def _labelled(spark, sf):
    raw = (F.when(F.col("line") == 1, F.concat(F.lit("chr"), "chrom")).when(F.col("line") == 2, F.col("chrom"))
           .when(F.col("line") == 3, F.col("chrom_num").cast("string"))
           .when(F.col("line") == 4, F.concat(F.lit("CHR"), "chrom")).when(F.col("line") == 5, "chrM")
           .when(F.col("line") == 6, "25")
           .otherwise(F.concat(F.lit("chrUn_"), (F.col("tag") % 7).cast("string"))))
    return result_segments(spark, sf).withColumn("raw", raw)


@query("p01_chromosome_text_nuclear", """
    SELECT raw, CASE b WHEN 'X' THEN '23' WHEN 'Y' THEN '24' ELSE b END AS chrom, count(*) AS n
    FROM (SELECT raw, replace(raw, 'chr', '') AS b FROM labelled) WHERE b NOT IN ('M', 'MT', '25') GROUP BY ALL""")
def _(spark, sf):
    df = _labelled(spark, sf).select("raw", chromosomes.to_number_text_nuclear(F.col("raw")).alias("chrom"))
    return df.filter("chrom IS NOT NULL").groupBy("raw", "chrom").agg(F.count("*").alias("n"))


@query("p02_chromosome_number", """
    SELECT raw, CAST(c AS INTEGER) AS chrom_num, count(*) AS n FROM (
      SELECT raw, TRY_CAST(CASE b WHEN 'X' THEN '23' WHEN 'Y' THEN '24' ELSE b END AS DOUBLE) AS c
      FROM (SELECT raw, replace(raw, 'chr', '') AS b FROM labelled)) WHERE c BETWEEN 1 AND 24 GROUP BY ALL""")
def _(spark, sf):
    df = _labelled(spark, sf).select("raw", chromosomes.to_number(F.col("raw")).alias("chrom_num"))
    return df.filter("chrom_num IS NOT NULL").groupBy("raw", "chrom_num").agg(F.count("*").alias("n"))


@query("p03_chromosome_text", """
    SELECT raw, CASE b WHEN 'X' THEN '23' WHEN 'Y' THEN '24' ELSE b END AS chrom, count(*) AS n
    FROM (SELECT raw, replace(raw, 'chr', '') AS b FROM (
        SELECT CASE WHEN tag % 5 = 0 THEN NULL ELSE raw END AS raw FROM labelled)) GROUP BY ALL""")
def _(spark, sf):
    raw = F.when(F.col("tag") % 5 != 0, F.col("raw"))
    df = _labelled(spark, sf).select(raw.alias("raw"))
    return df.groupBy("raw", chromosomes.to_number_text(F.col("raw")).alias("chrom")).agg(F.count("*").alias("n"))


@query("p04_chromosome_enum", """
    SELECT raw, CASE WHEN v IN ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19',
           '20','21','22','X','Y','MT') THEN v END AS chrom, count(*) AS n
    FROM (SELECT raw, CASE b WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE upper(b) END AS v
          FROM (SELECT raw, regexp_replace(regexp_replace(trim(raw), '^chr', ''), '^CHR', '') AS b FROM labelled))
    GROUP BY ALL""")
def _(spark, sf):
    df = _labelled(spark, sf).select("raw", chromosomes.to_known_name(F.col("raw"), strict=False).alias("chrom"))
    return df.groupBy("raw", "chrom").agg(F.count("*").alias("n"))


@query("o01_biological_order", """
    SELECT tag, raw, k AS sort_key, row_number() OVER (PARTITION BY tag ORDER BY k, raw) AS ord FROM (
      SELECT DISTINCT tag, raw, CASE b WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 WHEN 'MT' THEN 25
             ELSE CASE WHEN TRY_CAST(b AS INTEGER) BETWEEN 1 AND 25 THEN TRY_CAST(b AS INTEGER) ELSE 999 END END AS k
      FROM (SELECT *, upper(regexp_replace(trim(raw), '(?i)^chr', '')) AS b FROM labelled))""")
def _(spark, sf):
    df = _labelled(spark, sf).select("tag", "raw", chromosomes.sort_key(F.col("raw")).alias("sort_key")).distinct()
    w = Window.partitionBy("tag").orderBy("sort_key", "raw")
    return df.withColumn("ord", F.row_number().over(w).cast("bigint"))


add_cte("raw_names", """
    SELECT id, file_name, CASE id % 5 WHEN 0 THEN file_name WHEN 1 THEN name WHEN 2 THEN embryo_id || '_S3.bam'
           WHEN 3 THEN '' ELSE flowcell_id || '-' || embryo_id || '_S7' END AS raw FROM samples""")


def _raw_names(spark, sf):
    k = F.col("id") % 5
    raw = (F.when(k == 0, F.col("file_name")).when(k == 1, F.col("name"))
           .when(k == 2, F.concat("embryo_id", F.lit("_S3.bam"))).when(k == 3, "")
           .otherwise(F.concat("flowcell_id", F.lit("-"), "embryo_id", F.lit("_S7"))))
    return samples(spark, sf).withColumn("raw", raw)


@query("p14_sample_name_strict", """
    SELECT id, CASE WHEN ok THEN regexp_extract(n, '^([A-Z0-9]+)-(.+)-([A-Z0-9]+)$', 1) END AS flowcell,
           CASE WHEN ok THEN regexp_extract(n, '^([A-Z0-9]+)-(.+)-([A-Z0-9]+)$', 2) END AS cycle,
           CASE WHEN ok THEN regexp_extract(n, '^([A-Z0-9]+)-(.+)-([A-Z0-9]+)$', 3) END AS embryo
    FROM (SELECT id, n, regexp_matches(n, '^([A-Z0-9]+)-(.+)-([A-Z0-9]+)$') AS ok FROM (
      SELECT id, regexp_replace(trim(replace(raw, '.bam', '')), '_[A-Z0-9]+$', '') AS n FROM raw_names))""")
def _(spark, sf):
    return _raw_names(spark, sf).select("id", names.parse_strict(F.col("raw"), strict=False).alias("p")).select("id", "p.*")


@query("p15_sample_name_lenient", """
    SELECT id, CASE WHEN trim(raw) = '' OR n = 1 OR p[1] = '' THEN 'UNKNOWN' ELSE p[1] END AS flowcell,
           CASE WHEN trim(raw) = '' OR n = 1 OR array_to_string(p[2:n-1], '-') = '' THEN 'UNKNOWN'
                ELSE array_to_string(p[2:n-1], '-') END AS cycle,
           CASE WHEN trim(raw) = '' THEN raw ELSE string_split(p[n], '_')[1] END AS embryo
    FROM (SELECT id, raw, p, len(p) AS n FROM (
      SELECT id, raw, string_split(regexp_replace(raw, '\\.bam$', ''), '-') AS p FROM raw_names))""")
def _(spark, sf):
    return _raw_names(spark, sf).select("id", names.parse_lenient(F.col("raw")).alias("p")).select("id", "p.*")


@query("p16_sample_name_viewer", """
    SELECT id, f AS flowcell, c AS cycle, e AS embryo, f || '-' || e AS display FROM (
      SELECT id, CASE WHEN n < 3 THEN raw ELSE p[1] END AS f, CASE WHEN n < 3 THEN raw ELSE p[n] END AS e,
             CASE WHEN n < 3 THEN raw ELSE array_to_string(p[2:n-1], '-') END AS c
      FROM (SELECT id, raw, string_split(raw, '-') AS p, len(string_split(raw, '-')) AS n FROM raw_names))""")
def _(spark, sf):
    return _raw_names(spark, sf).select("id", names.parse_viewer(F.col("raw")).alias("p")).select("id", "p.*")


@query("p17_p18_plate_and_cycle_key", """
    SELECT id, regexp_replace(replace(file_name, '.bam', ''), '_S\\d+$', '') AS stripped,
           regexp_replace(regexp_replace(file_name, '_S\\d+\\.bam$', ''), '^[^-]*-', '') AS cycle_key FROM samples""")
def _(spark, sf):
    df = samples(spark, sf)
    return df.select("id", names.strip_plate(F.regexp_replace("file_name", r"\.bam", "")).alias("stripped"),
                     names.cycle_embryo_key(F.col("file_name")).alias("cycle_key"))


@query("p19_file_pairs", """
    SELECT sample, algorithm, count(DISTINCT kind) = 2 AS paired FROM (
      SELECT sample, algorithm, k AS kind FROM segments CROSS JOIN (VALUES ('bins'), ('segments')) t(k)
      WHERE NOT (k = 'bins' AND seg_id % 3 > 0)) GROUP BY ALL""")
def _(spark, sf):
    kinds = F.when(F.col("seg_id") % 3 > 0, F.array(F.lit("segments"))).otherwise(
        F.array(F.lit("bins"), F.lit("segments")))
    files = segments(spark, sf).select(F.explode(kinds).alias("k"), "sample", "algorithm").select(
        F.concat_ws("_", "sample", "algorithm", F.concat("k", F.lit(".tsv"))).alias("file")).distinct()
    part = files.select(names.file_pair_part(F.col("file")).alias("p")).select("p.*")
    return part.groupBy("sample", "algorithm").agg((F.count_distinct("kind") == 2).alias("paired"))


@query("p20_algorithm_names", """
    SELECT id, t AS token, CASE t WHEN 'bicseq2' THEN 'BIC-seq2' WHEN 'wisecondorx' THEN 'WISECONDORX'
           WHEN 'bluefuse' THEN 'BlueFuse' WHEN 'baseline' THEN 'Baseline' ELSE t END AS pretty
    FROM (SELECT p_partkey AS id, CASE WHEN contains(s, 'bic') THEN 'bicseq2' ELSE s END AS t FROM (
      SELECT p_partkey, lower(regexp_replace(CASE p_size % 5 WHEN 0 THEN 'BIC seq 2' WHEN 1 THEN 'Wisecondor X'
             WHEN 2 THEN ' BlueFuse' WHEN 3 THEN 'base line' ELSE p_name END, '\\s+', '', 'g')) AS s FROM part))""")
def _(spark, sf):
    k = F.col("p_size") % 5
    raw = (F.when(k == 0, "BIC seq 2").when(k == 1, "Wisecondor X").when(k == 2, " BlueFuse").when(k == 3, "base line")
           .otherwise(F.col("p_name")))
    token = names.normalise_algorithm(raw)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), token.alias("token"),
                                           names.pretty_algorithm(token).alias("pretty"))


@query("p21_p22_p25_segment_calls", """
    SELECT seg_id, CASE WHEN "end" - start >= 5000000 THEN CASE WHEN copy_number < 1.5 THEN 'DEL'
                        WHEN copy_number > 2.5 THEN 'DUP' END END AS long_call,
           CASE WHEN copy_number >= 2.45 THEN 'Gain' WHEN copy_number <= 1.55 THEN 'Loss' ELSE 'No Change' END AS absolute,
           CASE WHEN copy_number >= 2.3 THEN 'gain' WHEN copy_number <= 1.7 THEN 'loss' ELSE 'normal' END AS web
    FROM segments""")
def _(spark, sf):
    cn = F.col("copy_number")
    return segments(spark, sf).select(
        "seg_id", calls.call_long_segment(F.col("start"), F.col("end"), cn).alias("long_call"),
        calls.call_absolute(cn).alias("absolute"), calls.call_web(cn).alias("web"))


add_cte("expected_cn", """
    SELECT *, CASE WHEN chrom_num = 23 THEN CASE WHEN sex = 'Female' THEN 2.0 ELSE 1.0 END
                   WHEN chrom_num = 24 THEN CASE WHEN sex = 'Female' THEN 0.0 ELSE 1.0 END ELSE 2.0 END AS expected
    FROM (SELECT *, CASE right(sample, 1) WHEN '0' THEN 'Female' WHEN '1' THEN 'Male' WHEN '2' THEN 'Female'
                    WHEN '3' THEN 'Male' ELSE 'Unknown' END AS sex FROM segments)""")


def _sexed(spark, sf):
    digit = F.substring("sample", -1, 1)
    sex = F.when(digit.isin("0", "2"), "Female").when(digit.isin("1", "3"), "Male").otherwise("Unknown")
    return segments(spark, sf).withColumn("sex", sex)


@query("p23_p27_expected_call", """
    SELECT seg_id, CAST(expected AS DOUBLE) AS expected, CASE WHEN copy_number >= expected + 0.45 THEN 'Gain'
           WHEN copy_number <= expected - 0.45 THEN 'Loss' ELSE 'No Change' END AS call
    FROM (SELECT seg_id, copy_number, CAST(expected AS DOUBLE) AS expected FROM expected_cn)""")
def _(spark, sf):
    expected = calls.expected_evaluation(F.col("chrom_num"), F.col("sex"))
    return _sexed(spark, sf).select("seg_id", expected.alias("expected"),
                                    calls.call_expected(F.col("copy_number"), expected).alias("call"))


@query("p28_expected_for_results", """
    SELECT seg_id, CAST(CASE WHEN sex = 'Female' AND chrom_num = 24 THEN 0 WHEN sex = 'Male' AND chrom_num >= 23 THEN 1
           ELSE 2 END AS DOUBLE) AS expected FROM expected_cn""")
def _(spark, sf):
    return _sexed(spark, sf).select("seg_id", calls.expected_result(
        chromosomes.to_name(F.col("chrom_num")), F.lower("sex")).alias("expected"))


@query("p26_log2_calls", """
    SELECT sample, chrom, bin, CASE WHEN l > 0 THEN 'gain' WHEN l < 0 THEN 'loss' ELSE 'neutral' END AS by_sign,
           CASE WHEN abs(l) > 0.2 AND coalesce(p < 0.01, true) THEN CASE WHEN l > 0 THEN 'gain' ELSE 'loss' END
                ELSE 'neutral' END AS by_profile
    FROM (SELECT *, round(log2(obs / expected), 6) AS l, CASE WHEN bin % 3 > 0 THEN (obs % 5) / 200.0 END AS p FROM bic_bins)""")
def _(spark, sf):
    from karyospark.plans.projections import bic_bins
    log2 = F.round(F.log2(F.col("obs") / F.col("expected")), 6)
    p = F.when(F.col("bin") % 3 > 0, (F.col("obs") % 5) / F.lit(200.0))
    return bic_bins(spark, sf).select("sample", "chrom", "bin", calls.call_log2_sign(log2).alias("by_sign"),
                                      calls.call_log2_profile(log2, p).alias("by_profile"))


@query("p29_type_labels", """
    SELECT region_key, CASE WHEN l IN ('loss', 'del', 'deletion', 'loh') THEN 'loss'
           WHEN l IN ('gain', 'dup', 'duplication', 'amp', 'amplification') THEN 'gain' ELSE 'no_change' END AS label
    FROM (SELECT region_key, lower(trim(CASE region_key % 6 WHEN 0 THEN ' LOSS' WHEN 1 THEN 'Dup' WHEN 2 THEN 'LOH '
          WHEN 3 THEN 'Amplification' WHEN 4 THEN type ELSE 'deletion' END)) AS l FROM regions)""")
def _(spark, sf):
    k = F.col("region_key") % 6
    raw = (F.when(k == 0, " LOSS").when(k == 1, "Dup").when(k == 2, "LOH ").when(k == 3, "Amplification")
           .when(k == 4, F.col("type")).otherwise("deletion"))
    return regions(spark, sf).select("region_key", calls.type_label(raw).alias("label"))


add_cte("cn_text", """
    SELECT *, CASE WHEN line = 7 THEN 'n/a' ELSE (CAST(round(copy_number * 100) AS BIGINT) // 100) || '.'
           || lpad(CAST(CAST(round(copy_number * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS raw
    FROM result_segments""")


def _cn_text(spark, sf):
    h = F.round(F.col("copy_number") * 100).cast("bigint")
    text = F.concat_ws(".", F.floor(h / 100).cast("string"), F.lpad((h % 100).cast("string"), 2, "0"))
    return result_segments(spark, sf).withColumn("raw", F.when(F.col("line") == 7, "n/a").otherwise(text))


@query("p30_p31_level_and_size", """
    SELECT raw, CASE WHEN raw = 'n/a' THEN 0.0
           ELSE least(greatest(CAST(round(TRY_CAST(raw AS DECIMAL(18,6)), 1) AS DOUBLE), 1.0), 3.0) END AS level,
           CASE WHEN len < 20000000 THEN '0-20M' WHEN len < 40000000 THEN '20-40M' WHEN len < 80000000 THEN '40-80M'
                ELSE '>80M' END AS size_class, count(*) AS n
    FROM (SELECT raw, ("end" - start) * 200 AS len FROM cn_text) GROUP BY ALL""")
def _(spark, sf):
    df = _cn_text(spark, sf)
    return df.groupBy("raw", calls.capped_level(F.col("raw")).alias("level"),
                      calls.size_class((F.col("end") - F.col("start")) * 200).alias("size_class")).agg(
        F.count("*").alias("n"))


@query("p34_acmg_assessment", """
    SELECT raw, CASE WHEN contains(raw, 'NA') THEN 'artefact' WHEN contains(raw, '5') THEN 'pathogenic'
           WHEN contains(raw, '4') THEN 'probably_pathogenic' WHEN contains(raw, '3') THEN 'unknown'
           WHEN contains(raw, '2') THEN 'probably_benign' WHEN contains(raw, '1') THEN 'benign' ELSE 'unknown' END AS assessment,
           count(*) AS n
    FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'NA' WHEN p_size % 7 = 6 THEN '' ELSE 'Class ' || (p_size % 7) || '/'
          || (p_size % 3) END AS raw FROM part) GROUP BY ALL""")
def _(spark, sf):
    k = F.col("p_size") % 7
    raw = F.when(k == 0, "NA").when(k == 6, "").otherwise(
        F.concat(F.lit("Class "), k.cast("string"), F.lit("/"), (F.col("p_size") % 3).cast("string")))
    df = table(spark, sf, "part").select(raw.alias("raw"))
    return df.groupBy("raw", calls.assessment(F.col("raw")).alias("assessment")).agg(F.count("*").alias("n"))


@query("p37_coerced_segments", """
    SELECT result_id, line, CAST(chrom_num AS INTEGER) AS chrom_num, start, "end", TRY_CAST(raw AS DOUBLE) AS copy_number
    FROM cn_text WHERE TRY_CAST(raw AS DOUBLE) IS NOT NULL AND "end" > start AND chrom_num <= 22""")
def _(spark, sf):
    from karyospark.sources.segments import coerce_segments
    df = _cn_text(spark, sf).select("result_id", "line", F.col("chrom_num").cast("string").alias("chrom_num"),
                                    F.col("start").cast("string").alias("start"),
                                    F.col("end").cast("string").alias("end"), F.col("raw").alias("copy_number"))
    return coerce_segments(df)


@query("p38_p36_percent_and_size", """
    SELECT region_key, printf('%.2f%%', mosaic * 100) AS shown,
           round(CAST(rtrim(printf('%.2f%%', mosaic * 100), '%') AS DOUBLE) / 100, 6) AS back,
           round(("end" - start) / 1000000.0::DOUBLE, 6) AS mbp FROM regions""")
def _(spark, sf):
    shown = numeric.percent_text(F.col("mosaic") * 100)
    return regions(spark, sf).select("region_key", shown.alias("shown"),
                                     r6(numeric.percent_number(shown) / 100).alias("back"),
                                     r6(numeric.megabases(F.col("end") - F.col("start"))).alias("mbp"))


@query("p40_experiment_names", """
    SELECT region_key, unnest(CASE WHEN c = '34' THEN [3, 4] ELSE [TRY_CAST(c AS INTEGER)] END) AS chrom_num,
           unnest(CASE WHEN c = '34' THEN [t[1], t[-1]] ELSE [t] END) AS type, m AS mosaic
    FROM (SELECT region_key, string_split(nm, '-')[1] AS c, string_split(nm, '-')[2] AS t, string_split(nm, '-')[3] AS m
      FROM (SELECT region_key, CASE WHEN region_key % 4 = 0 THEN '34-' || type || 'L' ELSE chrom_num || '-' || type END
            || '-' || CAST(round(mosaic * 100) AS INTEGER) AS nm FROM regions))""")
def _(spark, sf):
    head = F.when(F.col("region_key") % 4 == 0, F.concat(F.lit("34-"), "type", F.lit("L"))).otherwise(
        F.concat(F.col("chrom_num").cast("string"), F.lit("-"), "type"))
    name = F.concat_ws("-", head, F.round(F.col("mosaic") * 100).cast("int").cast("string"))
    p = regions(spark, sf).select("region_key", names.parse_experiment(name).alias("p"))
    z = F.explode(F.arrays_zip("p.chroms", "p.types")).alias("z")
    return p.select("region_key", z, F.col("p.mosaic").alias("mosaic")).select(
        "region_key", F.col("z.chroms").alias("chrom_num"), F.col("z.types").alias("type"), "mosaic")


@query("p42_abnormal_segments", """
    SELECT region_key, chrom_num, upper(l[1]) || l[2:] AS type, CASE WHEN m <> 'nan' THEN m END AS mosaic
    FROM (SELECT region_key, chrom_num, CASE WHEN region_key % 3 = 0 THEN 'no_change' WHEN type = 'G' THEN 'gain' ELSE 'loss'
          END AS l, CASE WHEN region_key % 5 = 0 THEN 'nan' ELSE CAST(round(mosaic * 100) AS INTEGER) || '%' END AS m
          FROM regions) WHERE l <> 'no_change'""")
def _(spark, sf):
    raw_type = F.when(F.col("region_key") % 3 == 0, "none").when(F.col("type") == "G", "GAIN").otherwise("del")
    raw_m = F.when(F.col("region_key") % 5 == 0, "nan").otherwise(
        F.concat(F.round(F.col("mosaic") * 100).cast("int").cast("string"), F.lit("%")))
    from karyospark.operators.reports import abnormal_segments
    df = regions(spark, sf).select("region_key", "chrom_num", raw_type.alias("type"), raw_m.alias("mosaic"))
    return abnormal_segments(df)


@query("p43_display_percent", """
    SELECT sample, chrom, bin, printf('%.0f%%', mos * 100) AS mosaic, printf('%.1f', gc * 100) AS gc FROM (
      SELECT sample, chrom, bin, gc, (obs % 10) / 10.0::DOUBLE AS mos FROM bic_bins)""")
def _(spark, sf):
    from karyospark.plans.projections import bic_bins
    return bic_bins(spark, sf).select(
        "sample", "chrom", "bin", numeric.percent_text((F.col("obs") % 10) / F.lit(10.0) * 100, 0).alias("mosaic"),
        numeric.fixed_text(F.col("gc") * 100, 1).alias("gc"))


@query("p44_sample_defaults", """
    SELECT id, genome, cell_type, strftime(day, '%Y-%m-%d') AS day FROM (
      SELECT id, CASE WHEN id % 3 = 0 THEN 'hg19' ELSE reference_genome END AS genome,
             CASE WHEN id % 4 = 0 THEN 'Other' ELSE cell_type END AS cell_type,
             DATE '2024-01-01' + CAST(id % 365 AS INTEGER) AS day FROM samples)""")
def _(spark, sf):
    df = samples(spark, sf)
    genome = F.when(F.col("id") % 3 != 0, F.col("reference_genome"))
    cell = F.when(F.col("id") % 4 != 0, F.col("cell_type"))
    kinds = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Other"]
    text = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")), "yyyy-MM-dd")
    return df.select("id", numeric.one_of(genome, ["hg19", "hg38"], "hg19").alias("genome"),
                     numeric.one_of(cell, kinds, "Other").alias("cell_type"), numeric.iso_date(text).cast("string").alias("day"))
