"""Stored results: aberrations, annotations, listings and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions import calls, numeric
from karyospark.operators.intervals import first_overlaps


def abnormal_segments(segments: DataFrame) -> DataFrame:
    """Segments with a gain or loss label, capitalised, and 'nan' mosaic text blanked."""
    label = calls.type_label(F.col("type"))
    return (segments.withColumn("type", label).filter(F.col("type") != "no_change")
            .withColumn("type", F.initcap("type")).withColumn("mosaic", F.nullif(F.col("mosaic"), F.lit("nan"))))


def sex_of_results(segments: DataFrame) -> DataFrame:
    """Sex by the length-weighted mean copy number of Y; unknown without Y segments."""
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    y = F.col("chrom") == "Y"
    mean = F.sum(F.when(y, F.col("copy_number") * length)) / F.sum(F.when(y, length))
    sex = F.when(F.col("y_mean").isNull(), "unknown").when(F.col("y_mean") < 0.3, "female").otherwise("male")
    return segments.groupBy("result_id").agg(mean.alias("y_mean")).select("result_id", "y_mean", sex.alias("sex"))


def aberrations(segments: DataFrame) -> DataFrame:
    """Aberrant segments of every result with type, mosaicism, size and code.

    The sex is a window over the result, the suffix a window over (result, chrom): one shuffle.
    """
    result = Window.partitionBy("result_id")
    length = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    y = F.col("chrom") == "Y"
    df = segments.repartition("result_id").withColumn(
        "_y", F.sum(F.when(y, F.col("copy_number") * length)).over(result) / F.sum(F.when(y, length)).over(result))
    sex = F.when(F.col("_y").isNull(), "unknown").when(F.col("_y") < 0.3, "female").otherwise("male")
    several = F.count("*").over(Window.partitionBy("result_id", "chrom")) > 1
    df = df.withColumn("sex", sex).withColumn("_many", several).withColumn(
        "expected", calls.expected_result(F.col("chrom"), F.col("sex")))
    m = calls.mosaicism(F.col("copy_number"), F.col("expected"))
    gain = F.col("copy_number") > F.col("expected")
    return (df.withColumn("mosaicism", m).filter(F.col("mosaicism") >= calls.MOSAICISM_FLOOR)
            .withColumn("type", F.when(gain, "gain").otherwise("loss"))
            .withColumn("size", F.col("end") - F.col("start"))
            .withColumn("aberration_code", F.concat(F.when(gain, "+").otherwise("-"), F.col("chrom"),
                                                    F.when(F.col("_many"), "s").otherwise("")))
            .drop("_y", "_many"))


def aberration_summary(aberrant: DataFrame, order: list[str]) -> DataFrame:
    """Codes of each result as one list, in chromosome and start order."""
    item = F.struct(*[F.col(c) for c in order], F.col("aberration_code").alias("code"))
    return aberrant.groupBy("result_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["code"]).alias("codes"))


def annotate(segments: DataFrame, annotations: DataFrame, top: int = 10) -> DataFrame:
    """Number of annotations overlapping each aberrant segment and the first `top` of them; the first gives the assessment.

    Unannotated segments stay.
    """
    right = annotations.select("chrom", "start", "end", "annotation_id", F.col("omim_id").alias("OMIM_ID"),
                               F.col("phenotype").alias("OMIM_phenotype"), "acmg")
    found = first_overlaps(segments, right, "chrom", ["annotation_id", "OMIM_ID", "OMIM_phenotype", "acmg"], top, "annotation")
    found = found.withColumn("annotation", F.when(F.col("n") > 0, F.col("annotation"))).withColumn("n", F.nullif("n", F.lit(0)))
    first = F.get(F.col("annotation"), F.lit(0))
    return found.withColumnRenamed("n", "n_annotations").withColumn(
        "assessment", F.coalesce(calls.assessment(first["acmg"]), F.lit("unknown"))).withColumn(
        "labels", numeric.phenotype_labels(F.col("annotation")))


def result_listing(results: DataFrame, samples: DataFrame, parameters: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Results with sample and algorithm names; sort by created_at descending to show newest first."""
    p = parameters.select("parameter_id", "algorithm_id")
    s = samples.select(F.col("id").alias("sample_id"), F.col("name").alias("sample_name"), "flowcell_id", "cycle_id",
                       "embryo_id", "cell_type", "reference_genome")
    return results.join(p, "parameter_id").join(algorithms, "algorithm_id").join(s, "sample_id")


def parameter_rows(parameters: DataFrame) -> DataFrame:
    """Stored JSON parameter sets as one row per parameter."""
    kind = "map<string, struct<type: string, `default`: string, value: string>>"
    return (parameters.select("parameter_id", "algorithm_id", F.explode(F.from_json("value", kind)).alias("name", "p"))
            .select("parameter_id", "algorithm_id", "name", F.col("p.type").alias("type"),
                    F.col("p.default").alias("default_value"), F.col("p.value").alias("value")))


def effective_parameters(parameters: DataFrame, overrides: Column) -> DataFrame:
    """Stored values merged over keyword overrides, as a map of strings; stored values win."""
    kind = "map<string, struct<type: string, `default`: string, value: string>>"
    stored = F.transform_values(F.from_json("value", kind), lambda k, v: v["value"])
    kept = F.map_filter(overrides, lambda k, v: ~F.array_contains(F.map_keys(stored), k))
    return parameters.withColumn("effective", F.map_concat(kept, stored))


def result_detail(listing: DataFrame, segments: DataFrame, bins: DataFrame) -> DataFrame:
    """Each listed result with its segments and bins nested, in genome order."""
    def nested(df: DataFrame, out: str, extra: list[str]) -> DataFrame:
        item = F.struct("chrom_num", "start", "end", *extra)
        return df.groupBy("result_id").agg(F.array_sort(F.collect_list(item)).alias(out))

    return (listing.join(nested(segments, "segments", ["copy_number", "confidence"]), "result_id", "left")
            .join(nested(bins, "bins", ["copy_number"]), "result_id", "left"))


def sample_report(listing: DataFrame, parameters: DataFrame, aberrant: DataFrame) -> DataFrame:
    """Result, sample and algorithm with nested parameters and aberrations."""
    item = F.struct("name", "type", "default_value", "value")
    ps = parameter_rows(parameters).groupBy("parameter_id").agg(
        F.array_sort(F.collect_list(item)).alias("parameters"))
    ab = F.struct("chrom_num", "start", "end", "type", "mosaicism", "size", "aberration_code")
    abs_ = aberrant.groupBy("result_id").agg(F.array_sort(F.collect_list(ab)).alias("aberrations"))
    return listing.join(ps, "parameter_id", "left").join(abs_, "result_id", "left")


def same_cycle(rows: DataFrame) -> DataFrame:
    """Per requested group: are cycle and flow cell the same for all samples?"""
    return rows.groupBy("request").agg(
        ((F.count_distinct("cycle_id") == 1) & (F.count_distinct("flowcell_id") == 1)).alias("consistent"))


def cycle_report(rows: DataFrame, aberrant: DataFrame) -> DataFrame:
    """One row per sample of a request: Abnormal when its result has any aberration."""
    hit = aberrant.groupBy("result_id").agg(F.count("*").alias("n_aberrations"))
    n = F.coalesce("n_aberrations", F.lit(0).cast("bigint"))
    return rows.join(hit, "result_id", "left").withColumn("n_aberrations", n).withColumn(
        "conclusion", F.when(F.col("n_aberrations") > 0, "Abnormal").otherwise("Normal"))


def new_rows(upload: DataFrame, stored: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Uploaded rows not stored yet, and those to skip."""
    have = stored.select(*key).distinct()
    return upload.join(have, key, "left_anti"), upload.join(have, key, "left_semi")


def available_algorithms(files: DataFrame) -> DataFrame:
    """sample, algorithm -> both kinds of file exist."""
    return files.groupBy("sample", "algorithm").agg((F.count_distinct("kind") == 2).alias("available"))


def valid_for_all(available: DataFrame, group: list[str]) -> DataFrame:
    """Per group and algorithm: is it available for every sample of the group?"""
    size = available.groupBy(*group).agg(F.count_distinct("sample").alias("_all"))
    have = available.filter("available").groupBy(*group, "algorithm").agg(F.count_distinct("sample").alias("_have"))
    per = available.select(*group, "algorithm").distinct()
    return (per.join(size, group).join(have, [*group, "algorithm"], "left")
            .select(*group, "algorithm", (F.coalesce("_have", F.lit(0)) == F.col("_all")).alias("valid")))


def hierarchy(samples: DataFrame) -> DataFrame:
    """flow cell -> cycle -> sorted samples."""
    return samples.groupBy("flowcell_id", "cycle_id").agg(F.array_sort(F.collect_list("name")).alias("samples"))


def lookup_by_containment(ids: DataFrame, stats: DataFrame, order: str, default: float = 0.0) -> DataFrame:
    """Keep ratio of the first statistics row whose sample name contains the id; a default with a warning flag.

    Names are unfolded into their substrings of the lengths that ids have (a handful of small
    numbers), the first row per substring is kept, and ids meet them in an equi-join.
    """
    lengths = [r[0] for r in ids.select(F.length("id")).distinct().collect()]

    def pieces(n: int) -> Column:
        last = F.greatest(F.length("stats_sample") - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("stats_sample"), i, F.lit(n)))

    starts = F.flatten(F.array(*[pieces(n) for n in lengths]))
    first = stats.select(F.explode(F.array_distinct(starts)).alias("id"), "ratio", order).groupBy("id").agg(
        F.min_by("ratio", order).alias("ratio"))
    return ids.join(first, "id", "left").withColumn("missing", F.col("ratio").isNull()).withColumn(
        "ratio", F.coalesce("ratio", F.lit(default)))


def select_files(files: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Files with a wanted key, and wanted keys without a file."""
    return files.join(wanted, key, "left_semi"), wanted.join(files, key, "left_anti")


def canonical_parameters(value: Column) -> Column:
    """Parameter JSON as sorted name=value text, so that equal sets compare equal."""
    kind = "map<string, struct<type: string, `default`: string, value: string>>"
    entries = F.array_sort(F.map_entries(F.from_json(value, kind)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"])), ";")


def reuse_parameters(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Per requested set the smallest stored id with the same algorithm and values; NULL asks for a new version."""
    have = stored.select("algorithm_id", canonical_parameters(F.col("value")).alias("_c"), "parameter_id").groupBy(
        "algorithm_id", "_c").agg(F.min("parameter_id").alias("reused_id"))
    return requested.withColumn("_c", canonical_parameters(F.col("value"))).join(
        have, ["algorithm_id", "_c"], "left").drop("_c")


def last_used(results: DataFrame, parameters: DataFrame) -> DataFrame:
    """Last parameter set used per algorithm."""
    return results.join(parameters.select("parameter_id", "algorithm_id"), "parameter_id").groupBy("algorithm_id").agg(
        F.max_by("parameter_id", F.struct("created_at", "result_id")).alias("last_parameter_id"))


def unused_parameters(parameters: DataFrame, results: DataFrame) -> DataFrame:
    return parameters.join(results.select("parameter_id").distinct(), "parameter_id", "left_anti")


def algorithm_key(name: Column, version: Column) -> Column:
    return F.concat_ws("_", name, version)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required header names that a table lacks."""
    return sorted(set(required) - set(df.columns))


def export_bins(bins: DataFrame) -> DataFrame:
    """CSV export of bins: GC as percent with two decimals, empty text for NULL."""
    return bins.select("result_id", "chrom", "start", "end", "copy_number", "read_count",
                       F.coalesce(numeric.fixed_text(F.col("gc_content") * 100, 2), F.lit("")).alias("gc_content"))


def export_segments(segments: DataFrame) -> DataFrame:
    """CSV export of segments: confidence with four decimals, manual change as Yes or No."""
    return segments.select("result_id", "chrom", "start", "end", "copy_number",
                           F.coalesce(numeric.fixed_text(F.col("confidence"), 4), F.lit("")).alias("confidence"),
                           F.when(F.col("man_change"), "Yes").otherwise("No").alias("man_change"))


def sample_table(listing: DataFrame, aberrant: DataFrame) -> DataFrame:
    """Flat sample report: one row per aberration, with size in Mb and mosaicism in percent."""
    cols = ["result_id", "sample_name", "algorithm_name", "version"]
    return listing.select(*cols).join(aberrant, "result_id").select(
        *cols, "aberration_code", "chrom", "start", "end", "type",
        numeric.fixed_text(numeric.megabases(F.col("size")), 2).alias("size_mbp"),
        numeric.percent_text(F.col("mosaicism") * 100, 0).alias("mosaic"))


def cycle_table(listing: DataFrame, aberrant: DataFrame) -> DataFrame:
    """Flat cycle report: one row per result with its conclusion and joined codes."""
    item = F.struct("chrom_num", "start", "line", F.col("aberration_code").alias("code"))
    codes = aberrant.groupBy("result_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["code"]), "; ").alias("codes"))
    return listing.join(codes, "result_id", "left").select(
        "result_id", "flowcell_id", "cycle_id", "embryo_id", F.coalesce("codes", F.lit("")).alias("codes"),
        F.when(F.col("codes").isNotNull(), "Abnormal").otherwise("Normal").alias("conclusion"))


def update_genome(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply reference-genome edits by sample id."""
    return samples.join(edits, "id", "left").withColumn(
        "reference_genome", F.coalesce("new_genome", "reference_genome")).drop("new_genome")
