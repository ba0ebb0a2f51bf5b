"""Accuracy evaluation of callers against a truth set, for all experiments in one plan.

Segments are one long table (experiment, sample, algorithm, chrom_num, start, end, copy_number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karyospark.functions import calls
from karyospark.operators.intervals import best_overlap, covered_length
from karyospark.operators.quantiles import exact_quantiles

CALL_KEY = ["experiment", "sample", "algorithm"]


def chromosome_class() -> Column:
    return F.when(F.col("chrom_num") <= 22, "Autosome").otherwise("Gonosome")


def longest_copy_number(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Copy number of the longest segment per chromosome; the earliest of equals."""
    rank = F.struct(F.col("end") - F.col("start"), -F.col("start"), -F.col("seg_id"))
    return segments.groupBy(*keys, "chrom_num").agg(F.max_by("copy_number", rank).alias("copy_number"))


def sex_of_samples(truth: DataFrame) -> DataFrame:
    """Female without Y or with a longest Y segment below 0.45, else Male."""
    rank = F.struct(F.col("end") - F.col("start"), -F.col("start"), -F.col("seg_id"))
    y = F.col("chrom_num") == 24
    return truth.groupBy("experiment", "sample").agg(
        F.max_by(F.when(y, F.col("copy_number")), F.when(y, rank)).alias("y_cn")).select(
        "experiment", "sample", F.when(F.coalesce("y_cn", F.lit(0.0)) < 0.45, "Female").otherwise("Male").alias("sex"))


def state_shares(segments: DataFrame, call: Column, keys: list[str]) -> DataFrame:
    """Length-weighted share of Gain, Loss and No Change per chromosome."""
    df = segments.withColumn("_len", F.greatest(F.col("end") - F.col("start"), F.lit(0))).withColumn("_call", call)
    total = F.sum("_len")
    share = {s: F.coalesce(F.try_divide(F.sum(F.when(F.col("_call") == s, F.col("_len"))).cast("double"), total),
                           F.lit(0.0)) for s in ("Gain", "Loss", "No Change")}
    return df.groupBy(*keys, "chrom_num").agg(share["Gain"].alias("gain"), share["Loss"].alias("loss"),
                                              share["No Change"].alias("no_change"), total.alias("length"))


def dominant_state(shares: DataFrame, empty_is_gain: bool = False) -> DataFrame:
    """State with the largest share, Gain before Loss before No Change on ties.

    A chromosome without length is No Change; the first-generation rule called it Gain.
    """
    none = F.coalesce("length", F.lit(0)) == 0
    g, l, n = (F.coalesce(c, F.lit(0.0)) for c in ("gain", "loss", "no_change"))
    state = (F.when(none, "Gain" if empty_is_gain else "No Change").when((g >= l) & (g >= n), "Gain")
             .when(l >= n, "Loss").otherwise("No Change"))
    share = F.when(none, 0.0).otherwise(F.greatest(g, l, n))
    return shares.withColumn("state", state).withColumn("share", share)


def all_chromosomes(samples: DataFrame) -> DataFrame:
    """Each row once per chromosome 1..24."""
    return samples.withColumn("chrom_num", F.explode(F.sequence(F.lit(1), F.lit(24))))


def chromosome_confusion(segments: DataFrame, truth: str) -> DataFrame:
    """One row per sample, caller and chromosome with the truth state, the called state and TP/FP/FN/TN.

    Sex comes from the truth; gonosomes are judged for males only; callers without segments on a
    chromosome count as No Change there.
    """
    true_rows = segments.filter(F.col("algorithm") == truth)
    sex = sex_of_samples(true_rows)
    sexed = segments.join(sex, ["experiment", "sample"])
    call = calls.call_expected(F.col("copy_number"), calls.expected_evaluation(F.col("chrom_num"), F.col("sex")))
    shares = state_shares(sexed, call, [*CALL_KEY, "sex"])
    frame = all_chromosomes(sexed.select(*CALL_KEY, "sex").distinct())
    states = dominant_state(frame.join(shares, [*CALL_KEY, "sex", "chrom_num"], "left")).select(
        *CALL_KEY, "sex", "chrom_num", "state", "share")
    truth_states = states.filter(F.col("algorithm") == truth).select(
        "experiment", "sample", "chrom_num", F.col("state").alias("truth_state"), F.col("share").alias("truth_share"))
    out = states.filter(F.col("algorithm") != truth).join(truth_states, ["experiment", "sample", "chrom_num"])
    return out.withColumn("result", calls.confusion(F.col("truth_state"), F.col("state"))).withColumn(
        "chromosome_type", chromosome_class()).filter((F.col("chrom_num") <= 22) | (F.col("sex") == "Male"))


def confusion_counts(judged: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, FN, TN columns with 0 for a missing class."""
    return judged.groupBy(*by).pivot("result", ["TP", "FP", "FN", "TN"]).count().na.fill(0)


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(calls.metrics(*[F.col(c) for c in ("TP", "FP", "FN", "TN")]))


def metric_table(judged: DataFrame, by: list[str], entity: str = "sample") -> DataFrame:
    """Rows per entity plus an ALL row, whose metrics come from the summed counts (one expand, no union)."""
    n = {c: F.count_if(F.col("result") == c).alias(c) for c in ("TP", "FP", "FN", "TN")}
    sets = judged.select(*by, entity, "result").withColumn(
        entity, F.explode(F.array(F.col(entity), F.lit("ALL"))))
    return with_metrics(sets.groupBy(*by, entity).agg(*n.values()))


def segment_confusion(segments: DataFrame, truth: str, margin: float = 0.5, min_length: int = 5_000_000,
                      needed: float = 0.5) -> DataFrame:
    """Judge each called segment by the share of it that the truth reports in the same state.

    Overlap sums come from running totals per (sample, chrom, state), never from pairs.
    """
    state = F.coalesce(calls.call_long_segment(F.col("start"), F.col("end"), F.col("copy_number"), margin, min_length),
                       F.lit("none"))
    df = segments.filter(F.col("chrom_num") <= 22).withColumn("cnv_state", state)
    keys = ["experiment", "sample", "chrom_num", "cnv_state"]
    called = df.filter(F.col("algorithm") != truth)
    same = covered_length(called, df.filter(F.col("algorithm") == truth).select(*keys, "start", "end"), keys,
                          ["algorithm", "seg_id"], "matched")
    judged = called.join(same, [*keys, "algorithm", "seg_id"], "left")
    length = F.col("end") - F.col("start")
    share = F.when(length > 0, F.coalesce("matched", F.lit(0)) / length).otherwise(0.0)
    good = F.col("share") >= needed
    none = F.col("cnv_state") == "none"
    return judged.withColumn("share", share).withColumn("result", F.when(
        none, F.when(good, "TN").otherwise("FN")).otherwise(F.when(good, "TP").otherwise("FP"))).drop("matched")


def deviations(longest: DataFrame, truth: str, sex: DataFrame) -> DataFrame:
    """Caller minus truth where the truth is off its expected value, signed so that overshoot is positive."""
    t = longest.filter(F.col("algorithm") == truth).select("experiment", "sample", "chrom_num",
                                                           F.col("copy_number").alias("truth_cn"))
    df = (longest.filter(F.col("algorithm") != truth).join(t, ["experiment", "sample", "chrom_num"])
          .join(sex, ["experiment", "sample"]).filter((F.col("chrom_num") <= 22) | (F.col("sex") == "Male")))
    expected = calls.expected_evaluation(F.col("chrom_num"), F.col("sex"))
    raw = F.col("copy_number") - F.col("truth_cn")
    df = df.filter(F.col("truth_cn") != expected).withColumn(
        "deviation", F.when(F.col("truth_cn") > expected, raw).otherwise(-raw))
    return df.withColumn("relative", relative(F.col("deviation"), F.col("truth_cn")))


def relative(deviation: Column, truth: Column) -> Column:
    """Percent of the truth with two decimals, NULL for a truth of 0."""
    return F.when(truth != 0, F.round(deviation / truth * 100, 2))


def region_copy_numbers(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Per sample, caller and region of its experiment the copy number of the best-overlapping segment."""
    who = segments.select(*CALL_KEY).distinct()
    asked = who.join(regions.select("experiment", "region", "chrom_num", "start", "end", "type"), "experiment")
    return best_overlap(asked, segments.select(*CALL_KEY, "chrom_num", "start", "end", "copy_number", "seg_id"),
                        [*CALL_KEY, "chrom_num"], ["region"], "copy_number", "seg_id")


def truth_flat(ratios: DataFrame, base: float = 2.0) -> DataFrame:
    """Truth from scale ratios over a flat genome."""
    return ratios.withColumn("truth_cn", F.col("ratio") * base)


def truth_measured(ratios: DataFrame, measured: DataFrame) -> DataFrame:
    """Truth from scale ratios over the copy number of the unmodified sample."""
    m = measured.select("experiment", "sample", "region", F.col("copy_number").alias("base_cn"))
    return ratios.join(m, ["experiment", "sample", "region"]).withColumn("truth_cn", F.col("ratio") * F.col("base_cn"))


def region_deviations(called: DataFrame, truth: DataFrame) -> DataFrame:
    """Deviation per region, sign by region type; NULL where either side is missing."""
    t = truth.select("experiment", "sample", "region", "truth_cn")
    return _signed_by_type(called.join(t, ["experiment", "sample", "region"]))


def region_deviations_measured(called: DataFrame, ratios: DataFrame, truth: str) -> DataFrame:
    """The same against the measured truth, whose row sits beside the callers' rows of a region: one pass over `called`."""
    w = Window.partitionBy("experiment", "sample", "region")
    base = F.max(F.when(F.col("algorithm") == truth, F.struct("copy_number"))).over(w)
    df = called.withColumn("_base", base).filter("_base IS NOT NULL").join(
        ratios.select("experiment", "sample", "region", "ratio"), ["experiment", "sample", "region"])
    return _signed_by_type(df.withColumn("truth_cn", F.col("ratio") * F.col("_base.copy_number")).drop("_base", "ratio"))


def _signed_by_type(df: DataFrame) -> DataFrame:
    raw = F.col("copy_number") - F.col("truth_cn")
    df = df.withColumn("deviation", F.when(F.col("type") == "G", raw).otherwise(-raw))
    return df.withColumn("relative", relative(F.col("deviation"), F.col("truth_cn")))


def bands(dev: DataFrame, by: list[str], value: str = "deviation") -> DataFrame:
    """Mean and the central 20, 40, 60 and 80 % of a deviation."""
    cuts = [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]
    q = exact_quantiles(dev, by, value, cuts)
    return q.select(*by, "mean", *[F.col("q")[i].alias(f"p{int(c * 100)}") for i, c in enumerate(cuts)])


def relative_histogram(dev: DataFrame, by: list[str], value: str = "relative") -> DataFrame:
    """Percent of values in four classes between -10 and 10; values outside stay in the denominator."""
    r = F.col(value)
    classes = {"m10_m5": (r >= -10) & (r < -5), "m5_0": (r >= -5) & (r < 0), "p0_5": (r >= 0) & (r < 5),
               "p5_10": (r >= 5) & (r <= 10)}
    return dev.filter(r.isNotNull()).groupBy(*by).agg(
        *[(F.count_if(c) * 100.0 / F.count("*")).alias(n) for n, c in classes.items()])


def mean_errors(dev: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute deviation, mean absolute relative deviation and mean squared deviation."""
    d = F.col("deviation")
    return dev.filter(d.isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(F.abs("relative")).alias("mean_abs_relative"), F.avg(d * d).alias("mse"))


def squared_deviation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Squared deviation per sample with a `mean` row over the samples; NULLs are skipped."""
    sq = F.pow(F.col("copy_number") - F.col("truth_cn"), 2.0)
    rows = pairs.withColumn("sq", sq).select(*by, F.explode(F.array(F.col("sample"), F.lit("mean"))).alias("sample"), "sq")
    return rows.groupBy(*by, "sample").agg(F.avg("sq").alias("squared_deviation"))


def planted_truth(targets: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Truth copy number on target chromosomes: divided by the keep ratio for gains, times it for losses.

    `targets` has chrom_num, type and keep_ratio (NULL ratio gives a NULL truth). With `segments`
    the measured copy number is the base, otherwise a flat 2.
    """
    df = targets if segments is None else segments.join(targets, ["experiment", "sample", "chrom_num"], "left")
    base = F.lit(2.0) if segments is None else F.col("copy_number")
    adjusted = F.when(F.col("type") == "G", F.try_divide(base, F.col("keep_ratio"))).when(
        F.col("type").isNotNull(), base * F.col("keep_ratio")).otherwise(base)
    return df.withColumn("truth_cn", adjusted)


def size_level_matrix(segments: DataFrame, cn_text: Column) -> DataFrame:
    """Segments per sample in each of 4 length classes x 21 copy-number levels."""
    level = calls.capped_level(cn_text)
    key = F.concat(calls.size_class(F.col("end") - F.col("start")), F.lit("_CN"), F.format_string("%.1f", level))
    names = [f"{s}_CN{c:.1f}" for s in calls.SIZE_CLASSES for c in calls.CN_LEVELS]
    return segments.withColumn("_k", key).groupBy("sample").pivot("_k", names).count().na.fill(0)


def chromosome_means(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Length-weighted mean copy number per chromosome as columns c1..c24, sex and number of segments."""
    df = segments.filter((F.col("end") > F.col("start")) & F.col("copy_number").isNotNull())
    length = F.col("end") - F.col("start")

    def mean(c: int) -> Column:
        here = F.col("chrom_num") == c
        return F.round((F.sum(F.when(here, F.col("copy_number") * length)) / F.sum(F.when(here, length)))
                       .cast("decimal(18,9)"), 1).cast("double")

    agg = df.groupBy(*keys).agg(F.count("*").alias("segment_number"),
                                *[mean(c).alias(f"c{c}") for c in range(1, 25)])
    return agg.withColumn("sex", calls.sex_from_means(F.col("c23"), F.col("c24")))


def candidate_stats(bins: DataFrame) -> DataFrame:
    """Largest, squared and mean deviation from 2 over the autosomes and chromosomes 1 to 4."""
    dev = F.col("copy_number") - 2
    groups = {"autosome": F.col("chrom_num") <= 22, **{f"chr{i}": F.col("chrom_num") == i for i in range(1, 5)}}
    aggs = []
    for name, here in groups.items():
        d = F.when(here, dev)
        aggs += [F.max(F.abs(d)).alias(f"max_{name}"), F.sum(d * d).alias(f"sum_{name}"),
                 F.abs(F.avg(d)).alias(f"mean_{name}")]
    return bins.groupBy("sample").agg(*aggs)


def value_distribution(dev: DataFrame, by: list[str], value: str = "relative", lo: float = -50.0, hi: float = 50.0,
                       classes: int = 20) -> tuple[DataFrame, DataFrame]:
    """Inputs of box and violin plots: quartiles with range, and histogram rows."""
    present = dev.filter(F.col(value).isNotNull())
    q = exact_quantiles(present, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    box = q.select(*by, *[F.col("q")[i].alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))])
    hist = present.groupBy(*by, F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(classes)).alias("class")).agg(
        F.count("*").alias("n"))
    return box, hist


def thinning_keep(reads: DataFrame, ratio: Column, id_hash: Column) -> DataFrame:
    """Keep a read when its hash, 0..999999, falls below the keep probability."""
    return reads.withColumn("kept", id_hash < F.floor(ratio * 1_000_000))


def scale_ratio(reads: DataFrame, keys: list[str]) -> DataFrame:
    """(kept in region * all outside) / (all in region * kept outside); 0 where undefined."""
    per = reads.groupBy(*keys, "region").agg(F.count("*").alias("original"), F.count_if("kept").alias("kept_n"))
    outside = per.filter("region = 0").select(*keys, F.col("original").alias("o0"), F.col("kept_n").alias("k0"))
    df = per.filter("region > 0").join(outside, keys, "left")
    ok = (F.col("original") > 0) & (F.coalesce("k0", F.lit(0)) > 0)
    return df.withColumn("ratio", F.when(ok, F.col("kept_n") * F.col("o0") / (F.col("original") * F.col("k0"))).otherwise(0.0))
