"""Copy-number arithmetic, expected values and gain/loss rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the calling rules.
MIN_CNV_LENGTH = 5_000_000
MOSAIC_SEGMENT = 0.5
GAIN_CN, LOSS_CN = 2.45, 1.55
EXPECTED_MARGIN = 0.45
WEB_GAIN_CN, WEB_LOSS_CN = 2.3, 1.7
PROFILE_LOG2, PROFILE_P = 0.2, 0.01
MOSAICISM_FLOOR = 0.3


def copy_number(log2_ratio: Column) -> Column:
    """Log2 ratio to copy number: 2^(x+1)."""
    return F.pow(F.lit(2.0), log2_ratio + 1)


def call_long_segment(start: Column, end: Column, cn: Column, margin: float = MOSAIC_SEGMENT,
                      min_length: int = MIN_CNV_LENGTH) -> Column:
    """DEL or DUP for segments long enough, NULL otherwise."""
    return F.when(end - start >= min_length, F.when(cn < 2 - margin, "DEL").when(cn > 2 + margin, "DUP"))


def call_absolute(cn: Column, gain: float = GAIN_CN, loss: float = LOSS_CN) -> Column:
    return F.when(cn >= gain, "Gain").when(cn <= loss, "Loss").otherwise("No Change")


def call_expected(cn: Column, expected: Column, margin: float = EXPECTED_MARGIN) -> Column:
    return (F.when(cn >= expected + margin, "Gain").when(cn <= expected - margin, "Loss")
            .otherwise("No Change"))


def call_plot(cn: Column, chrom: Column, sex: Column) -> Column:
    """Colouring of the genome plot; sex chromosomes of a male are shifted down by one copy."""
    shift = F.when((sex == "male") & chrom.isin("X", "Y"), F.lit(1.0)).otherwise(F.lit(0.0))
    return (F.when(cn > F.lit(GAIN_CN) - shift, "gain").when(cn < F.lit(LOSS_CN) - shift, "loss")
            .otherwise("neutral"))


def call_web(cn: Column) -> Column:
    return F.when(cn >= WEB_GAIN_CN, "gain").when(cn <= WEB_LOSS_CN, "loss").otherwise("normal")


def call_log2_sign(log2_ratio: Column) -> Column:
    return F.when(log2_ratio > 0, "gain").when(log2_ratio < 0, "loss").otherwise("neutral")


def call_log2_profile(log2_ratio: Column, pvalue: Column) -> Column:
    """Sizeable and, where a p-value is known, significant."""
    called = (F.abs(log2_ratio) > PROFILE_LOG2) & F.coalesce(pvalue < PROFILE_P, F.lit(True))
    return F.when(called, call_log2_sign(log2_ratio)).otherwise("neutral")


def expected_evaluation(chrom_num: Column, sex: Column) -> Column:
    """Autosomes 2; X 2 or 1; Y 0 or 1. Any sex other than Female counts as male."""
    female = sex == "Female"
    return (F.when(chrom_num == 23, F.when(female, 2.0).otherwise(1.0))
            .when(chrom_num == 24, F.when(female, 0.0).otherwise(1.0)).otherwise(2.0))


def expected_result(chrom: Column, sex: Column) -> Column:
    """As above for stored results, with 2 for an unknown sex."""
    return (F.when((sex == "female") & (chrom == "Y"), 0.0)
            .when((sex == "male") & chrom.isin("X", "Y"), 1.0).otherwise(2.0))


def type_label(label: Column) -> Column:
    """Free-text call label to loss, gain or no_change."""
    text = F.lower(F.trim(label))
    # Accepted spellings.
    loss = ["loss", "del", "deletion", "loh"]
    gain = ["gain", "dup", "duplication", "amp", "amplification"]
    return F.when(text.isin(loss), "loss").when(text.isin(gain), "gain").otherwise("no_change")


def capped_level(text: Column) -> Column:
    """Copy-number text to one decimal, half up, clamped to 1..3; unreadable text gives 0."""
    level = F.round(text.try_cast("decimal(18,6)"), 1).cast("double")
    return F.when(level.isNotNull(), F.least(F.greatest(level, F.lit(1.0)), F.lit(3.0))).otherwise(0.0)


def size_class(length: Column) -> Column:
    """Segment length class with edges at 20, 40 and 80 Mb."""
    return (F.when(length < 0, None).when(length < 20_000_000, "0-20M").when(length < 40_000_000, "20-40M")
            .when(length < 80_000_000, "40-80M").otherwise(">80M"))


SIZE_CLASSES = ["0-20M", "20-40M", "40-80M", ">80M"]
CN_LEVELS = [round(1.0 + i / 10, 1) for i in range(21)]


def mosaicism(cn: Column, expected: Column) -> Column:
    """Distance from the expected copy number, one decimal."""
    return F.bround(F.abs(cn - expected), 1)


def assessment(acmg: Column) -> Column:
    """ACMG class text to an assessment; the first matching mark decides."""
    text = F.trim(acmg)
    return (F.when(text.contains("NA"), "artefact").when(text.contains("5"), "pathogenic")
            .when(text.contains("4"), "probably_pathogenic").when(text.contains("3"), "unknown")
            .when(text.contains("2"), "probably_benign").when(text.contains("1"), "benign")
            .otherwise("unknown"))


def sex_from_means(x_mean: Column, y_mean: Column) -> Column:
    return (F.when(x_mean.between(1.8, 2.2) & (y_mean < 0.2), "female")
            .when(x_mean.between(0.8, 1.2) & y_mean.between(0.8, 1.2), "male").otherwise("Nan"))


def region_copy_number(region_type: Column, mosaic: Column) -> Column:
    """Copy number that a simulated region stands for."""
    return (F.when(region_type == "G", F.lit(2.0) + mosaic).when(region_type == "L", F.lit(2.0) - mosaic)
            .otherwise(F.lit(2.0)))


def confusion(truth: Column, called: Column) -> Column:
    same = F.when(truth == "No Change", "TN").otherwise("TP")
    return F.when(truth == called, same).otherwise(F.when(truth == "No Change", "FP").otherwise("FN"))


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, specificity, accuracy and F1; 0 where the denominator is empty."""
    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {
        "precision": precision, "recall": recall, "specificity": share(tn, tn + fp),
        "accuracy": share(tp + tn, tp + tn + fp + fn),
        "f1": share(F.lit(2.0) * precision * recall, precision + recall),
    }
