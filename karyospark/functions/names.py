"""Sample, file and experiment names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming patterns of samples and plates.
STRICT_SAMPLE = r"^([A-Z0-9]+)-(.+)-([A-Z0-9]+)$"
PLATE = r"_[A-Z0-9]+$"
NUMBERED_PLATE = r"_S\d+$"
# Display names of callers.
PRETTY_ALGORITHM = {"bicseq2": "BIC-seq2", "wisecondorx": "WISECONDORX", "bluefuse": "BlueFuse",
                    "baseline": "Baseline"}


def parse_strict(filename: Column, strict: bool = True) -> Column:
    """struct(flowcell, cycle, embryo); a name outside the pattern raises (or gives NULLs)."""
    name = F.regexp_replace(F.trim(F.regexp_replace(filename, r"\.bam", "")), PLATE, "")
    bad = F.raise_error(F.concat(F.lit("bad sample file name: "), filename)).cast("string") if strict \
        else F.lit(None).cast("string")
    part = [F.when(name.rlike(STRICT_SAMPLE), F.regexp_extract(name, STRICT_SAMPLE, i)).otherwise(bad)
            for i in (1, 2, 3)]
    return F.struct(part[0].alias("flowcell"), part[1].alias("cycle"), part[2].alias("embryo"))


def _filled(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "UNKNOWN").otherwise(text)


def parse_lenient(raw: Column) -> Column:
    """struct(flowcell, cycle, embryo) with UNKNOWN where a part is missing."""
    name = F.regexp_replace(raw, r"\.bam$", "")
    parts = F.split(name, "-")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    embryo_cut = F.element_at(F.split(last, "_"), 1)
    middle = F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "-")
    blank = F.coalesce(F.trim(raw), F.lit("")) == ""
    flowcell = F.when(blank | (n == 1), "UNKNOWN").otherwise(_filled(F.element_at(parts, 1)))
    cycle = F.when(blank | (n == 1), "UNKNOWN").otherwise(_filled(middle))
    embryo = (F.when(blank, F.coalesce(raw, F.lit("UNKNOWN"))).when(n == 1, embryo_cut)
              .when(last == "", "UNKNOWN").otherwise(F.when(embryo_cut == "", last).otherwise(embryo_cut)))
    return F.struct(flowcell.alias("flowcell"), cycle.alias("cycle"), embryo.alias("embryo"))


def parse_viewer(sample: Column) -> Column:
    """struct(flowcell, cycle, embryo, display); short names stand for all three parts."""
    parts = F.split(sample, "-")
    short = F.size(parts) < 3
    flowcell = F.when(short, sample).otherwise(F.element_at(parts, 1))
    embryo = F.when(short, sample).otherwise(F.element_at(parts, -1))
    cycle = F.when(short, sample).otherwise(
        F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), "-"))
    return F.struct(flowcell.alias("flowcell"), cycle.alias("cycle"), embryo.alias("embryo"),
                    F.concat_ws("-", flowcell, embryo).alias("display"))


def strip_plate(name: Column) -> Column:
    return F.regexp_replace(name, NUMBERED_PLATE, "")


def cycle_embryo_key(filename: Column) -> Column:
    """'FC-CY-E_S93.bam' to 'CY-E'."""
    return F.regexp_replace(F.regexp_replace(filename, r"_S\d+\.bam$", ""), r"^[^-]*-", "")


def file_pair_part(filename: Column) -> Column:
    """struct(sample, algorithm, kind) of '<sample>_<algorithm>_bins|segments.tsv'; NULLs if it is neither."""
    pattern = r"^(.+)_([^_]+)_(bins|segments)\.tsv$"
    part = [F.when(filename.rlike(pattern), F.regexp_extract(filename, pattern, i)) for i in (1, 2, 3)]
    return F.struct(part[0].alias("sample"), part[1].alias("algorithm"), part[2].alias("kind"))


def normalise_algorithm(text: Column) -> Column:
    token = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.when(token.contains("bic"), "bicseq2").otherwise(token)


def pretty_algorithm(token: Column) -> Column:
    out = F.when(token.isNull(), "")
    for key, label in PRETTY_ALGORITHM.items():
        out = out.when(F.lower(token) == key, label)
    return out.otherwise(token)


def parse_experiment(name: Column) -> Column:
    """struct(chroms, types, mosaic) of 'chrom-type-mosaic'; '34' stands for chromosomes 3 and 4."""
    parts = F.split(name, "-")
    chrom, types = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    double = chrom == "34"
    chroms = F.when(double, F.array(F.lit(3), F.lit(4))).otherwise(F.array(chrom.try_cast("int")))
    kinds = F.when(double, F.array(F.substring(types, 1, 1), F.substring(types, -1, 1))).otherwise(F.array(types))
    return F.struct(chroms.alias("chroms"), kinds.alias("types"), F.get(parts, F.lit(2)).alias("mosaic"))
