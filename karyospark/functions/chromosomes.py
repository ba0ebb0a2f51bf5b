"""Chromosome naming and ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from karyospark.schema import CHROMOSOMES

# Names dropped on import, and the sex chromosomes as numbers.
DROPPED_NAMES = ["M", "MT", "25"]
NUMBER_OF_SEX_CHROMOSOME = {"X": "23", "Y": "24"}


def _numbered(name: Column) -> Column:
    return F.when(name == "X", "23").when(name == "Y", "24").otherwise(name)


def to_number_text(chrom: Column) -> Column:
    """Name without any 'chr', X and Y as 23 and 24, other text unchanged, NULL stays NULL."""
    return _numbered(F.regexp_replace(chrom.cast("string"), "chr", ""))


def to_number_text_nuclear(chrom: Column) -> Column:
    """As `to_number_text`, with NULL for the mitochondrion so that a filter can drop it."""
    bare = F.regexp_replace(chrom.cast("string"), "chr", "")
    return F.when(~bare.isin(DROPPED_NAMES), _numbered(bare))


def to_number(chrom: Column) -> Column:
    """Number 1..24, NULL for everything else."""
    number = to_number_text(chrom).try_cast("double")
    return F.when((number >= 1) & (number <= 24), number).cast("int")


def to_name(chrom_num: Column) -> Column:
    """1..24 back to a name."""
    return F.when(chrom_num == 23, "X").when(chrom_num == 24, "Y").otherwise(chrom_num.cast("string"))


def to_known_name(chrom: Column, strict: bool = True) -> Column:
    """Name 1..22, X, Y or MT; an unknown name raises (or is NULL when not strict)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(chrom), "^chr", ""), "^CHR", "")
    name = F.when(bare == "23", "X").when(bare == "24", "Y").otherwise(F.upper(bare))
    unknown = (
        F.raise_error(F.concat(F.lit("unknown chromosome: "), chrom)).cast("string")
        if strict else F.lit(None).cast("string")
    )
    return F.when(name.isin([*CHROMOSOMES, "MT"]), name).otherwise(unknown)


def sort_key(chrom: Column) -> Column:
    """Biological order: 1..22, X, Y, MT, then everything unknown (999)."""
    bare = F.upper(F.regexp_replace(F.trim(chrom), "(?i)^chr", ""))
    number = bare.try_cast("int")
    return (
        F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25)
        .when(number.between(1, 25), number).otherwise(999)
    )


def is_nuclear_contig(chrom: Column) -> Column:
    """Contig names that alignment keeps: chr1..chr22, chrX, chrY, chrMT."""
    return chrom.isin([f"chr{c}" for c in [*CHROMOSOMES, "MT"]])
