"""Small numeric and text conversions used at the edges of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from karyospark.schema import MASKED_LOG2


def unmask(value: Column, sentinel: float = MASKED_LOG2) -> Column:
    """File sentinel to NULL: only values above it are real."""
    return F.when(value > sentinel, value)


def remask(value: Column, sentinel: float = MASKED_LOG2) -> Column:
    return F.coalesce(value, F.lit(sentinel))


def midpoint(bin_index: Column, bin_size: int) -> Column:
    return bin_index * bin_size + bin_size // 2


def megabases(length: Column) -> Column:
    return length / F.lit(1e6)


def percent_text(number: Column, decimals: int = 2) -> Column:
    return F.when(number.isNotNull(), F.format_string(f"%.{decimals}f%%", number))


def percent_number(text: Column) -> Column:
    return F.rtrim(text, F.lit("%")).try_cast("double")


def fixed_text(number: Column, decimals: int) -> Column:
    return F.when(number.isNotNull(), F.format_string(f"%.{decimals}f", number))


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd, today where absent."""
    return F.coalesce(F.to_date(text, "yyyy-MM-dd"), F.current_date())


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    """Value of an enumeration with a default for NULL; anything else raises."""
    return (F.when(value.isNull() | (value == ""), default).when(value.isin(allowed), value)
            .otherwise(F.raise_error(F.concat(F.lit("value not allowed: "), value)).cast("string")))


def phenotype_labels(annotation: Column, limit: int = 10) -> Column:
    """'phenotype (id)' of the first entries; NULL when there are none."""
    labels = F.transform(annotation, lambda a: F.concat(a["OMIM_phenotype"], F.lit(" ("), a["OMIM_ID"], F.lit(")")))
    return F.when(F.coalesce(F.size(annotation), F.lit(0)) > 0, F.slice(labels, 1, limit))


def read_passes(mapq: Column, flag: Column, min_mapq: int = 30, exclude_flags: int = 0x4) -> Column:
    """Mapping-quality and flag filter of aligned reads."""
    return (mapq >= min_mapq) & (flag.bitwiseAND(F.lit(exclude_flags)) == 0)
