"""Imports every query module so that the catalogue is complete."""

from karyospark.plans import (  # noqa: F401
    bic_queries,
    evaluation_queries,
    interval_queries,
    io_queries,
    report_queries,
    scalar_queries,
    track_queries,
)
from karyospark.plans.registry import CATALOGUE  # noqa: F401
