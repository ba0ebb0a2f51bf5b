"""The catalogue that `__spark_entry__` exposes: each query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from karyospark.plans.projections import with_ctes


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None

    @property
    def sql(self) -> str | None:
        """The checking SQL with the projections it uses, which any module may have defined."""
        return with_ctes(self.body) if self.body else None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query. `sql` may name any projection of `projections.CTES`; they are prepended."""
    def register(run):
        if name in CATALOGUE:
            raise ValueError(f"query registered twice: {name}")
        CATALOGUE[name] = Query(run, sql)
        return run
    return register
