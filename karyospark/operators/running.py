"""Running sums that never put one key into one task.

A plain window over a chromosome would sort all of its positions in a single task. Here equal
positions are combined first, so a block of `block` positions holds at most that many rows
however often one position occurs; blocks are summed, their totals are carried forward (few
rows per key), and only the rows inside one block are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 20


def carry_forward(df: DataFrame, keys: list[str], block: str, order: list[str], measures: list[str]) -> DataFrame:
    """Inclusive running sums `run_<m>` by `order` inside `keys`, computed block by block."""
    totals = df.groupBy(*keys, block).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, block, *[
        F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_c_{m}") for m in measures])
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(m).over(inside).alias(f"_l_{m}") for m in measures])
    return (local.join(carry, [*keys, block])
            .withColumns({f"run_{m}": F.col(f"_l_{m}") + F.col(f"_c_{m}") for m in measures})
            .drop(*[f"_l_{m}" for m in measures], *[f"_c_{m}" for m in measures]))


def running_totals(events: DataFrame, keys: list[str], pos: str, measures: list[str],
                   block: int = BLOCK) -> DataFrame:
    """One row per distinct (keys, pos) with inclusive running sums of the measures."""
    combined = (events.groupBy(*keys, pos).agg(*[F.sum(m).alias(m) for m in measures])
                .withColumn("_block", F.floor(F.col(pos) / F.lit(block))))
    return carry_forward(combined, keys, "_block", [pos], measures).drop("_block")
