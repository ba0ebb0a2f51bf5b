"""Connected components of an edge table: least label by neighbours and by jumping, a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyospark.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the least node that is connected to it, for every node of ``edges`` (long columns).

    A round takes the least label among a node and its neighbours, then the label of that label. Labels are sums of
    what is there, so a lost executor only repeats its part; each round ends in a table in the shared folder.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("next")))
    both = common.written(both.where("node <> next").distinct(), "cc-edges")
    labels = common.written(both.groupBy("node").agg(F.least("node", F.min("next")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        met = common.written(met, "cc-met")
        jump = met.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = common.written(met.join(jump, "label", "left").select("node", "was", F.least("label", "beyond").alias("label")), "cc-labels")
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
