"""Connected components of a link table: hook every node to its least neighbour's label, then shorten the chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """node and component, the least node of its component, for every node of a link; links are undirected.

    Each round is two joins and an aggregation with partial sums, so a node of very many links is no single task's work;
    the labels of a round are a staged table, and rounds grow with the logarithm of the longest chain.
    """
    scratch, tag = scratch or Scratch(links.sparkSession, "components"), uuid.uuid4().hex[:8]
    both = scratch.stage(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(b, a)).distinct(), f"links_{tag}")
    moved = scratch.stage(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")).withColumn("old", F.col("component")), f"labels_{tag}_0")
    turn = 0
    while True:
        labels = moved.select("node", "component")
        reached = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        hooked = labels.join(reached, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        # a node's label is a node too: its own label is as near or nearer
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("top"))
        moved = scratch.stage(hooked.join(up, "to").select("node", "old", F.least("to", "top").alias("component")), f"labels_{tag}_{turn + 1}")
        scratch.drop(f"labels_{tag}_{turn}")
        turn += 1
        if moved.where("component < old").isEmpty():
            scratch.drop(f"links_{tag}")
            return moved.select("node", "component")
