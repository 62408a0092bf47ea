"""Connected components of an edge list, as DataFrame jobs.

Rounds of taking the smallest label among neighbours, then the label of that label, until
nothing changes; a round is written to the shared folder.  Labels fall along a path by
doubling steps, so the number of rounds follows the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.llm import common


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id on an edge; component_id is the smallest id reachable.

    Repeated edges, loops and either direction are fine; nulls are ignored; without edges the
    result is empty.
    """
    links = edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} != {b}")
    links = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    links = common.materialise(links, "links")
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = common.materialise(
        both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "id"), "labels"
    )
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("offered"))
        lower = (
            labels.join(near.withColumnRenamed("u", "id"), "id", "left")
            .select("id", F.col("label").alias("was"), F.least("label", "offered").alias("label"))
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        moved = common.materialise(moved, "labels")
        changed = moved.where("label != was").limit(1).count()
        common.discard(labels)
        labels = moved.select("id", "label")
        labels.gridsift_path = moved.gridsift_path
        if not changed:
            common.discard(links)
            return labels.withColumnRenamed("label", "component_id")
