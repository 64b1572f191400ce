"""Connected components by minimum labels with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of the undirected ``links``; the component
    is its smallest node. Each round every node takes the smallest label next to it,
    then the label of that label, so a chain of n nodes ends after about log n rounds.
    Labels of a round are a written table; a hot node's links are pre-aggregated
    before each shuffle and AQE splits its join. No links: an empty result."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("next")).union(
        links.select(F.col(b).alias("node"), F.col(a).alias("next"))).filter("node <> next").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("node").agg(F.min("next").alias("m"))
                    .select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("component").alias("m")), "next") \
            .groupBy("node").agg(F.min("m").alias("m"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("j"))
        step = stored(step.join(jump, "low", "left").select(
            "node", F.least("low", "j").alias("component"), (F.least("low", "j") < F.col("component")).alias("moved")), "labels")
        labels = step.select("node", "component")
        if step.filter("moved").isEmpty():
            return labels
