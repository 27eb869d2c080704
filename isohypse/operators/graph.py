"""Connected components of edges, for regions of labels that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import checkpoints


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, region: nodes (id) with the least id that edges (a, b) connect them to.

    Least labels spread along edges and jump to their own labels' labels; each round is a checkpoint.
    """
    checkpoints(nodes.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    now = nodes.select("id", F.col("id").alias("region")).distinct().checkpoint()
    while True:
        seen = both.join(now.select(F.col("id").alias("b"), "region"), "b").groupBy(F.col("a").alias("id")).agg(F.min("region").alias("seen"))
        step = now.join(seen, "id", "left").select("id", "region", F.least("region", F.coalesce("seen", "region")).alias("next"))
        up = step.select(F.col("id").alias("next"), F.col("next").alias("above"))
        after = step.join(up, "next", "left").select("id", F.least("next", F.coalesce("above", "next")).alias("near"), "region").select("id", F.col("near").alias("region"), (F.col("near") < F.col("region")).alias("moved")).checkpoint()
        if after.where("moved").isEmpty():
            return after.select("id", "region")
        now = after.drop("moved")
