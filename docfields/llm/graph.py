"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize


def components(links: DataFrame) -> DataFrame:
    """Columns (a, b) to (node, root): the smallest node that can be reached. Nodes without links are absent.

    Alternates large-star and small-star steps until nothing changes. Each step is a minimum per node (combined
    before the shuffle) and a join of the links with it, so a node with very many links is a skewed join, not one
    group. Every round is written to the shared folder, which cuts the lineage.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct())
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
