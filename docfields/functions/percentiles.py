"""Exact percentiles that never gather one group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in a single buffer. Here the values are first
counted per (group, value). A group with many distinct values is cut into buckets between its own smallest and largest
value; a histogram tells which buckets hold the wanted ranks, and only those go on and are cut again, until each holds few
enough values to be ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize

_LARGEST = 1.7976931348623157e308


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) <= _LARGEST, v)


def _bucket(buckets: int) -> Column:
    """Number of the bucket of ``_v`` between ``_lo`` and ``_hi``; infinite values and NaN have buckets of their own."""
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    # Halves, because the distance of the ends may be beyond the largest number.
    place = F.floor((v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0)) * buckets)
    inside = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.coalesce(place, F.lit(0))))
    return (
        F.when(F.isnan(v), buckets + 1).when(v == float("inf"), buckets).when(v == float("-inf"), -1)
        .otherwise(inside).cast("int"))


def _holding(ranks: Column, start: Column, n: Column) -> Column:
    """The ranks of which one neighbour lies in [start, start + n)."""
    end = start + n
    return F.filter(ranks, lambda r: ((r["lo"] >= start) & (r["lo"] < end)) | ((r["hi"] >= start) & (r["hi"] < end)))


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probabilities: dict[str, float],
    buckets: int = 1024,
    together: int = 4096,
) -> DataFrame:
    """One row per group with a linearly interpolated percentile per entry of ``probabilities``.

    Groups without any value are absent. At most ``together`` distinct values are ranked in one window; every round of
    cutting leaves at most two buckets per probability, with edges from the values in them, so values may lie anywhere and
    as close together as they like.
    """
    keys = list(keys)
    group = [*keys, "_node"]
    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .filter("_v is not null")
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts = materialize(counts.withColumn("_node", F.lit("")))
    edges = [F.min(_finite(F.col("_v"))).alias("_lo"), F.max(_finite(F.col("_v"))).alias("_hi"), F.count(F.lit(1)).alias("_d")]
    ranks = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            F.floor((F.col("_total") - 1) * p).cast("bigint").alias("lo"),
            F.ceil((F.col("_total") - 1) * p).cast("bigint").alias("hi"),
            ((F.col("_total") - 1) * p).alias("pos"),
        )
        for name, p in probabilities.items()
    ])
    nodes = counts.groupBy(*group).agg(F.sum("_n").alias("_total"), *edges).select(
        *group, "_lo", "_hi", "_d", F.lit(0).cast("bigint").alias("_start"), ranks.alias("_ranks"))
    nodes = materialize(nodes)
    done = None
    while True:
        small = counts.join(nodes.filter(F.col("_d") <= together).select(*group, "_start", "_ranks"), group)
        done = small if done is None else done.unionByName(small)
        large = nodes.filter(F.col("_d") > together)
        if large.isEmpty():
            break
        cut = materialize(counts.join(large.select(*group, "_lo", "_hi", "_start", "_ranks"), group).withColumn("_b", _bucket(buckets)))
        # The start and the wanted ranks of a node are the same in all its rows.
        histogram = cut.groupBy(*group, "_b").agg(
            F.sum("_n").alias("_bn"), *edges, F.min("_start").alias("_from"), F.first("_ranks").alias("_ranks"))
        before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        wanted = histogram.withColumn("_ranks", _holding(F.col("_ranks"), F.col("_start"), F.col("_bn"))).filter(F.size("_ranks") > 0)
        wanted = materialize(wanted.select(*group, "_b", "_lo", "_hi", "_d", "_start", "_ranks"))
        below = F.concat_ws("/", "_node", F.col("_b").cast("string"))
        counts = materialize(cut.select(*group, "_b", "_v", "_n").join(wanted.select(*group, "_b"), [*group, "_b"]).select(
            *keys, "_v", "_n", below.alias("_node")))
        nodes = wanted.withColumn("_node", below).drop("_b")
    in_node = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        done.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(in_node), F.lit(0)))
        .withColumn("_last", F.col("_first") + F.col("_n") - 1)
        .withColumn("_rank", F.explode("_ranks"))
    )

    def at(edge: str, name: str) -> Column:
        rank = F.col(f"_rank.{edge}")
        hit = (F.col("_rank.name") == name) & (rank >= F.col("_first")) & (rank <= F.col("_last"))
        return F.max(F.when(hit, F.col("_v")))

    def fraction(name: str) -> Column:
        return F.max(F.when(F.col("_rank.name") == name, F.col("_rank.pos") - F.col("_rank.lo")))

    aggregates = []
    for name in probabilities:
        low, high = at("lo", name), at("hi", name)
        # Equal neighbours, infinite ones too, have no distance to interpolate over.
        aggregates.append(F.when(low == high, low).otherwise(low + (high - low) * fraction(name)).alias(name))
    return ranked.groupBy(*keys).agg(*aggregates)
