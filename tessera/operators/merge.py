"""Merges of progress documents, kept as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way_learned(cloud: DataFrame, local: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """(cloud or added locally) without what was removed locally."""
    flag = lambda d, n: d.select(*keys, F.lit(True).alias(n)).distinct()
    x = flag(cloud, "c").join(flag(local, "l"), keys, "full_outer").join(flag(base, "b"), keys, "full_outer")
    there = lambda n: F.col(n).isNotNull()
    return x.where((there("c") | (there("l") & ~there("b"))) & ~(there("b") & ~there("l"))).select(*keys)


def three_way_log(cloud: DataFrame, local: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """cloud + (local - base), by key; what is missing counts as 0."""
    named = lambda d, n: d.select(*keys, F.col(value).alias(n))
    x = named(cloud, "c").join(named(local, "l"), keys, "full_outer").join(named(base, "b"), keys, "full_outer")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return x.select(*keys, (zero("c") + zero("l") - zero("b")).alias(value))


def three_way_srs(cloud: DataFrame, local: DataFrame, base: DataFrame, keys: list[str], box: str, due: str) -> DataFrame:
    """Reviews (keys, box, due): the cloud's, but for those that this device changed since the base.

    Of a word that both changed the review with the later due date counts, at equal dates
    the larger box; one that only this device removed goes.
    """
    state = lambda d, n: d.select(*keys, F.struct(F.col(due).alias("due"), F.col(box).alias("box")).alias(n))
    x = state(cloud, "c").join(state(local, "l"), keys, "full_outer").join(state(base, "b"), keys, "full_outer")
    mine, theirs = ~F.col("l").eqNullSafe(F.col("b")), ~F.col("c").eqNullSafe(F.col("b"))
    kept = x.select(*keys, F.when(mine & theirs, F.greatest("c", "l")).when(mine, F.col("l")).otherwise(F.col("c")).alias("s"))
    return kept.where("s IS NOT NULL").select(*keys, F.col("s.box").alias(box), F.col("s.due").alias(due))


def union_larger(cloud: DataFrame, local: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Without a base: all keys, the larger (or later) value of each."""
    x = cloud.select(*keys, F.col(value).alias("c")).join(local.select(*keys, F.col(value).alias("l")), keys, "full_outer")
    return x.select(*keys, F.greatest("c", "l").alias(value))
