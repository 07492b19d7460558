"""Intervals of lines: what is inside of what, without a product of the two sides.

Both sides are half-open (s, e) with keys that name a line. A line of any length is cut
into blocks of places, so that one hot line is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block of a sweep, and of a join, in which each interval meets all of the block.
BLOCK, JOIN_BLOCK = 4096, 64


def _block(place: Column, size: int | None = None) -> Column:
    return F.floor(place / (size or BLOCK)).cast("long")


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))


def covered(inner: DataFrame, outer: DataFrame, keys: list[str], s: str = "c_start", e: str = "c_end", name: str = "covered") -> DataFrame:
    """inner with a boolean: whether an interval of outer (keys, s, e) in the same line holds the row's.

    A sweep: intervals of both sides are sorted by start, and a row is covered if the
    farthest end so far, of outer ones that start with it or before, reaches its own. What
    reaches into a block from those before it comes in as one more interval at its start.
    Rows with null keys or places are not covered; repeated rows stay.
    """
    hits = _keyed(outer, [*keys, s, e]).select(*keys, F.col(s).cast("long").alias("_s"), F.col(e).cast("long").alias("_e"))
    blocks = hits.groupBy(*keys, _block(F.col("_s")).alias("_block")).agg(F.max("_e").alias("_far"))
    later = _keyed(inner, [*keys, s]).select(*keys, _block(F.col(s)).alias("_block")).where("_block > 0").distinct()
    reach = blocks.join(later.select(*keys).distinct(), keys, "left_semi").withColumn("_ask", F.lit(False))
    asked = reach.unionByName(later.withColumn("_far", F.lit(None).cast("long")).withColumn("_ask", F.lit(True)))
    before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    carried = asked.withColumn("_e", F.max("_far").over(before)).where("_ask AND _e IS NOT NULL").select(*keys, (F.col("_block") * BLOCK).alias("_s"), "_e")
    fields = F.struct(*(c for c in inner.columns))
    rows = inner.select(*keys, F.col(s).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"), fields.alias("_row"))
    both = rows.unionByName(hits.unionByName(carried), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, _block(F.col("_s"))).orderBy("_s")  # equal starts count
    swept = both.withColumn("_far", F.max("_e").over(so_far)).where(F.col("_row").isNotNull())
    there = reduce(lambda a, b: a & b, (F.col(f"_row.{k}").isNotNull() for k in [*keys, s]))
    return swept.select(*(F.col("_row")[c].alias(c) for c in inner.columns), (there & F.coalesce(F.col("_far") >= F.col("_row")[e], F.lit(False))).alias(name))


def inside(inner: DataFrame, outer: DataFrame, keys: list[str], s: str = "c_start", e: str = "c_end") -> DataFrame:
    """Rows of outer, each with every row of inner that it holds; columns of both must differ but for keys, s and e, which are outer's.

    An outer interval meets the blocks of places that it spans, an inner one is in the
    block of its start: a join by line and block, with the places compared. Blocks are
    short, as pairs that don't hold grow with them.
    """
    spans = outer.withColumn("_block", F.explode(F.when(F.col(s) <= F.col(e), F.sequence(_block(F.col(s), JOIN_BLOCK), _block(F.col(e), JOIN_BLOCK)))))
    held = inner.withColumn("_block", _block(F.col(s), JOIN_BLOCK)).withColumnsRenamed({s: "_s", e: "_e"})
    return spans.join(held, [*keys, "_block"]).where((F.col("_s") >= F.col(s)) & (F.col("_e") <= F.col(e))).drop("_block", "_s", "_e")
