"""Nearest-time alignment, as-of lines and timed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import let

#: Lines of timed text that say who made it, not what is sung; fixed values.
CREDITS = ("作词", "作詞", "作曲", "编曲", "編曲", "演唱", "制作人", "标题", "歌")
#: Fixed value: dashes of title lines.
_DASH = "[-－–—]"


def nearest_align(left: DataFrame, right: DataFrame, key: str, within: int) -> DataFrame:
    """left (key, t, text) with r_text of the right row at the very t, else the nearest within `within`, inclusive.

    Ties go to the earlier right row, copies to the first by ord; unmatched text is "".
    The key and buckets of time make an equi-join, whatever one key holds.
    """
    width = max(within, 1)
    l = left.withColumn("_id", F.struct(key, "t", "ord")).withColumn("_b", F.explode(F.array(*(F.floor(F.col("t") / width) + d for d in (-1, 0, 1)))))
    r = right.select(key, F.col("t").alias("rt"), F.col("text").alias("r_text"), F.col("ord").alias("r_ord"), F.floor(F.col("t") / width).alias("_b"))
    near = l.join(r, [key, "_b"]).where(F.abs(F.col("t") - F.col("rt")) <= within)
    best = near.groupBy("_id").agg(F.min_by("r_text", F.struct(F.abs(F.col("t") - F.col("rt")), "rt", "r_ord")).alias("r_text"))
    return left.withColumn("_id", F.struct(key, "t", "ord")).join(best, "_id", "left").withColumn("r_text", F.coalesce("r_text", F.lit(""))).drop("_id")


def stamp_ms(stamp: Column) -> Column:
    """[mm:ss.fff] in milliseconds; the fraction is padded, or cut, to three digits. Any other text gives null."""
    part = lambda i: F.regexp_extract(stamp, r"^\[?(\d+):(\d+)(?:[.:](\d+))?\]?$", i)
    return part(1).try_cast("long") * 60000 + part(2).try_cast("long") * 1000 + F.rpad(part(3), 3, "0").try_cast("long")


def _timed_rows(line: Column, number: Column, performers: tuple[str, ...]) -> Column:
    """A line's array of (ms, file_line, stamp_no, text), one for each stamp; empty where it says nothing that is sung."""
    lead = F.regexp_extract(line, r"^((?:\[\d+:\d+(?:[.:]\d+)?\])*)", 1)
    text = F.substring(line, F.length(lead) + 1, F.length(line))
    for blank in (r"\s", r"\x{200B}\x{200E}\x{200F}\x{FEFF}", r"\s"):  # space, marks, and space within them
        text = F.regexp_replace(text, rf"(?U)^[{blank}]+|[{blank}]+$", "")

    def rows(text: Column) -> Column:
        drop = (F.length(text) == 0) | text.rlike(rf"(?U)^(?:{'|'.join(CREDITS)})\s*[:：]")
        for name in performers:
            drop |= text.rlike(rf"(?U)^\Q{name}\E\s*{_DASH}\s|\s{_DASH}\s*\Q{name}\E$")
        stamps = F.regexp_extract_all(lead, F.lit(r"\[[^\]]*\]"), F.lit(0))
        return F.transform(F.filter(stamps, lambda x: ~drop), lambda x, i: F.struct(stamp_ms(x).alias("ms"), number.alias("file_line"), i.alias("stamp_no"), text.alias("text")))

    return let(text, rows)


def parse_timed_text(files: DataFrame, performers: tuple[str, ...] = ()) -> DataFrame:
    """(path, ms, text, ord) from (path, value), whole files: a row for each stamp, in a batch or a stream.

    Rows without stamp or text, credits, and title lines that begin "performer - " or end
    " - performer" are dropped. A file's rows are put in order within its own array, so
    nothing is shuffled; a null file has none, and files of one path are numbered each.
    """
    parts = F.split("value", r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", -1)
    found = F.array_sort(F.flatten(F.transform(parts, lambda x, i: _timed_rows(x, i, performers))))
    return files.select("path", F.posexplode(found).alias("ord", "x")).select("path", "x.ms", "x.text", "ord")


def _carried(rows: DataFrame, key: str, bucket: str, state: str) -> DataFrame:
    """(key, bucket, before): the last state of an earlier bucket of the key; its window is over the buckets, not the rows."""
    last = rows.where(F.col(state).isNotNull()).groupBy(key, bucket).agg(F.max(state).alias("_end"))
    every = rows.select(key, bucket).distinct().join(last, [key, bucket], "left")
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return every.select(key, bucket, F.last("_end", ignorenulls=True).over(w).alias("before"))


def current_line(moments: DataFrame, timed: DataFrame, key: str, bucket: int = 3_600_000) -> DataFrame:
    """moments (key, at, ...) with the last (line_t, text) of timed (key, t, ord, text) at or before `at`; of lines at one t the largest ord counts.

    Rows of a key are dealt by buckets of time; each bucket takes the last line of those
    before it, so a key with very many rows is spread over tasks. Repeated moments each
    give a row; a null key or time gives null.
    """
    at = moments.withColumn("_t", F.col("at").cast("long")).withColumn("_kind", F.lit(1)).withColumn("_m", F.struct(*moments.columns))
    line = F.struct(F.col("t").cast("long").alias("t"), "ord", F.col("text"))
    both = at.select(key, "_t", "_kind", F.lit(None).cast("long").alias("_o"), "_m").unionByName(timed.select(key, F.col("t").cast("long").alias("_t"), F.lit(0).alias("_kind"), F.col("ord").cast("long").alias("_o"), line.alias("_line")), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col("_t") / bucket))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_last", F.last("_line", ignorenulls=True).over(w)).where("_kind = 1")
    before = _carried(both.where("_t IS NOT NULL"), key, "_b", "_line").select(F.col(key).alias("_k"), F.col("_b").alias("_c"), "before")
    out = own.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")), "left").withColumn("_last", F.when(F.col(key).isNotNull() & F.col("_t").isNotNull(), F.coalesce("_last", "before")))
    return out.select("_m.*", F.col("_last.t").alias("line_t"), F.col("_last.text").alias("text"))


def line_durations(timed: DataFrame, key: str, order: str | list[str], most: int) -> DataFrame:
    """timed (key, t, order) with ms until the key's next row, `most` at most, which the last row has too.

    Rows of one t go by `order`, a column or several; a finer time than t comes first in
    it, as which of them is the last one decides. No later row counts than one in the next `most` ms, so rows meet in buckets of that
    width, and each bucket sees the first row of the next.
    """
    b = timed.withColumn("_b", F.floor(F.col("t") / most))
    first = b.groupBy(F.col(key).alias("_k"), (F.col("_b") - 1).alias("_c")).agg(F.min("t").alias("_next"))
    w = Window.partitionBy(key, "_b").orderBy("t", *([order] if isinstance(order, str) else order))
    wide = b.withColumn("_own", F.lead("t").over(w)).join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")), "left")
    return wide.withColumn("ms", F.least(F.coalesce("_own", "_next") - F.col("t"), F.lit(most)).cast("long")).withColumn("ms", F.coalesce("ms", F.lit(most).cast("long"))).drop("_b", "_k", "_c", "_own", "_next")
