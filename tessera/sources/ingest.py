"""Names and notes of a library folder, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import base_title, first_sentence, title_part
from tessera.operators.graph import written


def album_dir(name: Column) -> Column:
    """(type, title, year) of "[type] title (year)"; any other name fails the query."""
    pattern = r"^\[(.+?)\]\s*(.+?)\s*\(([0-9.\-]+)\)$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    ok = F.when(~name.rlike(pattern), F.raise_error(F.concat(F.lit("not an album's folder: "), name)))
    return F.coalesce(ok.cast("struct<type:string,title:string,year:string>"), F.struct(part(1).alias("type"), part(2).alias("title"), part(3).alias("year")))


def track_file(name: Column) -> Column:
    """(track, title, lang) of "NN.title.lang.lrc", with white space before the title or without; null for other names."""
    pattern = r"^(\d+)\.(?U:\s*)(.+)\.(ja|zh)\.lrc$"  # fixed value: the pattern of names
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(part(1).cast("int").alias("track"), part(2).alias("title"), part(3).alias("lang")))


def credit(text: Column) -> Column:
    """(by, source): the first [by:...] and [from:...] line of a timed text, each stripped, "" without one."""
    tag = lambda name: F.regexp_replace(F.regexp_extract(text, rf"(?m)^\[{name}:(.*)\](?U:\s*)$", 1), r"(?U)^\s+|\s+$", "")
    return F.struct(tag("by").alias("by"), tag("from").alias("source"))


def background(text: Column) -> Column:
    """(zh, spec, note, titles) of an album's notes in Markdown; what they lack is null, and titles maps a track's title to its translation.

    zh is the last part in the heading's parentheses, spec what follows its label, note
    the first sentence of the first section; titles come from the rows of the table.
    """
    found = lambda pattern: F.regexp_extract(text, pattern, 1)
    there = lambda pattern, value: F.when(text.rlike(pattern), value)
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    # Patterns of the notes.
    heading, spec, note = r"(?m)^# 《.+?\((.+?)\)》", r"专辑规格\*\*[：:](?U:\s*)(.+)", r"(?s)## 一、.*?\n\n(.+?)\n"
    row = r"(?m)^\|(?U:\s*)\*\*\d+\.(?U:\s*)(.+?)\*\*(?U:\s*)\|(?U:\s*)\*\*(.+?)\*\*"
    part = lambda i: F.transform(F.regexp_extract_all(text, F.lit(row), F.lit(i)), strip)
    pairs = F.zip_with(part(1), part(2), lambda k, v: F.struct(k.alias("key"), strip(title_part(v)).alias("value")))
    # A title that stands twice has its last translation.
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.struct(there(heading, strip(title_part(found(heading), last=True))).alias("zh"), there(spec, strip(found(spec))).alias("spec"), there(note, strip(first_sentence(strip(found(note))))).alias("note"), F.map_from_entries(last).alias("titles"))


def ranked(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """df with its place in the given order, from after + 1 on, as `name` (long).

    Ranks are made within partitions of a range sort and shifted by what precedes them,
    so no task holds all rows. The partitions are written, as another sampling of the
    ranges would deal the rows otherwise.
    """
    placed = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    placed = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(sizes.withColumn("_b", F.coalesce(before, F.lit(0))).drop("n"), "_p").withColumn(name, (F.col("_b") + F.col("_r") + F.lit(after)).cast("long")).drop("_p", "_r", "_b")


def next_ids(new: DataFrame, old: DataFrame, order: list[str], start: str = "id") -> DataFrame:
    """new with ids that go on from the largest of old, in the given order."""
    last = old.agg(F.coalesce(F.max(start), F.lit(0)).alias("last")).first()["last"]  # one number
    return ranked(new, order, start, last)


#: Where songs of albums that aren't listed stand.
UNLISTED = 99


def first_versions(songs: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """songs (id, band, album_ord, track, title, ...) with dup_of: the first song of the same band and base title; null for itself.

    Songs go by album, unlisted albums (null) as number 99, by track (null: 0), and among
    equals by the columns of `ties`, the catalogue's order, or else by id.
    """
    key = [F.col("band"), F.regexp_replace(base_title(F.col("title")), r"(?U)^\s+|\s+$", "")]
    place = F.struct(F.coalesce("album_ord", F.lit(UNLISTED)).alias("album"), F.coalesce("track", F.lit(0)).alias("track"), F.struct(*(ties or ["id"])).alias("tie"), "id")
    firsts = songs.groupBy(key[0].alias("_band"), key[1].alias("_base")).agg(F.min(place).alias("_first"))
    same = songs["band"].eqNullSafe(F.col("_band")) & key[1].eqNullSafe(F.col("_base"))
    return songs.join(firsts, same).withColumn("dup_of", F.when(F.col("_first.id") != F.col("id"), F.col("_first.id"))).drop("_band", "_base", "_first")


def existing_songs(files: DataFrame, songs: DataFrame) -> DataFrame:
    """files (album, title, ...) with song (null: new) and renamed (the song's title differs now, so the file is skipped).

    A song of the album matches by its title, or by the one that the library knows.
    """
    keys = songs.select("id", F.col("album").alias("_album"), F.col("title").alias("_title"), F.explode(F.array_distinct(F.array("title", F.coalesce("lib_title", "title")))).alias("_name"))
    first = keys.groupBy("_album", "_name").agg(F.min(F.struct("id", "_title")).alias("_song"))
    wide = files.join(first, (F.col("album") == F.col("_album")) & (F.col("title") == F.col("_name")), "left")
    return wide.withColumn("song", F.col("_song.id")).withColumn("renamed", F.coalesce(F.col("_song._title") != F.col("title"), F.lit(False))).drop("_album", "_name", "_song")
