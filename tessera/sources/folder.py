"""A library of timed text in folders, read whole or as a stream of new files.

A library is band/[type] album (year)/NN.title.lang.lrc, with an album's notes beside. Spark's
own file source lists it, so any shared file system will do, and a stream keeps account
of the files that it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import nfc
from tessera.operators.temporal import parse_timed_text
from tessera.sources.ingest import album_dir, background, existing_songs, next_ids, track_file

_FILE = "path string, modificationTime timestamp, length long, content binary"
#: Fixed value: how the name of an album's notes begins.
_NOTES = "00_专辑背景"


def library_files(spark: SparkSession, path: str, stream: bool = False, files_a_batch: int = 1000) -> DataFrame:
    """(path, content) of all files under a folder; as a stream, of those that it hasn't seen, in batches.

    As everywhere in Spark, names that begin with a dot or an underscore and files of no
    bytes are not listed: an empty timed text is no song until it has a byte.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch) if stream else spark.read
    return reader.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).load(path).select("path", "content")


def _known(found: Column, what: str, name: Column) -> Column:
    """True; where nothing was found the query fails with the name."""
    fails = F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"unknown {what}, add it to the map: "), name)).cast("boolean"))
    return F.coalesce(fails, F.lit(True))


def scan(files: DataFrame, path: str, bands: DataFrame, albums: DataFrame) -> DataFrame:
    """(band, album, dir, file, path, value) of files (path, content) that stand in an album's folder under `path`.

    bands and albums (lib, id) give the ids of folders' and albums' names, which like the
    files' are brought to NFC. A folder whose name isn't one of an album, and a band or
    an album that the map lacks, fail the query; files elsewhere, and null paths, are
    left out. dir is (type, title, year) of the album's folder; null contents stay null.
    """
    root = path.rstrip("/") + "/"
    at = F.instr("path", root)
    parts = F.split(F.substring(F.col("path"), at + len(root), F.length("path")), "/")
    named = files.where(at > 0).withColumn("_p", parts).where(F.size("_p") == 3)
    named = named.select("path", F.col("content").cast("string").alias("value"), nfc(F.col("_p")[0]).alias("_band"), nfc(F.col("_p")[1]).alias("_album"), nfc(F.col("_p")[2]).alias("file"))
    named = named.withColumn("dir", album_dir(F.col("_album"))).withColumn("_title", F.col("dir.title"))
    ids = lambda df, lib, id_: df.select(nfc("lib").alias(lib), F.col("id").alias(id_)).dropDuplicates([lib])
    wide = named.join(ids(bands, "_band", "band"), "_band", "left").join(ids(albums, "_title", "album"), "_title", "left")
    return wide.where(_known(F.col("band"), "band", F.col("_band")) & _known(F.col("album"), "album", F.col("_title"))).select("band", "album", "dir", "file", "path", "value")


def tracks(scanned: DataFrame) -> DataFrame:
    """The timed texts of a scan: (band, album, dir, track, title, lang, path, value); other files are left out."""
    named = scanned.withColumn("_t", track_file(F.col("file"))).where("_t IS NOT NULL")
    return named.select("band", "album", "dir", "_t.*", "path", "value")


def timed_lines(scanned: DataFrame, performers: tuple[str, ...] = ()) -> DataFrame:
    """(path, ms, text, ord) of the timed texts of a scan, in a batch or a stream."""
    return parse_timed_text(tracks(scanned).select("path", "value"), performers)


def ingested_songs(scanned: DataFrame, songs: DataFrame, band_order: DataFrame) -> DataFrame:
    """(id, album, ja, zh, track, file, new) of the Japanese texts of a scan, by songs (id long, album, ja, zh, lib_ja).

    A song of the album is known by its title or its old one in the library; a file that
    has the old title of a renamed song is left out. New songs get ids that go on from the
    largest, by band_order (band, ord), year, album and file, and their translated title
    from the album's notes, else their own. file is where its texts go, without language.
    """
    found = tracks(scanned).where("lang = 'ja'")
    known = songs.select("id", "album", F.col("ja").alias("title"), F.col("lib_ja").alias("lib_title"))
    named = existing_songs(found.drop("value"), known).where(~F.col("renamed"))
    notes = scanned.where(F.col("file").startswith(_NOTES)).withColumn("_text", nfc("value"))
    notes = notes.groupBy("album").agg(F.min_by("_text", "file").alias("_text")).select("album", background(F.col("_text")).alias("_notes"))
    where = F.format_string("%s/%s/%02d.%s", "band", "album", "track", "title")
    rows = named.join(notes, "album", "left").join(songs.select(F.col("id").alias("song"), "zh"), "song", "left").withColumn("file", where)
    old = rows.where("song IS NOT NULL").select(F.col("song").alias("id"), "album", F.col("title").alias("ja"), "zh", "track", "file", F.lit(False).alias("new"))
    fresh = rows.where("song IS NULL").join(band_order, "band", "left").withColumn("zh", F.coalesce(F.try_element_at("_notes.titles", F.col("title")), F.col("title")))
    fresh = fresh.select("album", F.col("title").alias("ja"), "zh", "track", "file", "ord", F.col("dir.year").alias("year"))
    fresh = next_ids(fresh, songs, ["ord", "year", "album", "file"])
    return old.unionByName(fresh.select("id", "album", "ja", "zh", "track", "file", F.lit(True).alias("new")))
