"""A library in folders, as a batch and as a stream."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.sources.folder import ingested_songs, library_files, scan, timed_lines, tracks

FILES = {
    "Yoru/[single] Two words (2021.02)/01. あ が.ja.lrc": "[00:02.5][00:01.25]two\n[00:03.1]Yoru - x\n作词：a\n[00:09]",
    "Yoru/[single] Two words (2021.02)/01. あ が.zh.lrc": "[00:01.25]zh",
    "Yoru/[single] Two words (2021.02)/02.old name.ja.lrc": "[00:01]old",
    "Yoru/[single] Two words (2021.02)/03.here.ja.lrc": "\n",
    "Yoru/[single] Two words (2021.02)/04.empty.ja.lrc": "",
    "Yoru/[single] Two words (2021.02)/00_专辑背景与曲目.md": "# 《x (甲 / 乙)》\n| **1. あ が** | **啊 / q** |\n",
    "Yoru/[full] One (2019)/10.a [b] %20 c.ja.lrc": "[01:00]last\n[00:00.5]first\r\n[00:00.5]again",
    "Aki/[full] Ohne (2020)/1.z.ja.lrc": "[00:00]z",
    "Aki/readme.txt": "no",
}


def _write(root, files):
    for name, text in files.items():
        at = root / unicodedata.normalize("NFD", name)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, newline="")


def _maps(spark):
    bands = spark.createDataFrame([("Yoru", "y", 0), ("Aki", "k", 1)], "lib string, id string, ord int")
    return bands, spark.createDataFrame([("Two words", "two"), ("One", "one"), ("Ohne", "ohne")], "lib string, id string")


def test_scan(spark, tmp_path):
    _write(tmp_path, FILES)
    bands, albums = _maps(spark)
    seen = scan(library_files(spark, str(tmp_path)), str(tmp_path), bands, albums)
    got = {(r.band, r.album, r.dir.type, r.dir.year, r.track, r.title, r.lang) for r in tracks(seen).collect()}
    two = ("y", "two", "single", "2021.02")
    assert got == {(*two, 1, "あ が", "ja"), (*two, 1, "あ が", "zh"), (*two, 2, "old name", "ja"), (*two, 3, "here", "ja"), ("y", "one", "full", "2019", 10, "a [b] %20 c", "ja"), ("k", "ohne", "full", "2020", 1, "z", "ja")}
    said = {(r.ms, r.text, r.ord) for r in timed_lines(seen.where("album != 'ohne'"), ("Yoru",)).collect()}
    assert said == {(1250, "two", 0), (2500, "two", 1), (1250, "zh", 0), (1000, "old", 0), (500, "first", 0), (500, "again", 1), (60000, "last", 2)}
    songs = spark.createDataFrame([(4, "two", "new name", "新", "old name"), (7, "two", "here", "这", None), (9, "one", "else", "e", None)], "id long, album string, ja string, zh string, lib_ja string")
    made = ingested_songs(seen, songs, bands.select(F.col("id").alias("band"), "ord"))
    assert {tuple(r) for r in made.collect()} == {(7, "two", "here", "这", 3, "y/two/03.here", False), (10, "one", "a [b] %20 c", "a [b] %20 c", 10, "y/one/10.a [b] %20 c", True), (11, "two", "あ が", "啊", 1, "y/two/01.あ が", True), (12, "ohne", "z", "z", 1, "k/ohne/01.z", True)}


@pytest.mark.parametrize("name,says", [("New/[full] One (2019)/1.x.ja.lrc", "unknown band.*New"), ("Aki/[full] Other (2019)/1.x.ja.lrc", "unknown album.*Other"), ("Aki/misc/1.x.ja.lrc", "not an album")])
def test_unknown_names_fail(spark, tmp_path, name, says):
    _write(tmp_path, {name: "[00:00]x"})
    with pytest.raises(Exception, match=says):
        scan(library_files(spark, str(tmp_path)), str(tmp_path), *_maps(spark)).select("value").collect()


def test_stream_reads_new_files_only(spark, tmp_path):
    """Files come in two parts, with a restart between: all lines once, as the batch has them."""
    root, out, at = tmp_path / "lib", str(tmp_path / "out"), str(tmp_path / "at")
    names = list(FILES)
    for part in (names[:4], names[4:]):
        _write(root, {n: FILES[n] for n in part})
        seen = timed_lines(scan(library_files(spark, str(root), stream=True, files_a_batch=2), str(root), *_maps(spark)))
        q = seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
    want = timed_lines(scan(library_files(spark, str(root)), str(root), *_maps(spark)))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_empty_and_null(spark):
    none = spark.createDataFrame([(None, None), ("/r/Yoru/[full] One (2019)/1.x.ja.lrc", None), ("/elsewhere/x", b"q")], "path string, content binary")
    seen = scan(none, "/r", *_maps(spark))
    assert [r.value for r in seen.collect()] == [None] and timed_lines(seen).count() == 0 and timed_lines(seen.limit(0)).count() == 0
