import pytest
from pyspark.sql import functions as F

from tessera.operators.progress import review_state
from tessera.functions.text import base_title
from tessera.sources.ingest import album_dir, credit, first_versions, next_ids, track_file


def test_names(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert tuple(one(album_dir, "[single] A title (2019.04)")) == ("single", "A title", "2019.04")
    assert tuple(one(track_file, "03.a.b.ja.lrc")) == (3, "a.b", "ja") and one(track_file, "cover.jpg") is None
    assert tuple(one(track_file, "01. Song.ja.lrc")) == (1, "Song", "ja") and tuple(one(track_file, "2.\u3000a. b.zh.lrc")) == (2, "a. b", "zh")
    assert [one(base_title, x) for x in ("夜（live ver.）", "夜 (Live Ver.) ", "a (b) (demo)", "a(DEMO)", "(verse)", "a (b (c) ver.)")] == ["夜（live ver.）", "夜", "a (b)", "a", "(verse)", "a (b (c) ver.)"]
    assert tuple(one(credit, "[ti:x]\n[by: m]e\u3000]\n[from:you] \n[by:x]")) == ("m]e", "you") and tuple(one(credit, "none")) == ("", "")
    with pytest.raises(Exception, match="not an album"):
        one(album_dir, "misc")


def test_next_ids(spark):
    new = spark.createDataFrame([(x,) for x in "dbca"], "k string")
    got = {r.k: r.id for r in next_ids(new, spark.createDataFrame([(7,)], "id long"), ["k"]).collect()}
    assert got == {"a": 8, "b": 9, "c": 10, "d": 11}


def test_reviews(spark):
    rows = [("u", "w", d, i, g) for i, (d, g) in enumerate([(1, "remembered"), (3, "remembered"), (7, "vague"), (11, "forgot"), (12, "remembered")])]
    rows += [("u", "m", d, d, "remembered") for d in range(6)]
    got = {r.word: (r.box, r.due, r.mastered) for r in review_state(spark.createDataFrame(rows, "user string, word string, day int, ord int, grade string")).collect()}
    assert got == {"w": (1, 14, False), "m": (4, 20, True)}


def test_first_versions(spark):
    """Unlisted albums come after all listed ones but those from 99 on, and ties go by the catalogue's order."""
    rows = [("s10", 2, "b", None, None, "夜"), ("s2", 1, "b", None, None, "夜 (demo)"), ("s3", 3, "b", 4, 7, "夜 "), ("s4", 4, "c", None, 2, "x"), ("s5", 5, "c", 100, None, "x"), ("s6", 9, "d", 1, 1, "y"), ("s7", 8, "d", 1, 1, "y (Live ver)")]
    songs = spark.createDataFrame(rows, "id string, ord int, band string, album_ord int, track int, title string")
    assert {r.id: r.dup_of for r in first_versions(songs, ["ord"]).collect()} == {"s10": "s3", "s2": "s3", "s3": None, "s4": None, "s5": "s4", "s6": "s7", "s7": None}
    assert {r.id: r.dup_of for r in first_versions(songs.where("band = 'd'")).collect()} == {"s6": None, "s7": "s6"}
