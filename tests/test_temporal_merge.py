from pyspark.sql import functions as F

from tessera.functions.text import base_title, mark_span, nfc, to_hira
from tessera.operators import graph, merge, temporal
from tessera.plans import queries
from tessera.streaming.daily import daily_log


def test_nearest(spark):
    left = spark.createDataFrame([(1, 1000, "a", 0), (1, 2000, "b", 1), (1, 5000, "c", 2)], "k int, t long, text string, ord int")
    right = spark.createDataFrame([(1, 700, "x", 0), (1, 1300, "y", 1), (1, 2000, "z", 2), (1, 2000, "zz", 3)], "k int, t long, text string, ord int")
    got = {r.text: r.r_text for r in temporal.nearest_align(left, right, "k", 300).collect()}
    assert got == {"a": "x", "b": "z", "c": ""}


def test_durations_within_a_millisecond(spark):
    """The finer time decides which row of one millisecond is the last, and milliseconds are those of the SQL: to the nearest."""
    rows = spark.sql("SELECT 1 AS user_id, timestamp_micros(u) AS ts, e AS event_id FROM VALUES (1000200L, 9L), (1000400L, 3L), (5000600L, 1L), (7000500L, 2L), (9000499L, 4L), (-1600L, 5L), (-1500L, 6L), (-499L, 7L) AS v (u, e)")
    t = rows.withColumn("t", queries._ms())
    assert {r.event_id: r.t for r in t.collect()} == {9: 1000, 3: 1000, 1: 5001, 2: 7001, 4: 9000, 5: -2, 6: -2, 7: 0}
    got = {r.event_id: r.ms for r in temporal.line_durations(t.where("t > 0"), "user_id", ["ts", "event_id"], 12000).collect()}
    assert got == {9: 0, 3: 4001, 1: 2000, 2: 1999, 4: 12000}


def test_timed_text(spark):
    files = spark.createDataFrame([("f", "[by:me]\n[00:02.5][00:01.25]　two \r\n[00:00.1]\n作词 : me\nno stamp\n[01:00]last​")], "path string, value string")
    rows = temporal.parse_timed_text(files).orderBy("ord").collect()
    assert [(r.ms, r.text) for r in rows] == [(1250, "two"), (2500, "two"), (60000, "last")]


def test_scalars(spark):
    row = spark.createDataFrame([("カタ", "Song (Live Ver.)", "abcde", "é")], "a string, b string, c string, d string").select(to_hira(F.col("a")).alias("a"), base_title(F.col("b")).alias("b"), mark_span(F.col("c"), F.lit(1), F.lit(3)).alias("c"), nfc("d").alias("d")).first()
    assert tuple(row) == ("かた", "Song", "a【bc】de", "é")


def test_merge(spark):
    side = lambda *w: spark.createDataFrame([(x,) for x in w], "w string")
    got = merge.three_way_learned(side("a", "b"), side("a", "c"), side("a", "b"), ["w"])
    assert sorted(r.w for r in got.collect()) == ["a", "c"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, graph.components(edges).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 33


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = daily_log(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, daily_log(events).collect()))
