"""Reviews in a batch and as a stream, against a plain fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.progress import INTERVALS, day_queue, review_state
from tessera.streaming.reviews import review_stream

ANSWERS = "user string, word string, day int, ord int, grade string"


def _plain(rows):
    out = {}
    for u, w, d, _, g in sorted((r for r in rows if None not in r and r[4] not in ("right", "x")), key=lambda r: (r[2], r[3], r[4])):
        box, _, done, begun = out.get((u, w), (0, 0, False, d))
        if g == "remembered":
            box, done = min(box + 1, 4), done or box == 4
        elif g == "forgot":
            box, done = 0, False
        out[u, w] = (box, d if g == "wrong" else d + INTERVALS[box], done, begun)
    return out


def _rows(seed, n, days):
    r = random.Random(seed)
    return [(f"u{r.choice('aab')}", f"w{r.randrange(12)}", days * i // n, i, r.choice(["remembered"] * 6 + ["vague", "forgot", "wrong", "right"])) for i in range(n)]


def _state(df):
    return {(r.user, r.word): (r.box, r.due, r.mastered, r.begun) for r in df.collect()}


def test_state_is_the_plain_fold(spark):
    rows = _rows(1, 400, 60)
    rows += [(None, "w1", 1, 1, "vague"), ("ua", None, 1, 1, "vague"), ("ua", "w1", None, 1, "vague"), ("ua", "w1", 3, 3, None), ("uz", "w", 3, 3, "x")]
    rows += rows[:50] + [("ue", "w", 2, 7, g) for g in ("wrong", "forgot", "vague", "remembered")]
    df = spark.createDataFrame(rows, ANSWERS)
    assert _state(review_state(df)) == _plain(rows)
    assert review_state(df.limit(0)).count() == 0


@pytest.mark.parametrize("day,limit", [(20, 15), (20, 3), (0, 15), (59, 40), (3, 0)])
def test_day_queue(spark, day, limit):
    rows = [r for r in _rows(2, 150, 60) if r[2] <= day] + [("uc", "odd", 0, 0, "vague")]
    words = [(f"w{i}", i + 1) for i in range(25)]
    state = _plain(rows)
    want = {(u, w, False) for (u, w), (_, due, done, _) in state.items() if due <= day and not done}
    for u in {u for u, _ in state}:
        room = max(limit - sum(s[3] == day for k, s in state.items() if k[0] == u), 0)
        want |= {(u, w, True) for w in [w for w, _ in words if (u, w) not in state][:room]}
    got = day_queue(review_state(spark.createDataFrame(rows, ANSWERS)), spark.createDataFrame(words, "word string, rank int"), day, limit).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stream_is_the_batch(spark, tmp_path):
    """Answers in three files, a restart between them: the last row of each word is the batch's state, and words that fell due were told."""
    rows, start = _rows(3, 300, 40), dt.datetime(1970, 1, 1)
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "user string, word string, ts timestamp, ord int, grade string"
    try:
        for part in (rows[:100], rows[100:200], rows[200:]):
            df = spark.createDataFrame([(u, w, start + dt.timedelta(days=d, hours=5), o, g) for u, w, d, o, g in part], schema)
            df.coalesce(1).write.mode("append").parquet(source)
            seen = review_stream(spark.readStream.schema(schema).parquet(source))
            q = seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = spark.read.parquet(out)
    last = told.where("kind = 'answer'").groupBy("user", "word").agg(F.max_by(F.struct("box", "due", "mastered", "begun"), F.col("day")).alias("s")).select("user", "word", "s.*")
    want = _plain(rows)
    assert _state(last) == want
    reminded = {(r.user, r.word, r.due) for r in told.where("kind = 'due'").collect()}
    open_ = {(u, w, due) for (u, w), (_, due, done, _) in want.items() if due <= 38 and not done}
    assert open_ and open_ <= reminded and all(d < 40 for _, _, d in reminded)
