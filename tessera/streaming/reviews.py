"""Reviews as a stream: the state of each learner's words, and a row when one is due."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.progress import GRADES, INTERVALS

_DAY = 86_400_000
OUT = "user string, word string, kind string, day int, box int, due int, mastered boolean, begun int"


class _Reviews(StatefulProcessor):
    """One word of one learner: its box, with a timer at the day when it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("review", "ups int, due int, begun int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.kept.get() if self.kept.exists() else None
        ups, due, begun = old or (0, None, None)
        for day, _, grade in sorted((r.day, r.ord, r.grade) for r in rows):
            ups = 0 if grade == "forgot" else min(ups + (grade == "remembered"), len(INTERVALS))
            due = day if grade == "wrong" else day + INTERVALS[min(ups, len(INTERVALS) - 1)]
            begun = day if begun is None else min(begun, day)
        if old is not None and old[1] * _DAY in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[1] * _DAY)
        self.kept.update((ups, due, begun))
        if ups < len(INTERVALS):
            self.handle.registerTimer(due * _DAY)
        yield self._row(key, "answer", day, ups, due, begun)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ups, due, begun = self.kept.get()
        yield self._row(key, "due", due, ups, due, begun)

    @staticmethod
    def _row(key: tuple, kind: str, day: int, ups: int, due: int, begun: int) -> Row:
        return Row(user=key[0], word=key[1], kind=kind, day=day, box=min(ups, len(INTERVALS) - 1), due=due, mastered=ups >= len(INTERVALS), begun=begun)

    def close(self) -> None:
        pass


def review_stream(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream (OUT) of a stream of answers (user, word, ts, ord, grade).

    A row of kind "answer" is a word's state after a batch, as review_state has it; one
    of kind "due" comes once the watermark, `late` behind the newest answer, has passed the
    start of the day when a word that isn't mastered is due. Answers of one batch go by
    day, ord and grade, and batches in their turn: what comes later than the watermark
    is dropped, what is late by less is taken as answered then. Null users, words and times and
    other grades count for nothing. State is kept for each word of each learner (RocksDB),
    so no learner is one task.
    """
    kept = answers.where(F.col("grade").isin(*GRADES) & F.col("user").isNotNull() & F.col("word").isNotNull() & F.col("ts").isNotNull())
    kept = kept.withWatermark("ts", late).select(F.col("user").cast("string").alias("user"), F.col("word").cast("string").alias("word"), F.unix_date(F.to_date("ts")).alias("day"), F.coalesce(F.col("ord").cast("long"), F.lit(0).cast("long")).alias("ord"), "grade", "ts")
    return kept.groupBy("user", "word").transformWithState(_Reviews(), OUT, "Append", "EventTime")
