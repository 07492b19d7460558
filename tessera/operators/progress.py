"""Spaced repetition: the state after each learner's answers, and what a day asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days to the next review by box; after the last one a word is mastered. Fixed values.
INTERVALS = (1, 2, 4, 7, 15)
#: New words a day. Fixed value.
NEW_WORDS = 15
#: Grades that change a word's state: of reviews, and a wrong answer in a quiz.
GRADES = ("remembered", "vague", "forgot", "wrong")


def review_state(answers: DataFrame) -> DataFrame:
    """(user, word, box, due, mastered, begun) after answers (user, word, day, ord, grade).

    Grade "remembered" moves a word one box on, "vague" leaves it, "forgot" puts it in the
    first; the next review is due its box's interval after the day. A remembered word of
    the last box is mastered until it is forgotten. "wrong", of a quiz, leaves the box
    and is due on its own day; other grades and null users, words and days count for
    nothing. begun is the first day. The assumptions follow prose only.

    The box counts what was remembered since the word was last forgotten, so counts that
    are summed before they are shuffled do, and no learner's answers are one row. Answers
    that repeat count each; those of one (day, ord) go by grade.
    """
    kept = answers.where(F.col("grade").isin(*GRADES) & F.col("user").isNotNull() & F.col("word").isNotNull() & F.col("day").isNotNull())
    kept = kept.select("user", "word", F.struct("day", "ord", "grade").alias("_at"))
    whole = kept.groupBy("user", "word").agg(F.max("_at").alias("_last"), F.min("_at.day").cast("int").alias("begun"), F.max(F.when(F.col("_at.grade") == "forgot", F.col("_at"))).alias("_reset"))
    reset = whole.where("_reset IS NOT NULL").select("user", "word", "_reset")
    up = kept.where("_at.grade = 'remembered'").join(reset, ["user", "word"], "left").where("_reset IS NULL OR _at > _reset").groupBy("user", "word").agg(F.count("*").alias("_up"))
    ups = F.coalesce("_up", F.lit(0))
    box = F.least(ups, F.lit(len(INTERVALS) - 1)).cast("int")
    wait = F.when(F.col("_last.grade") == "wrong", 0).otherwise(F.get(F.array(*map(F.lit, INTERVALS)), box))
    return whole.join(up, ["user", "word"], "left").select("user", "word", box.alias("box"), (F.col("_last.day") + wait).cast("int").alias("due"), (ups >= len(INTERVALS)).alias("mastered"), "begun")


def day_queue(state: DataFrame, words: DataFrame, day: int, limit: int = NEW_WORDS) -> DataFrame:
    """(user, word, new): what each user of state has to review on a day, and the new words that it still offers.

    Words that are due by then and not mastered are reviewed. Of words (word, rank), ranks
    from 1 without gaps, the first ones that a user has not begun are new, `limit` of them
    less those begun on that day. The j-th word not begun is found from how many begun
    ones precede it, so users aren't multiplied by words. State words that aren't in
    words have no rank and only are reviewed.
    """
    due = state.where(~F.col("mastered") & (F.col("due") <= day)).select("user", "word", F.lit(False).alias("new"))
    room = state.groupBy("user").agg(F.greatest(F.lit(limit) - F.sum(F.when(F.col("begun") == day, 1).otherwise(0)), F.lit(0)).alias("_room"))
    w = Window.partitionBy("user").orderBy("rank")
    # Words not begun that precede a begun one; those with `limit` of them or more say nothing.
    free = state.join(words, "word").select("user", (F.col("rank") - F.row_number().over(w)).alias("_free")).where(F.col("_free") < limit)
    begun = free.groupBy("user", "_free").agg(F.count("*").alias("n")).groupBy("user").agg(F.collect_list(F.struct("_free", "n")).alias("_begun"))  # at most `limit`
    each = room.where("_room > 0").join(begun, "user", "left").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_room").cast("int"))))
    before = F.aggregate(F.coalesce("_begun", F.array().cast("array<struct<_free:bigint,n:bigint>>")), F.lit(0).cast("long"), lambda a, x: a + F.when(x["_free"] < F.col("_j"), x["n"]).otherwise(F.lit(0)))
    new = each.select("user", (F.col("_j") + before).alias("rank")).join(words.select("word", F.col("rank").cast("long").alias("rank")), "rank")
    return due.unionByName(new.select("user", "word", F.lit(True).alias("new")))
