"""What the readers of a library ask for: search, scope, what to learn next, own rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def search(words: DataFrame, text: str, columns: list[str], rank: str, most: int = 6) -> DataFrame:
    """The `most` rows, largest rank first and then by the columns, of which a column holds the text; an empty text finds none."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.contains(F.col(c), F.lit(text)), F.lit(False))
    return words.where(hit & F.lit(text != "")).orderBy(F.desc(rank), *columns).limit(most)


def in_scope(songs: DataFrame, bands: list[str] | None = None, albums: list[str] | None = None, ids: list | None = None) -> DataFrame:
    """Songs of the bands, of the albums and of the ids, as far as they are given."""
    for column, allowed in (("band", bands), ("album", albums), ("id", ids)):
        if allowed is not None:
            songs = songs.where(F.col(column).isin(allowed))
    return songs


def scope_words(occurrences: DataFrame, songs: DataFrame, few: int = 5) -> DataFrame:
    """(w, songs, n) over occurrences (w, song, rare, n) in the songs; rare words only where there are fewer than `few` songs."""
    chosen = songs.select(F.col("id").alias("song")).distinct()
    small = chosen.agg((F.count("*") < few).alias("small"))  # one row
    return occurrences.join(chosen, "song").crossJoin(F.broadcast(small)).where(~F.col("rare") | F.col("small")).groupBy("w").agg(F.count("*").alias("songs"), F.sum("n").alias("n"))


def next_songs(tokens: DataFrame, known: DataFrame, song: str = "song", word: str = "w") -> DataFrame:
    """(song, known, total, pct): songs by the share of tokens whose word is known, the largest first."""
    mark = known.select(word).distinct().withColumn("_known", F.lit(1))
    per_word = tokens.groupBy(song, word).agg(F.count("*").alias("n"))
    marked = per_word.join(mark, word, "left")
    return marked.groupBy(song).agg(F.sum(F.when(F.col("_known") == 1, F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("total")).withColumn("pct", F.round(100 * F.col("known") / F.col("total"), 1)).orderBy(F.desc("pct"), song)


def own_rows(progress: DataFrame, user: Column | None = None) -> DataFrame:
    """Rows whose user_id is the session's user: a view of this is what readers get instead of the table."""
    return progress.where(F.col("user_id") == (F.current_user() if user is None else user))


def create_own_view(spark: SparkSession, table: str, view: str) -> None:
    """A view of a table's rows of the current user; making it again changes nothing."""
    own_rows(spark.table(table)).createOrReplaceTempView(view)


def upsert_own(current: DataFrame, new: DataFrame, user: Column | None = None) -> DataFrame:
    """current with new rows in place of those of their user_id; a new row of another user fails the query."""
    who = F.current_user() if user is None else user
    mine = F.when(F.col("user_id") == who, F.col("user_id")).otherwise(F.raise_error(F.concat(F.lit("not the user's own row: "), F.coalesce(F.col("user_id"), F.lit("null")))))
    checked = new.withColumn("user_id", mine)
    return current.join(checked.select("user_id"), "user_id", "left_anti").unionByName(checked)
