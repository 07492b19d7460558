"""Progress of learners synced from many devices into a versioned table, as a stream.

A request says what a device has and what it had when it last saw the cloud's state. What
it added since is added, what it removed is removed, and counts of its log grow by what
it counted; without a last state the two are united. A batch writes the users that it
changes as a version of its own, named by the batch, from the versions before it: a
batch that runs again writes the same again. Every few batches a version of all users
follows, from which readers start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Requests: learned and log are the device's own, base_* its last state of the cloud, null before the first sync.
REQUEST = "user_id string, seq long, learned array<string>, log map<string,int>, base_learned array<string>, base_log map<string,int>"
STATE = "user_id string, learned array<string>, log map<string,int>"
#: Batches between versions of all users.
WHOLE_EVERY = 50


def _merged(acc: Column, r: Column) -> Column:
    """The cloud's state after a request."""
    none, zero = F.array().cast("array<string>"), F.lit(0)
    mine, base = F.coalesce(r["learned"], none), F.coalesce(r["base_learned"], none)
    learned = F.array_except(F.array_union(acc["learned"], F.array_except(mine, base)), F.array_except(base, mine))
    empty = F.create_map().cast("map<string,int>")
    grown = F.map_zip_with(F.coalesce(r["log"], empty), F.coalesce(r["base_log"], empty), lambda k, a, b: F.coalesce(a, zero) - F.coalesce(b, zero))
    log = F.map_zip_with(acc["log"], grown, lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))
    return F.struct(F.array_sort(learned).alias("learned"), log.alias("log"))


def apply_requests(state: DataFrame, requests: DataFrame) -> DataFrame:
    """State (user_id, learned, log) of the users with requests, after these in the order of seq; a user's requests are one row's fold."""
    mine = F.array_sort(F.collect_list(F.struct("seq", "learned", "base_learned", F.map_entries("log").alias("log"), F.map_entries("base_log").alias("base_log"))))
    each = requests.where("user_id IS NOT NULL").groupBy("user_id").agg(mine.alias("_r"))
    # Maps can't be sorted, so they go as entries.
    maps = F.transform("_r", lambda x: F.struct(x["learned"].alias("learned"), x["base_learned"].alias("base_learned"), F.map_from_entries(x["log"]).alias("log"), F.map_from_entries(x["base_log"]).alias("base_log")))
    first = F.struct(F.coalesce("learned", F.array().cast("array<string>")).alias("learned"), F.coalesce("log", F.create_map().cast("map<string,int>")).alias("log"))
    done = each.join(state, "user_id", "left").select("user_id", F.aggregate(maps, first, _merged).alias("_s"))
    return done.select("user_id", "_s.learned", "_s.log")


def progress_at(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(user_id, learned, log) of every user by the versions of batches under `before`, or by all."""
    try:
        all_ = spark.read.schema(f"{STATE}, kind string, batch long").parquet(path)
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STATE)
    seen = all_ if before is None else all_.where(F.col("batch") < before)
    whole = seen.where("kind = 'whole'").agg(F.max("batch")).first()[0]  # one number
    if whole is not None:
        seen = seen.where((F.col("batch") > whole) | ((F.col("kind") == "whole") & (F.col("batch") == whole)))
    else:
        seen = seen.where("kind = 'changed'")
    return seen.groupBy("user_id").agg(F.max_by(F.struct("learned", "log"), "batch").alias("s")).select("user_id", "s.learned", "s.log")


def sync_batch(requests: DataFrame, batch: int, path: str, whole_every: int = WHOLE_EVERY) -> None:
    """Writes the version of a batch; the same batch again replaces it."""
    spark = requests.sparkSession
    before = progress_at(spark, path, batch)
    apply_requests(before, requests).write.mode("overwrite").parquet(f"{path}/kind=changed/batch={batch}")
    if whole_every and batch % whole_every == whole_every - 1:
        # Read from before this batch's own whole version, should it run again.
        now = spark.read.schema(STATE).parquet(f"{path}/kind=changed/batch={batch}")
        rest = before.join(now.select("user_id"), "user_id", "left_anti")
        rest.unionByName(now).write.mode("overwrite").parquet(f"{path}/kind=whole/batch={batch}")


def sync_stream(requests: DataFrame, path: str, checkpoint: str, whole_every: int = WHOLE_EVERY) -> DataStreamWriter:
    """A writer of a stream of requests into the table at path; start() it, with a trigger of choice."""
    run: Callable[[DataFrame, int], None] = lambda df, batch: sync_batch(df, batch, path, whole_every)
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
