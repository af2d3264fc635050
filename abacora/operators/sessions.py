"""Sessions and events: first of a key, rates, lockouts, staleness, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import first_by


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def first_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key, by time then id."""
    return first_by(events, keys, ["ts", "event_id"])


def over_rate(events: DataFrame, limit: int, length: str) -> DataFrame:
    """Users and tumbling windows with more than `limit` events."""
    w = F.window(F.col("ts").cast("timestamp"), length)
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


def lockouts(events: DataFrame, failure: str, success: str, limit: int = 5) -> DataFrame:
    """Failures since the last success, at each event; locked from `limit` on."""
    order = ["ts", "event_id"]
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    epochs = events.withColumn("epoch", F.sum(F.when(F.col("event_type") == success, 1).otherwise(0)).over(so_far("user_id")))
    failures = F.sum(F.when(F.col("event_type") == failure, 1).otherwise(0)).over(so_far("user_id", "epoch"))
    return epochs.withColumn("failures", failures).withColumn("locked", F.col("failures") >= limit)


def last_status(events: DataFrame, now: str, stale_after: int) -> DataFrame:
    """T5: the last status of each user, its age in seconds, and whether it is stale."""
    age = seconds(F.lit(now).cast("timestamp")) - F.max(seconds(F.col("ts")))
    found = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), age.alias("age"))
    return found.withColumn("stale", F.col("age") > stale_after)


def within_ttl(rows: DataFrame, now: str, ttl: int) -> DataFrame:
    """Rows not older than ttl seconds."""
    return rows.where((seconds(F.lit(now).cast("timestamp")) - seconds(F.col("ts"))).between(0, ttl))


def completeness(turns: DataFrame, batch: int) -> DataFrame:
    """T4: whether a session's turns are all there, and how many batches they make."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.countDistinct("turn") == F.max("turn") + 1).alias("complete"), F.ceil(F.count("*") / batch).alias("batches"))


def still_to_do(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a checkpoint has not finished yet."""
    return wanted.join(done.select(key), key, "left_anti")


def submitted(questions: DataFrame, expiry: DataFrame) -> DataFrame:
    """Scores with the timer's rule: after expiry a submission with gaps is accepted, and unanswered questions that
    were loaded count as wrong."""
    made = questions.groupBy("attempt_id").agg(F.count("*").alias("loaded"), F.count_if("answered").alias("answered"), F.count_if(F.col("answered") & F.col("right")).alias("correct"), F.max("at").alias("last"))
    late = F.col("last") > F.col("expires_at")
    return made.join(expiry, "attempt_id").select(
        "attempt_id", "loaded", "answered", "correct", (F.col("loaded") - F.col("correct")).alias("incorrect"), late.alias("timed_out"), ((F.col("answered") == F.col("loaded")) | late).alias("accepted")
    )
