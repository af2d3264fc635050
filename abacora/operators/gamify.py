"""Streaks, comebacks, badges and daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Badge and the condition on a user's figures that earns it. Fixed values.
BADGES = (
    ("first_spark", "n >= 1"),
    ("steady_pulse", "n >= 5"),
    ("deep_network", "n >= 15"),
    ("synaptic_storm", "n >= 40"),
    ("perfect_loop", "perfect >= 1"),
    ("sharp_mind", "high >= 5"),
    ("streak_3", "best_streak >= 3"),
    ("streak_7", "best_streak >= 7"),
    ("wide_reach", "days >= 10"),
    ("century_mind", "total_correct >= 100"),
    ("double_century", "total_correct >= 300"),
    ("comeback", "comeback"),
    ("marathon_focus", "marathon"),
)


def daily(activity: DataFrame) -> DataFrame:
    """How much each user did on each day."""
    return activity.groupBy("user_id", "day").agg(F.count("*").alias("n"))


def islands(activity: DataFrame) -> DataFrame:
    """Runs of consecutive days with activity: user_id, first_day, last_day, days."""
    days = activity.select("user_id", "day").distinct()
    anchor = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("anchor", anchor).groupBy("user_id", "anchor").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("anchor")


def best_streak(activity: DataFrame) -> DataFrame:
    """The longest run of days of each user."""
    return islands(activity).groupBy("user_id").agg(F.max("days").alias("best_streak"))


def current_streak(activity: DataFrame, as_of: str) -> DataFrame:
    """The days of the run that reaches the given day; 0 if that day has no activity."""
    day = F.lit(as_of).cast("date")
    reaches = (F.col("first_day") <= day) & (F.col("last_day") >= day)
    length = F.when(reaches, F.date_diff(day, F.col("first_day")) + 1).otherwise(0)
    return islands(activity).groupBy("user_id").agg(F.max(length).cast("long").alias("current_streak"))


def comebacks(scores: DataFrame, gain: float = 20.0) -> DataFrame:
    """Whether some score of a user is at least `gain` above the one before it."""
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("created_at", "attempt_id"))
    return scores.withColumn("before", before).groupBy("user_id").agg(F.coalesce(F.bool_or(F.col("score") - F.col("before") >= gain), F.lit(False)).alias("comeback"))


def statistics(scores: DataFrame) -> DataFrame:
    """A10: totals of each user's attempts; a perfect one has at least 99.5 percent."""
    perfect = F.col("score") >= 99.5
    return scores.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("correct").alias("total_correct"), F.count_if(perfect).alias("perfect"), F.count_if(F.col("score") >= 90).alias("high"),
        F.bool_or(perfect & (F.col("total") >= 20)).alias("marathon"), F.countDistinct(F.to_date("created_at")).alias("days"),
    )


def badges(scores: DataFrame) -> DataFrame:
    """One row for every user and badge, earned or not."""
    activity = scores.select("user_id", F.to_date("created_at").alias("day"))
    figures = statistics(scores).join(best_streak(activity), "user_id").join(comebacks(scores), "user_id")
    rules = F.array(*(F.struct(F.lit(b).alias("badge"), F.expr(rule).alias("earned")) for b, rule in BADGES))
    return figures.select("user_id", F.inline(rules))
