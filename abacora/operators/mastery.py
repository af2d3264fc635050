"""Mastery analytics: attempts, mistakes, trends, progress and history, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_true(c: Column) -> Column:
    return F.count_if(c)


def score_attempts(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Per attempt with questions, total, correct and score in percent."""
    marked = answers.groupBy("attempt_id").agg(F.count("*").alias("total"), count_true(F.col("is_correct")).alias("correct"))
    return attempts.select("attempt_id", "user_id", "created_at").join(marked, "attempt_id").withColumn("score", F.round(100.0 * F.col("correct") / F.col("total"), 6))


def mistakes(attempts: DataFrame, answers: DataFrame, users: Column | None = None) -> DataFrame:
    """Wrong answers with the attempt they belong to, of all or some users."""
    wrong = answers.where(~F.col("is_correct"))
    return (attempts if users is None else attempts.where(users)).join(wrong, "attempt_id")


def mistakes_by(rows: DataFrame, *keys: str) -> DataFrame:
    """A1, A2, A3: mistakes counted by topic, level or both."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_mistakes"))


def weakest(rows: DataFrame, top: int = 5) -> DataFrame:
    """A4: the topics with most mistakes; ties by topic."""
    return mistakes_by(rows, "topic_id").orderBy(F.desc("n_mistakes"), "topic_id").limit(top)


def ranked_within(counts: DataFrame, group: str, item: str, count: str, top: int) -> DataFrame:
    """The `top` items of each group by count, ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc(count), item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def score_trend(scores: DataFrame) -> DataFrame:
    """A5: each user's scores in order of time (ties by attempt), as one list."""
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "attempt_id", "score")))
    return scores.groupBy("user_id").agg(F.transform(ordered, lambda x: x["score"]).alias("trend"))


def user_counts(attempts: DataFrame, kind: str = "diagnostic") -> DataFrame:
    """Attempts, attempts of one kind, and the latest attempt id of each user."""
    return attempts.groupBy("user_id").agg(F.count("*").alias("n_attempts"), count_true(F.col("quiz_kind") == kind).alias("n_kind"), F.coalesce(F.max("attempt_id"), F.lit(0)).alias("latest_attempt_id"))


def topic_progress(history: DataFrame, threshold: float = 0.8, base: int = 3, steps: tuple[int, ...] = (4, 5)) -> DataFrame:
    """Per user and topic, the accuracy of the latest attempt and the next level.

    A step is reached only if both of the last two attempts pass the threshold overall and on rows at the level below it.
    """
    w = Window.partitionBy("user_id", "topic_id").orderBy(F.desc("attempt_id"))
    last = history.withColumn("back", F.dense_rank().over(w)).where("back <= 2")
    right = F.col("is_correct").cast("double")
    per = [F.avg(F.when(F.col("level") >= s - 1, right)).alias(f"at_{s}") for s in steps]
    attempt = last.groupBy("user_id", "topic_id", "attempt_id", "back").agg(F.avg(right).alias("accuracy"), *per)
    reached = [(F.bool_and((F.col("accuracy") >= threshold) & F.coalesce(F.col(f"at_{s}") >= threshold, F.lit(False))) & (F.count("*") == 2)).alias(f"ok_{s}") for s in steps]
    both = attempt.groupBy("user_id", "topic_id").agg(F.max(F.when(F.col("back") == 1, F.col("accuracy"))).alias("latest"), *reached)
    level = F.lit(base)
    for s in steps:
        level = F.when(F.col(f"ok_{s}"), s).otherwise(level)
    return both.select("user_id", "topic_id", F.round("latest", 6).alias("latest_accuracy"), level.alias("next_level"))


def last_per_topic(history: DataFrame, keep: int = 50) -> DataFrame:
    """The newest `keep` answers of each topic (attempt, then position, descending)."""
    w = Window.partitionBy("topic_id").orderBy(F.desc("attempt_id"), F.desc("question_index"))
    return history.withColumn("topic_position", F.row_number().over(w)).where(F.col("topic_position") <= keep)


def attempt_numbers(history: DataFrame) -> DataFrame:
    """The number of an attempt among its user's attempts that have questions."""
    return history.select("user_id", "attempt_id").distinct().withColumn("attempt_number", F.row_number().over(Window.partitionBy("user_id").orderBy("attempt_id")))


def history_listing(attempts: DataFrame) -> DataFrame:
    """Attempts, newest first, numbered from the total down."""
    by_user = Window.partitionBy("user_id")
    place = F.row_number().over(by_user.orderBy(F.desc("created_at"), F.desc("attempt_id")))
    return attempts.withColumn("number", F.count("*").over(by_user) - place + 1).select("user_id", "attempt_id", "number")


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """The latest attempt of each user (time, then id)."""
    latest = F.max_by("attempt_id", F.struct("created_at", "attempt_id")).alias("attempt_id")
    return attempts.groupBy("user_id").agg(latest)


def averages(scores: DataFrame) -> DataFrame:
    """Mean and last score of each user."""
    last = F.max_by("score", F.struct("created_at", "attempt_id"))
    return scores.groupBy("user_id").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.round(last, 4).alias("last_score"))


def recommend_core(attempts: DataFrame, answers: DataFrame, top: int = 5, levels: int = 3) -> DataFrame:
    """The heart of a recommendation: weakest topics with their most missed levels, from mistakes counted once."""
    by_level = mistakes_by(mistakes(attempts, answers), "topic_id", "level")
    totals = by_level.groupBy("topic_id").agg(F.sum("n_mistakes").alias("topic_mistakes"))
    best = totals.orderBy(F.desc("topic_mistakes"), "topic_id").limit(top)
    ranked = ranked_within(by_level, "topic_id", "level", "n_mistakes", levels)
    return ranked.join(best, "topic_id").select("topic_id", "topic_mistakes", "level", "n_mistakes", "rank")
