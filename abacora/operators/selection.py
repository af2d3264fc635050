"""Choosing items: unseen ones by anti-joins, seeded samples, weighted draws, pool upserts and gap reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unseen(items: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Items that do not occur in `seen`, by one or more keys."""
    return items.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def unseen_sources(items: DataFrame, prior: DataFrame, key: str = "source_id") -> DataFrame:
    """Items without a source, or whose source was not used before; nulls on either side exclude nothing."""
    return items.join(prior.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def excluding(items: DataFrame, **lists: Iterable) -> DataFrame:
    """Items outside literal lists of values, given by column; null values of a column pass."""
    for column, values in lists.items():
        values = list(values)
        if values:
            items = items.where(F.col(column).isNull() | ~F.col(column).isin(values))
    return items


def hash_sample(items: DataFrame, key: str, seed: str, n: int, group: str | None = None) -> DataFrame:
    """The n items (of each group) of lowest sha256(seed|key); the same for the same seed."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    if group is None:
        return items.withColumn("order_hash", order).orderBy("order_hash", key).limit(n).drop("order_hash")
    w = Window.partitionBy(group).orderBy(order, key)
    return items.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def weighted_sample(items: DataFrame, key: str, weight: str, seed: str, n: int) -> DataFrame:
    """O6 without penalty: an exponential race, -ln(u) / weight with u from a hash of seed and key."""
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") + 1.0) / 4294967297.0
    race = F.round(-F.log(u) / F.col(weight), 6)
    return items.withColumn("race", race).orderBy("race", key).limit(n)


def upsert_pending(wanted: DataFrame, stored: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows to write: those whose key is not stored with the same payload hash."""
    return wanted.join(stored.select(key, payload).distinct(), [key, payload], "left_anti")


def pool_upsert(existing: DataFrame, incoming: DataFrame, key: str, flags: tuple[str, ...]) -> DataFrame:
    """Insert if absent by key; on a hit the existing row stays and its flags are or-ed with the new ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c != key and c not in flags]
    first = F.min_by(F.struct(*rest), F.struct("_new", *rest)).alias("_kept")
    return both.groupBy(key).agg(first, *(F.bool_or(f).alias(f) for f in flags)).select(key, *(F.col(f"_kept.{c}").alias(c) for c in rest), *flags)


def bucket_gaps(items: DataFrame, topics: DataFrame, levels: DataFrame, wanted: int = 21) -> DataFrame:
    """Every topic and level with how many items it has, and whether that is too few."""
    have = items.groupBy("topic_id", "level").agg(F.count("*").alias("have"))
    grid = topics.select("topic_id").distinct().crossJoin(F.broadcast(levels.select("level").distinct()))  # levels are a fixed short list
    n = F.coalesce("have", F.lit(0))
    return grid.join(have, ["topic_id", "level"], "left").select("topic_id", "level", n.alias("n_items"), (n < wanted).alias("short"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """D1 (exact part), D2, D6, T1: the first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def shares(rows: DataFrame, group: str, order: str, whole: int = 100) -> DataFrame:
    """`whole` dealt over a group's rows as evenly as integers allow, the first rows getting one more."""
    by = Window.partitionBy(group)
    n, at = F.count("*").over(by), F.row_number().over(by.orderBy(order))
    return rows.select(group, order, (F.floor(F.lit(whole) / n) + F.when(at <= F.lit(whole) % n, 1).otherwise(0)).alias("share"))


def proportional(rows: DataFrame, group: str, order: str, weight: str, top: int = 8, whole: int = 100) -> DataFrame:
    """Of each group its `top` rows by weight with shares in proportion, the first taking what rounding leaves."""
    by = Window.partitionBy(group)
    best = rows.withColumn("at", F.row_number().over(by.orderBy(F.desc(weight), order))).where(F.col("at") <= top)
    part = best.withColumn("share", F.floor(F.lit(whole) * F.col(weight) / F.sum(weight).over(by)))
    return part.withColumn("share", F.when(F.col("at") == 1, F.col("share") + whole - F.sum("share").over(by)).otherwise(F.col("share"))).select(group, order, "at", "share")
