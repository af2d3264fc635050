"""Similar sets and stems: their pairs, classes and numbers of links, and the ordered choice of one of each similar pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import near
from ..functions.similarity import SIMILAR
from ..functions.text import normalise
from ..sources.store import discard, written

#: Rows of a concept in one block of similar_pairs; pairs that are work enough for a task.
BLOCK, WORK = 4096, 250_000


def _prefix_pairs(rows: DataFrame, share: float) -> DataFrame:
    """(concept, id, tokens) -> concept, a, b: pairs that can share `share` of the tokens of the larger one.

    Of every token set only its rarest ones meet others': as many as must contain a shared one if the overlap is large.
    A column n says how large a set is of which tokens holds only those that others have too.
    """
    n = F.col("n") if "n" in rows.columns else F.size("tokens")
    each = rows.select("concept", "id", n.alias("n"), F.size("tokens").alias("held"), F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("concept", "id").orderBy("often", "token"))
    rare = each.join(often, "token").withColumn("rank", rank).where(F.col("rank") <= F.col("held") - F.ceil(share * F.col("n") - 1e-9) + 1)
    one, other = (rare.select("concept", "token", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = one.join(other, ["concept", "token"]).where("a < b").where(F.least("na", "nb") >= share * F.greatest("na", "nb"))
    return met.select("concept", "a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> id, low: for each id in a link, the smallest one that links lead to. In rounds that each halve what is left
    of long chains; each is written, so lineage stays short."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label, changed = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("low")), "labels"), True
    while changed:
        near = both.join(label, both["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("low").alias("near"))
        met = label.join(near, "id").select("id", F.least("low", "near").alias("next"), F.col("low").alias("was"))
        far = label.select(F.col("id").alias("next"), F.col("low").alias("far"))
        after = written(met.join(far, "next").select("id", F.least("next", "far").alias("low"), "was"), "labels")
        changed = bool(after.where("low <> was").take(1))
        discard(label)
        label = after.select("id", "low")
    return label


def set_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(concept, id, tokens; distinct ones) -> id, class_id, n_links, closest.

    Two sets of one concept are linked if they share `threshold` of all their tokens. n_links counts a set's links, closest is
    the largest shared part among them, class_id the smallest id that links lead to.

    Tokens that only one set of the concept has are never shared, so sets of one size with the same other tokens (a group)
    have the same links to all others, and one shared part among themselves. Groups are compared, their sets only counted.
    """
    sets = written(rows.select("concept", "id", F.size("tokens").alias("n"), "tokens"), "sets")
    each = sets.select("concept", "id", "n", F.explode("tokens").alias("token"))
    known = each.groupBy("concept", "token").agg(F.count("*").alias("often")).where("often > 1").select("concept", "token")
    core = each.join(known, ["concept", "token"]).groupBy("concept", "id", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    key = F.sha2(F.to_json(F.struct("tokens")), 256)
    core = written(core.select("concept", "id", "n", "tokens", key.alias("key")), "cores")
    group = core.groupBy("concept", "n", "key").agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("tokens").alias("tokens"))
    group = written(group, "groups")
    met = _prefix_pairs(group.select("concept", "id", "n", "tokens"), threshold).select("a", "b")
    one, other = (group.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("many").alias(f"many{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    part = lambda shared, sizes: shared / (sizes - shared)
    scored = met.join(one, "a").join(other, "b").withColumn("j", part(F.size(F.array_intersect("ta", "tb")), F.col("na") + F.col("nb")))
    across = written(scored.where(F.col("j") >= threshold).select("a", "b", "manya", "manyb", "j"), "links")
    inside = group.where("many > 1").select("id", (F.col("many") - 1).alias("links"), part(F.size("tokens"), 2 * F.col("n")).alias("j")).where(F.col("j") >= threshold)
    sides = across.select(F.col("a").alias("id"), F.col("manyb").alias("links"), "j").union(across.select(F.col("b").alias("id"), F.col("manya").alias("links"), "j"))
    counted = sides.union(inside).groupBy("id").agg(F.sum("links").alias("n_links"), F.max("j").alias("closest"))
    low = components(across)
    result = group.join(counted, "id").join(low, "id", "left").select("concept", "n", "key", F.coalesce("low", "id").alias("low"), "n_links", "closest")
    own = core.select("concept", "n", "key", "id").join(result, ["concept", "n", "key"])
    found = sets.select("id").join(own.select("id", "low", "n_links", "closest"), "id", "left")
    return found.select("id", F.coalesce("low", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "closest")


def _near_rows(threshold: float):
    """A tile's rows (side, id, text) -> its similar pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        side, ids = rows.column("side").to_numpy(), rows.column("id").combine_chunks()
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        texts = np.array(rows.column("text").to_pylist(), dtype=object)
        at = [np.nonzero(side == k)[0] for k in (0, 1)]
        both = len(at[1]) > 0
        found = near((texts[at[0]].tolist(), texts[at[1]].tolist() if both else None), (rank[at[0]], rank[at[1]] if both else None), threshold)
        for flipped, i, j, similarity, too in found:
            a, b = (at[1][i], at[0][j]) if flipped else (at[0][i], at[1 if both else 0][j])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(similarity), pa.array(too)], ["a", "b", "similarity", "too_similar"])

    return work


def similar_pairs(stems: DataFrame, threshold: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(concept, id, text) -> a, b, similarity, too_similar, for pairs of one concept at or above the threshold.

    The rows of a concept are dealt to blocks by their ids, and every two blocks (a tile) are compared in one go: all pairs of
    their different texts are bounded in arrays, and those that can reach the threshold are aligned in arrays.
    """
    rows = stems.select("concept", "id", "text").where(F.col("concept").isNotNull() & F.col("id").isNotNull() & (normalise(F.col("text")) != ""))
    blocks = rows.groupBy("concept").agg(F.count("*").alias("n")).select("concept", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    work = blocks.agg(F.sum(F.col("n") * F.col("n") / 2).alias("pairs"), F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2).alias("tiles")).first()
    parts = int(min((work["pairs"] or 0) // WORK + 1, work["tiles"] or 1, 10_000))  # by work, since the rows of a tile are few bytes
    dealt = rows.join(blocks.select("concept", "blocks"), "concept").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = met.select("concept", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "text")
    key = stems.schema["id"].dataType
    schema = T.StructType([T.StructField("a", key), T.StructField("b", key), T.StructField("similarity", T.DoubleType()), T.StructField("too_similar", T.BooleanType())])
    return tiles.repartition(parts, "concept", "low", "high").groupBy("concept", "low", "high").applyInArrow(_near_rows(threshold), schema)


def first_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that an ordered pass keeps: an id goes if one before it that was kept is linked to it (edges a < b).

    In rounds: an id without open links to smaller ones is kept, what it is linked to goes. Rounds are as many as the
    longest chain of links that decide each other; each is written, so lineage stays short.
    """
    open_, gone = written(edges.select("a", "b").distinct(), "links"), None
    while open_.take(1):
        waits = open_.select(F.col("b").alias("a")).distinct()
        kept = open_.select("a").distinct().join(waits, "a", "left_anti")
        lost = written(open_.join(kept, "a", "left_semi").select("b").distinct(), "lost")
        gone = lost if gone is None else gone.union(lost)
        after = open_.join(kept, "a", "left_anti").join(lost, "b", "left_anti").join(lost.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
        before, open_ = open_, written(after, "links")
        discard(before)
    return nodes if gone is None else nodes.join(gone.select(F.col("b").alias("id")), "id", "left_anti")


def keep_first_stems(stems: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """D1 over frames: (concept, id, text) in the order of id -> the ids kept: a stem goes if its normal form was kept before
    anywhere, or a too similar one in its concept; empty stems stay."""
    form = stems.select("id", normalise(F.col("text")).alias("form")).where("form <> ''")
    alike = form.join(form.groupBy("form").agg(F.min("id").alias("a")), "form").where("a < id").select("a", F.col("id").alias("b"))
    near = similar_pairs(stems, threshold).where("too_similar").select("a", "b")
    return first_of(stems.select("id"), near.union(alike).distinct())
