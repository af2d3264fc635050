"""Connected components by alternating large-star and small-star steps; no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few, materialise


def _digest(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) -> (node, root): the smallest node of each component, for all nodes that have an edge.

    Minima are taken by partial aggregation, written, and joined back: no join shares its stage with an aggregate, so the rows
    of a node with very many neighbours can be split (or the minima sent to all tasks, where Spark finds them small).
    Each round is written to the shared folder, in files that its number of rows fills, and the one before it deleted. A round only ever moves edges to smaller
    nodes, so the loop ends by itself: when a round changes nothing. An empty table of edges gives no rows.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(edges)
    while True:
        n = 2 * seen[0]  # rows of both directions; none of what follows has more
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(in_few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), n), "low")
        large = materialise(in_few(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), n), "large")
        least = materialise(in_few(large.groupBy("a").agg(F.min("b").alias("m")), n), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(in_few(small.union(least.select("a", F.col("m").alias("b"))).distinct(), n), "edges")
        for done in (edges, low, large, least):
            discard(done)
        now, edges = _digest(after), after
        if now == seen:
            return in_few(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), n)
        seen = now
