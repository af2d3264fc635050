"""O1 with P1: inverted lists of vectors. Centroids are trained on a bounded sample, every vector lies in the list of its nearest
centroid, and a search reads a few lists of one grade and ranks their vectors exactly."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import exists, read_manifest, replace, write_manifest
from .retrieval import dense_scores, dot, top

#: Vectors that centroids are trained on, about: those whose key's hash is 0 modulo a divisor that follows from their number.
SAMPLE = 50_000
#: Lists of an index, at most; their centroids go to every task.
MOST_LISTS = 4096


def _unit(e) -> F.Column:
    norm = F.sqrt(dot(e, e))
    return F.when(norm > 0, F.transform(e, lambda x: x.cast("double") / norm)).otherwise(F.transform(e, lambda x: x.cast("double")))


def nearest_lists(queries: np.ndarray, centroids: np.ndarray, number: np.ndarray, probes: int) -> np.ndarray:
    """[queries, probes]: the lists whose centroids are nearest to each query's direction, best first."""
    norm = np.linalg.norm(queries, axis=1, keepdims=True)
    unit = queries / np.where(norm > 0, norm, 1)
    far = (centroids**2).sum(axis=1)[None, :] - 2 * unit @ centroids.T
    return number[np.argsort(far, axis=1, kind="stable")[:, :probes]]


class VectorLists:
    """An index in a folder: `lists` (partitioned by grade and list), `centroids`, and a manifest written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.about = read_manifest(spark, f"{path}/manifest.json")
        if not self.about:
            raise ValueError(f"no index in {path}")
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
        self.number = np.array([r["list"] for r in rows], np.int64)
        self.centroids = np.array([r["centroid"] for r in rows]).reshape(len(rows), -1)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, corpus: str = "", sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> VectorLists:
        """(doc_id, grade, embedding) -> the index of all vectors that are not null and of the commonest size.

        lists: how many; the root of the number of vectors where not given. The write is rebalanced by size, so a list that holds
        very many rows is written by several tasks.
        """
        spark = vectors.sparkSession
        fine = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
        size = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if size is None:
            raise ValueError("no vectors")
        rows = fine.where(F.size("embedding") == size["size"]).select("doc_id", "grade", F.col("embedding").alias("raw"), _unit(F.col("embedding")).alias("embedding"))
        k = min(lists or max(1, int(size["count"] ** 0.5)), MOST_LISTS, size["count"])
        write_manifest(spark, f"{path}/manifest.json", {})  # no index until all of it stands
        chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(size["count"] // sample + 1)) == 0).select(array_to_vector("embedding").alias("features"))
        model = KMeans(k=k, maxIter=rounds, seed=seed).fit(chosen)
        dealt = model.transform(rows.withColumn("features", array_to_vector("embedding"))).select("doc_id", "grade", F.col("raw").alias("embedding"), F.col("prediction").alias("list"))
        replace(dealt.hint("rebalance", "grade", "list"), f"{path}/lists", "grade", "list")
        made = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centroid array<double>")
        replace(made.coalesce(1), f"{path}/centroids")
        held = spark.read.parquet(f"{path}/lists").count()
        if held != size["count"]:
            raise RuntimeError(f"{held} of {size['count']} vectors stand in the lists")
        write_manifest(spark, f"{path}/manifest.json", {"lists": len(model.clusterCenters()), "size": size["size"], "vectors": held, "corpus": corpus})
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, corpus: str) -> VectorLists | None:
        """The index of this corpus version, if there is one."""
        found = read_manifest(spark, f"{path}/manifest.json") if exists(spark, f"{path}/manifest.json") else None
        return cls(spark, path) if found and found["corpus"] == corpus else None

    def nearest(self, queries: np.ndarray, probes: int) -> np.ndarray:
        return nearest_lists(queries, self.centroids, self.number, probes)

    def lists(self, grade, probed: list[int] | None = None) -> DataFrame:
        """The vectors of a grade in some lists; both are partitions, so nothing else is read."""
        rows = self.spark.read.parquet(f"{self.path}/lists").where(F.col("grade") == grade)
        return rows if probed is None else rows.where(F.col("list").isin(probed))

    def search(self, query: list[float], grade, k: int = 12, probes: int | None = None) -> DataFrame:
        """doc_id, score, rank of the k best of a grade; probes: how many lists are read, all where not given."""
        probed = None if probes is None else self.nearest(np.array([query], float), probes)[0].tolist()
        return top(dense_scores(self.lists(grade, probed).select("doc_id", "embedding"), query), k)

    def search_all(self, queries: DataFrame, k: int = 12, probes: int | None = None) -> DataFrame:
        """(query_id, grade, embedding), ids that do not repeat -> query_id, doc_id, score, rank: each query's k best of its grade.

        Queries meet the vectors of their lists in a join on grade and list, whose large partitions Spark can split; of each
        partition only k rows a query go on.
        """
        wanted, n = queries.where(F.size("embedding") == self.about["size"]), probes or len(self.number)
        centroids, numbers = self.centroids, self.number

        def probe(batches):
            for pdf in batches:
                if len(pdf):
                    found = nearest_lists(np.array(pdf["q"].tolist(), float), centroids, numbers, n)
                    yield type(pdf)({"query_id": np.repeat(pdf["query_id"].to_numpy(), found.shape[1]), "list": found.reshape(-1).astype(np.int32)})

        asked = wanted.select(F.col("query_id").cast("long").alias("query_id"), "grade", F.col("embedding").alias("q"))
        probed = asked.select("query_id", "q").mapInPandas(probe, "query_id long, list int").join(asked, "query_id")
        held = self.spark.read.parquet(f"{self.path}/lists")
        scored = probed.join(held, ["grade", "list"]).select("query_id", "doc_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, doc_id) of an index and of an exhaustive search -> query_id, n (exact ones), hit (found of them)."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
