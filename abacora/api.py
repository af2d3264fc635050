"""Pipelines over frames: ingest pages, search, recommend, gamify, select."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import terms
from .operators import chunking, gamify, mastery, retrieval, selection
from .sources import files, providers, store


def ingest(spark: SparkSession, folder: str, target: str, corpus: str = "corpus", provider: providers.Embed = providers.hashed_embedding, size: int = 64, force: bool = False, **limits: int) -> str:
    """Pages of a folder -> chunks -> embedded rows below target/chunks, and a manifest; "skipped" if nothing has changed."""
    version = files.corpus_version(files.manifest(spark, folder))
    settings = f"{corpus}|{version}|{size}|{sorted(limits.items())}"

    def build() -> None:
        pages = files.read_pages(spark, folder)
        line = F.posexplode(F.split("text", "\n")).alias("pos", "line")
        doc = F.concat_ws("#", "source", F.col("page").cast("string"))
        lines = pages.select(doc.alias("doc_id"), "source", "page", line).withColumn("line", F.trim("line"))
        units = chunking.structure_units(lines).withColumn("source", F.split_part("doc_id", F.lit("#"), F.lit(1)))
        page = F.split_part("doc_id", F.lit("#"), F.lit(2)).cast("long")
        chunks = chunking.chunk_pack(units.select("source", (page * 1_000_000 + F.col("unit")).alias("ord"), "text"), corpus, **limits)
        keyed = chunks.withColumn("payload", F.sha2(F.concat_ws("|", F.lit(version), "text"), 256)).withColumn("grade", F.coalesce(files.file_grade(F.col("source")), F.lit(-1)))
        contract = {"corpus": corpus, "size": size, "limits": sorted(limits.items())}
        store.upsert(keyed, f"{target}/chunks", "chunk_id", "payload", lambda df: providers.embed(df, provider, size), json_like(contract), whole=True)

    return store.ingest(spark, f"{target}/manifest.json", settings, build, force)


def json_like(value: dict) -> dict:
    """A dict as it comes back from JSON, so that it compares equal to a stored one."""
    return json.loads(json.dumps(value))


def index_status(spark: SparkSession, target: str, grades: tuple[int, ...]) -> dict:
    """Whether an index is ready, its size, and the grades it lacks."""
    manifest = store.read_manifest(spark, f"{target}/manifest.json") or {}
    if not store.exists(spark, f"{target}/chunks"):
        return {"status": manifest.get("status", "absent"), "chunks": 0, "missing": list(grades)}
    rows = store.current(spark, f"{target}/chunks", "chunk_id")
    have = {r["grade"] for r in rows.where(F.col("grade").isin(list(grades))).select("grade").distinct().collect()}  # at most len(grades)
    return {"status": manifest.get("status", "absent"), "chunks": rows.count(), "missing": [g for g in grades if g not in have]}


def hybrid_search(docs: DataFrame, query: str, query_vector: list[float], topic: str, concept: str, grade: int, k: int = 5, depth: int = 12) -> DataFrame:
    """(doc_id, text, embedding, concept_id, grade) -> the k best by fused ranks and bonuses; an empty concept gives none."""
    spark = docs.sparkSession
    words = lambda s: spark.createDataFrame([(s,)], "t string").select(terms(F.col("t"))).first()[0]
    posts = retrieval.postings(docs)
    stats = retrieval.bm25_stats(posts, docs.count())
    lexical = retrieval.top(retrieval.bm25_scores(docs, posts, stats, words(query)), depth)
    dense = retrieval.top(retrieval.dense_scores(docs, query_vector), depth)
    marked = docs.select("doc_id", "text", F.coalesce((F.col("concept_id") == concept) & F.lit(concept != ""), F.lit(False)).alias("concept_ok"), F.coalesce(F.col("grade") == grade, F.lit(False)).alias("grade_ok"))
    return retrieval.rerank(retrieval.fuse([dense, lexical]), marked, words(topic), k)


def recommend(attempts: DataFrame, answers: DataFrame, user_id: int, top: int = 5, levels: int = 3) -> DataFrame:
    """A user's weakest topics and levels, with 1.5 times as many questions (of five) and the next level added below 4."""
    core = mastery.recommend_core(attempts.where(F.col("user_id") == user_id), answers, top, levels)
    per = core.groupBy("topic_id", "topic_mistakes").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    high = F.array_max("levels")
    return per.select("topic_id", "topic_mistakes", F.when(high < 4, F.array_append("levels", high + 1)).otherwise(F.col("levels")).alias("levels"), F.floor(F.lit(5) * 1.5).alias("min_questions"))


def gamification(scores: DataFrame, as_of: str) -> DataFrame:
    """Figures, streaks and earned badges of every user."""
    activity = scores.select("user_id", F.to_date("created_at").alias("day"))
    earned = gamify.badges(scores).groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("earned"), F.col("badge")))).alias("badges"))
    return gamify.statistics(scores).join(gamify.best_streak(activity), "user_id").join(gamify.current_streak(activity, as_of), "user_id").join(earned, "user_id")


def select_unseen(items: DataFrame, exposures: DataFrame, history: DataFrame, seed: str, n: int, **excluded) -> DataFrame:
    """n active, eligible items that a user has not seen by id, text hash or source, in an order fixed by the seed."""
    fresh = selection.unseen(items.where("active AND eligible"), exposures, "item_id")
    fresh = selection.unseen(fresh, history, "item_hash")
    fresh = selection.excluding(selection.unseen_sources(fresh, history), **excluded)
    return selection.hash_sample(fresh, "item_id", seed, n)
