"""Retrieval: BM25, dense search, rank fusion, containment and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, slug, terms, topic_id
from .layout import spread
from .substrings import contained


#: Questions up to so many are looked for by automata in passes over the chunks; more meet chunks on word runs.
FEW_QUESTIONS = 20_000


def copied_questions(questions: DataFrame, chunks: DataFrame, least: int = 40) -> DataFrame:
    """P5: questions (item_id, text) of at least `least` normalised characters that some chunk (doc_id, text) contains.

    Up to FEW_QUESTIONS questions are looked for in the scan of the chunks, all at once (see substrings.contained). Of more,
    those of six or more words meet chunks in a join on their second to fifth words, which are whole words of any chunk that
    contains them, and containment is then checked for those pairs; shorter ones are looked for in the scan again.
    """
    q = questions.select("item_id", normalise(F.col("text")).alias("q")).where(F.length("q") >= least)
    t = spread(chunks.select("doc_id", "text")).select("doc_id", normalise(F.col("text")).alias("t"))
    found = lambda few: contained(t, few.select("item_id", "q")).select(F.col("pattern_id").alias("item_id"))
    if q.limit(FEW_QUESTIONS + 1).count() <= FEW_QUESTIONS:
        return found(q).distinct()
    words = F.split("q", " ")
    long = q.where(F.size(words) >= 6).select("item_id", "q", F.array_join(F.slice(words, 2, 4), " ").alias("key"))
    runs = F.transform(F.array(F.split("t", " ")), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(4)), " ")))
    pairs = t.select("doc_id", F.explode(F.array_distinct(runs[0])).alias("key")).join(long.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    hits = pairs.join(t, "doc_id").join(long.select("item_id", "q"), "item_id").where(F.col("t").contains(F.col("q"))).select("item_id")
    return hits.union(found(q.where(F.size(words) < 6))).distinct()


def first_holders(needles: DataFrame, units: DataFrame) -> DataFrame:
    """(item_id, needle) and (doc_id, text) -> item_id, unit: the smallest document that holds the needle."""
    return contained(units, needles).groupBy(F.col("pattern_id").alias("item_id")).agg(F.min("id").alias("unit"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, term, tf."""
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25_stats(posts: DataFrame, n_docs: int, floor: float = 0.25) -> DataFrame:
    """Term, df, idf; a negative idf becomes `floor` times the mean idf over all terms."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(docs: DataFrame, posts: DataFrame, stats: DataFrame, query_terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """O2: every document with its score, 0 where no query term occurs; repeated query terms count repeatedly."""
    spark = docs.sparkSession
    times = spark.createDataFrame([(t, query_terms.count(t)) for t in sorted(set(query_terms))], "term string, times int")
    length = posts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    mean = length.agg(F.sum("dl").alias("total")).crossJoin(docs.agg(F.count("*").alias("n"))).select((F.col("total") / F.col("n")).alias("avgdl"))  # one row
    wanted = posts.where(F.col("term").isin(sorted(set(query_terms))))  # reaches the scan of written postings
    hit = wanted.join(F.broadcast(times), "term").join(F.broadcast(stats.select("term", "idf").where(F.col("term").isin(sorted(set(query_terms))))), "term").join(length, "doc_id").crossJoin(F.broadcast(mean))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = hit.groupBy("doc_id").agg(F.sum(part).alias("score"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """O1: cosine of unit vectors with the query's, one expression in the scan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select("doc_id", F.round(dot(F.col("embedding"), q), 6).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best with their rank; ties by document."""
    best = scores.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # over k rows


def fuse(lists: list[DataFrame], constant: int = 60) -> DataFrame:
    """Ranked lists (doc_id, rank) -> doc_id, score: the sum of 1 / (constant + rank)."""
    all_lists = lists[0].select("doc_id", "rank")
    for other in lists[1:]:
        all_lists = all_lists.union(other.select("doc_id", "rank"))
    return all_lists.groupBy("doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def rerank(fused: DataFrame, docs: DataFrame, topic_terms: list[str], k: int = 5) -> DataFrame:
    """O3: fused scores plus bonuses for coverage, phrase, concept and grade (docs: doc_id, text, concept_ok, grade_ok)."""
    wanted = F.array(*(F.lit(t) for t in sorted(set(topic_terms))))
    t = terms(F.col("text"))
    coverage = F.size(F.array_intersect(wanted, F.array_distinct(t))) / len(set(topic_terms))
    phrase = F.array_join(t, " ").contains(" ".join(topic_terms))
    bonus = 0.01 * coverage + F.when(phrase, 0.006).otherwise(0.0) + F.when(F.col("concept_ok"), 0.008).otherwise(0.0) + F.when(F.col("grade_ok"), 0.002).otherwise(-1.0)
    scored = fused.join(docs, "doc_id").select("doc_id", F.round(F.col("score") + bonus, 6).alias("score"))
    return top(scored, k)


def resolve_topics(targets: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(grade, topic) -> grade, topic, topic_id: of the grade's first topic in catalogue order whose normal form equals the
    target's, holds it or is held by it; else an id made of grade and name.

    catalogue: grade, term, no, name, ord; a curriculum, so its topics are few, and targets are distinct.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    known = catalogue.select("grade", "ord", topic_id(F.col("grade"), F.col("term"), F.col("no"), F.col("name")).alias("id"), norm("name").alias("n")).where("n <> ''")
    wanted = targets.select("grade", "topic").distinct().withColumn("t", norm("topic"))
    met = wanted.where("t <> ''").join(known, "grade").where(F.col("n").contains(F.col("t")) | F.col("t").contains(F.col("n")))
    first = met.groupBy("grade", "topic").agg(F.min_by("id", "ord").alias("id"))
    made = F.concat(F.lit("practice_g"), F.col("grade").cast("string"), F.lit("_"), slug(F.col("topic")))
    return wanted.join(first, ["grade", "topic"], "left").select("grade", "topic", F.coalesce("id", made).alias("topic_id"))


def map_topics(topics: DataFrame, strands: DataFrame, k: int = 3) -> DataFrame:
    """(topic, levels) and strands (ord, main, strand, path, topics, levels) -> topic, main, strand, match, rank.

    A strand that lists the topic counts 100 and the levels it shares, another one only these; where some strand lists the
    topic, the others are left out. Of strands with the same name and path the best is kept; ties go to the first in order.
    """
    by_name = strands.select("ord", F.explode(F.array_distinct("topics")).alias("topic"), F.lit(100).alias("score"))
    levels = strands.select("ord", F.explode(F.array_distinct("levels")).alias("level")).join(topics.select("topic", F.explode(F.array_distinct("levels")).alias("level")), "level").select("ord", "topic", F.lit(1).alias("score"))
    named = by_name.join(topics.select("topic"), "topic", "left_semi").select("ord", "topic", "score")
    scored = named.union(levels).groupBy("topic", "ord").agg(F.sum("score").alias("score"), F.bool_or(F.col("score") == 100).alias("named"))
    any_named = F.max("named").over(Window.partitionBy("topic"))
    kept = scored.withColumn("any", any_named).where("named or not any").join(strands.select("ord", "main", "strand", "path"), "ord")
    once = kept.withColumn("n", F.row_number().over(Window.partitionBy("topic", "main", "strand", "path").orderBy(F.desc("score"), "ord"))).where("n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)
    return ranked.select("topic", "main", "strand", F.when(F.col("named"), "topic").otherwise("competency").alias("match"), "rank")


def best_concepts(texts: DataFrame, concepts: DataFrame, least: float = 1.0) -> DataFrame:
    """(doc_id, grade, text) -> doc_id, concept_id, score: of the grade's concepts (concept_id, grade, phrase, ord) the one
    with the largest share of its words in the text, plus 2 if its phrase is part of it; the first of equal ones, and none
    below `least`. A grade's concepts are few and travel as one array, so texts are not multiplied.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    entry = F.struct("ord", "concept_id", F.array_join(words("phrase"), " ").alias("phrase"), F.array_distinct(words("phrase")).alias("words"))
    by_grade = concepts.groupBy("grade").agg(F.collect_list(entry).alias("concepts"))

    def score(c: Column) -> Column:
        share = F.size(F.array_intersect(c["words"], "words")) / F.size(c["words"])
        return F.struct((F.when(F.col("norm").contains(c["phrase"]), 2.0).otherwise(0.0) + share).alias("score"), (-c["ord"]).alias("first"), c["concept_id"].alias("concept_id"))

    bound = texts.select("doc_id", "grade", words("text").alias("all")).select("doc_id", "grade", F.array_join("all", " ").alias("norm"), F.array_distinct("all").alias("words"))
    found = bound.join(F.broadcast(by_grade) if by_grade.count() <= 100 else by_grade, "grade")
    best = F.array_max(F.transform(F.filter("concepts", lambda c: F.size(c["words"]) > 0), score))
    return found.select("doc_id", best.alias("b")).where(F.col("b.score") >= least).select("doc_id", "b.concept_id", F.round("b.score", 6).alias("score"))
