"""Queries on retrieval, evidence, concepts and overlap joins."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mcq as Q
from ..functions import text as T
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators.layout import spread
from ..operators.lexical_index import LexicalIndex
from ..sources.store import file_state, shared_folder
from ..views import Views
from .registry import query
from .text import _NORM

QUERY = "the and that"
QUERY_TERMS = ["the", "and", "that"]
K = 12

_TERMS = r"list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+|[=+\-*/^√π]+'), lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN substr(x, 1, length(x) - 1) ELSE x END)"
_POSTS = f"tk AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY doc_id, term)"
_STATS = f"""{_POSTS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), raw AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, n),
st AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_STATS}, dl AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS dl FROM p GROUP BY doc_id), av AS (SELECT sum(dl) / (SELECT n FROM n) AS avgdl FROM dl),
h AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN st USING (term) JOIN dl USING (doc_id), av WHERE term IN ('the', 'and', 'that') GROUP BY doc_id),
bm AS (SELECT d.doc_id, round(coalesce(score, 0), 6) AS score FROM documents d LEFT JOIN h USING (doc_id)), lex AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm ORDER BY rank LIMIT {K})"""
_DENSE = f"""q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), de AS (SELECT vec_id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))), 6) AS score FROM embeddings, q),
dense AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM de ORDER BY rank LIMIT {K})"""
_RRF = "f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM lex UNION ALL SELECT doc_id, rank FROM dense) GROUP BY doc_id)"


def _index(v: Views) -> LexicalIndex:
    """The kept index of the folder's documents; built again when their files change or an hour is over."""
    docs = v.table("documents").select("doc_id", "text")
    state = file_state(v.spark, f"{v.folder}/documents.parquet")
    return LexicalIndex.kept(v.spark, f"{shared_folder(v.spark)}/lexical-{hashlib.sha256(v.folder.encode()).hexdigest()[:16]}", state, lambda: docs)


def _lexical(v: Views):
    return _index(v).search(QUERY_TERMS, K)


def _dense(v: Views):
    vectors = v.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = vectors.where("doc_id = 0").limit(1).collect()  # the query vector
    return R.top(R.dense_scores(vectors, q[0]["embedding"] if q else [0.0]), K)


@query(f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf FROM st")
def bm25_stats(v: Views):
    return _index(v).statistics().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT doc_id, score, rank FROM lex")
def bm25_topk(v: Views):
    return _lexical(v).select("doc_id", "score", "rank")


@query(f"WITH {_DENSE} SELECT doc_id, score, rank FROM dense")
def dense_topk(v: Views):
    return _dense(v).select("doc_id", "score", "rank")


@query(f"WITH {_BM25}, {_DENSE}, {_RRF} SELECT doc_id, round(score, 6) AS score FROM f")
def rrf_fusion(v: Views):
    return R.fuse([_dense(v), _lexical(v)]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, {_DENSE}, {_RRF}, b AS (SELECT doc_id, f.score, {_TERMS.format('text')} AS t, lang, source FROM f JOIN documents USING (doc_id)),
s AS (SELECT doc_id, round(score + 0.01 * len(list_intersect(['and', 'that', 'the'], t)) / 3.0 + CASE WHEN contains(array_to_string(t, ' '), 'the and that') THEN 0.006 ELSE 0.0 END
+ CASE WHEN source = 'src1' THEN 0.008 ELSE 0.0 END + CASE WHEN lang = 'en' THEN 0.002 ELSE -1.0 END, 6) AS score FROM b)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 5""")
def hybrid_search(v: Views):
    docs = v.table("documents").select("doc_id", "text", (F.col("source") == "src1").alias("concept_ok"), (F.col("lang") == "en").alias("grade_ok"))
    return R.rerank(R.fuse([_dense(v), _lexical(v)]), docs, QUERY_TERMS).select("doc_id", "score", "rank")


@query("SELECT vec_id, len(embedding) AS size, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS first_unit FROM embeddings")
def vector_normalise(v: Views):
    e = F.col("embedding")
    norm = F.sqrt(R.dot(e, e))
    return v.table("embeddings").select("vec_id", F.size(e).cast("long").alias("size"), F.round(norm, 4).alias("norm"), F.round(e[0].cast("double") / norm, 5).alias("first_unit"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN len(embedding) <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_size, CAST(sum(CASE WHEN len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS not_finite, CAST(sum(CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero FROM embeddings")
def vector_preflight_checks(v: Views):
    e = F.col("embedding")
    inf = F.lit(float("inf"))
    return v.table("embeddings").agg(F.count("*").alias("n"), F.count_if(F.size(e) != 64).alias("wrong_size"), F.count_if(F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == inf))).alias("not_finite"), F.count_if(~F.exists(e, lambda x: x != 0)).alias("zero"))


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_FLAT = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT grade, topic_name AS name, min(item_id) AS ord FROM v_item GROUP BY grade, topic_name), n AS (SELECT p_partkey, CAST(6 + p_size % 9 AS INTEGER) AS grade, split_part(p_name, ' ', 1) AS topic FROM part),
d AS (SELECT DISTINCT grade, topic FROM n), m AS (SELECT d.grade, topic, arg_min('g' || CAST(c.grade AS VARCHAR) || '_t' || CAST(1 + ord % 3 AS VARCHAR) || '_' || lpad(CAST(ord % 100 AS VARCHAR), 2, '0') || '_' || {_SLUG.format('name')}, ord) AS id
FROM d JOIN c ON c.grade = d.grade AND (contains({_FLAT.format('name')}, {_FLAT.format('topic')}) OR contains({_FLAT.format('topic')}, {_FLAT.format('name')})) GROUP BY d.grade, topic)
SELECT p_partkey, coalesce(id, 'practice_g' || CAST(grade AS VARCHAR) || '_' || {_SLUG.format('topic')}) AS topic_id FROM n LEFT JOIN m USING (grade, topic)""")
def theta_topic_resolve(v: Views):
    ord_ = F.col("ord")
    c = v.item.groupBy("grade", F.col("topic_name").alias("name")).agg(F.min("item_id").alias("ord")).select("grade", "name", "ord", (1 + ord_ % 3).alias("term"), (ord_ % 100).alias("no"))
    n = v.table("part").select("p_partkey", (6 + F.col("p_size") % 9).alias("grade"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("topic"))
    return n.join(R.resolve_topics(n, c), ["grade", "topic"]).select("p_partkey", "topic_id")


@query("""WITH t AS (SELECT p_brand AS topic, list_distinct(list(p_size)) AS levels FROM part WHERE p_size % 3 = 0 GROUP BY p_brand),
s AS (SELECT CAST(p_size AS BIGINT) AS ord, 'M' || CAST(p_size % 4 AS VARCHAR) AS main, 'S' || CAST(p_size % 10 AS VARCHAR) AS strand, 'P' || CAST(p_size % 20 AS VARCHAR) AS path, list_distinct(list(CASE WHEN p_partkey % 40 = 0 AND p_size % 2 = 0 THEN p_brand END)) AS topics, list_distinct(list(CAST(p_partkey % 50 AS INTEGER))) AS levels FROM part GROUP BY p_size),
m AS (SELECT topic, s.*, list_contains(s.topics, topic) AS named, len(list_intersect(s.levels, t.levels)) AS shared FROM t, s), a AS (SELECT *, bool_or(named) OVER (PARTITION BY topic) AS anyone FROM m WHERE named OR shared > 0),
k AS (SELECT *, CASE WHEN named THEN 100 ELSE 0 END + shared AS score FROM a WHERE named OR NOT anyone), o AS (SELECT *, row_number() OVER (PARTITION BY topic, main, strand, path ORDER BY score DESC, ord) AS n FROM k)
SELECT topic, main, strand, CASE WHEN named THEN 'topic' ELSE 'competency' END AS match, rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, ord) AS rank FROM o WHERE n = 1) WHERE rank <= 3""")
def overlap_join_top3(v: Views):
    size, part = F.col("p_size"), F.col("p_partkey")
    text = lambda letter, n: F.concat(F.lit(letter), (size % n).cast("string"))
    topics = v.table("part").where("p_size % 3 = 0").groupBy(F.col("p_brand").alias("topic")).agg(F.collect_set("p_size").alias("levels"))
    strands = v.table("part").groupBy("p_size").agg(F.collect_set(F.when((part % 40 == 0) & (size % 2 == 0), F.col("p_brand"))).alias("topics"), F.collect_set((part % 50).cast("int")).alias("levels"))
    return R.map_topics(topics, strands.select(size.cast("long").alias("ord"), text("M", 4).alias("main"), text("S", 10).alias("strand"), text("P", 20).alias("path"), "topics", "levels"))


@query(r"""WITH b AS (SELECT item_id, item_id % 6 AS grade, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), c AS (SELECT item_id, grade, array_to_string(w[1:CAST(2 + item_id % 3 AS INTEGER)], ' ') AS phrase, list_distinct(w[1:CAST(2 + item_id % 3 AS INTEGER)]) AS words FROM b),
d AS (SELECT doc_id, doc_id % 6 AS grade, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), e AS (SELECT doc_id, grade, array_to_string(w, ' ') AS norm, list_distinct(w) AS words FROM d),
s AS (SELECT doc_id, item_id, CASE WHEN contains(norm, phrase) THEN 2.0 ELSE 0.0 END + len(list_intersect(c.words, e.words)) / CAST(len(c.words) AS DOUBLE) AS score FROM e JOIN c ON e.grade = c.grade WHERE len(c.words) > 0)
SELECT doc_id, item_id AS concept_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS n FROM s) WHERE n = 1 AND score >= 1""")
def concept_argmax(v: Views):
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    phrase = F.array_join(F.slice(words, F.lit(1), (2 + F.col("item_id") % 3).cast("int")), " ")
    concepts = v.table("benchmark").select(F.col("item_id").alias("concept_id"), (F.col("item_id") % 6).alias("grade"), phrase.alias("phrase"), F.col("item_id").alias("ord"))
    return R.best_concepts(v.table("documents").select("doc_id", (F.col("doc_id") % 6).alias("grade"), "text"), concepts)


@query(rf"""WITH e AS (SELECT item_id, array_to_string(list_slice(string_split({_NORM.format('text')}, ' '), 3, 14), ' ') AS q FROM benchmark), d AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents)
SELECT item_id, min(doc_id) AS unit FROM e, d WHERE contains(t, q) GROUP BY item_id""")
def evidence_first_unit(v: Views):
    e = v.table("benchmark").select("item_id", F.array_join(F.slice(F.split(T.normalise(F.col("text")), " "), 3, 12), " ").alias("q"))
    d = spread(v.table("documents").select("doc_id", "text")).select("doc_id", T.normalise(F.col("text")).alias("t"))
    return R.first_holders(e, d)


@query("SELECT a.doc_id, CASE WHEN contains(b.text, a.text) THEN b.doc_id ELSE a.doc_id END AS context_from FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 10")
def parent_context(v: Views):
    d = v.table("documents").select("doc_id", "text")
    parents = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("parent"), F.col("text").alias("parent_text"))
    joined = d.withColumn("parent", F.col("doc_id") - F.col("doc_id") % 10).join(parents, "parent")
    return joined.select("doc_id", F.when(F.col("parent_text").contains(F.col("text")), F.col("parent")).otherwise(F.col("doc_id")).alias("context_from"))


@query("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang, n_chars % 10 ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def distinct_refs(v: Views):
    d = v.table("documents").select("source", "lang", "doc_id", (F.col("n_chars") % 10).alias("page"))
    return S.first_by(d, ["source", "lang", "page"], ["doc_id"]).select("source", "lang", "doc_id")


@query(rf"""WITH e AS (SELECT conv_id, turn, {_TERMS.format('text')} AS t FROM conversations), s AS (SELECT conv_id, turn, t, round(10.0 * len(list_intersect(['and', 'that', 'the'], t)) / 3 + CASE WHEN contains(array_to_string(t, ' '), 'the and that') THEN 3 ELSE 0 END - 0.05 * turn, 6) AS score FROM e)
SELECT conv_id, turn, score, rank FROM (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, array_to_string(t, ' ')) AS rank FROM s) WHERE rank <= 12""")
def evidence_rank(v: Views):
    t = T.terms(F.col("text"))
    wanted = F.array(*(F.lit(x) for x in sorted(QUERY_TERMS)))
    score = F.round(10.0 * F.size(F.array_intersect(wanted, F.array_distinct("t"))) / 3 + F.when(F.array_join("t", " ").contains(QUERY), 3).otherwise(0) - 0.05 * F.col("turn"), 6)
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn", F.array_join("t", " "))
    return v.table("conversations").select("conv_id", "turn", t.alias("t")).withColumn("score", score).withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("conv_id", "turn", "score", "rank")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, rank FROM r WHERE ((rank - 5 % n) % n + n) % n < 4 AND rank < 12""")
def rotating_window(v: Views):
    by = Window.partitionBy("conv_id")
    r = v.table("conversations").withColumn("rank", (F.row_number().over(by.orderBy("turn", "text")) - 1).cast("long")).withColumn("n", F.count("*").over(by))
    return r.where(F.pmod(F.col("rank") - F.lit(5) % F.col("n"), F.col("n")) < 4).where("rank < 12").select("conv_id", "turn", "rank")


_SOURCED = """WITH q AS (SELECT *, CASE WHEN question_id % 6 = 0 THEN '' ELSE 's' || CAST(question_id % 130 AS VARCHAR) END AS source_question_id, upper(trim(answer)) AS letter FROM v_question),
s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS source_question_id, true AS known, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'Brand#' || CAST(1 + s_suppkey % 25 AS VARCHAR) END AS concept_id, CAST(6 + s_nationkey % 6 AS INTEGER) AS src_grade, CAST(s_nationkey AS VARCHAR) || '.0' AS canonical FROM supplier),
j AS (SELECT q.*, known, concept_id, src_grade, CAST(canonical AS DOUBLE) AS canonical, TRY_CAST(CASE WHEN letter IN ('A', 'B', 'C', 'D') THEN options[instr('ABCD', letter)] END AS DOUBLE) AS own FROM q LEFT JOIN s USING (source_question_id))"""
_SOURCED_RULES = """CASE WHEN source_question_id = '' THEN 'names no source' END, CASE WHEN source_question_id <> '' AND known IS NULL THEN 'names an unknown source' END,
CASE WHEN known AND concept_id <> '' AND concept_id <> topic_id THEN 'source of another concept' END, CASE WHEN known AND src_grade <> grade THEN 'source of another grade' END, CASE WHEN known AND NOT coalesce(own = canonical, false) THEN 'another answer than its source' END"""


@query(f"{_SOURCED} SELECT question_id, array_to_string(list_filter([{_SOURCED_RULES}], lambda x: x IS NOT NULL), ';') AS errors FROM j")
def source_match_errors(v: Views):
    """All seven checks between a question and the past question it names."""
    key, n = F.col("s_suppkey"), F.col("question_id")
    sources = v.table("supplier").select(
        F.concat(F.lit("s"), key.cast("string")).alias("question_id"), F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("Brand#"), (1 + key % 25).cast("string"))).alias("concept_id"),
        (6 + F.col("s_nationkey") % 6).cast("int").alias("grade"), F.lit("~").alias("question"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")).alias("canonical_answer"),
    )
    named = v.question.withColumn("source_question_id", F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("s"), (n % 130).cast("string"))))
    return Q.with_sources(named, sources).select("question_id", F.array_join(Q.reasons(*Q.source_rules()), ";").alias("errors"))


@query("""WITH w AS (SELECT DISTINCT topic_id FROM v_item), p AS (SELECT topic_id, count(*) AS n FROM v_question WHERE question_id % 40 = 0 AND question_id % 80 <> 0 OR question_id % 320 = 0 GROUP BY topic_id), c AS (SELECT topic_id FROM w WHERE topic_id <> 'Brand#7')
SELECT coalesce(c.topic_id, p.topic_id) AS topic_id, CASE WHEN n IS NULL THEN 'missing topic' WHEN c.topic_id IS NULL THEN 'unexpected topic' ELSE 'repeated topic' END AS error FROM c FULL JOIN p ON c.topic_id = p.topic_id WHERE n IS NULL OR c.topic_id IS NULL OR n > 1""")
def paper_coverage_errors(v: Views):
    """Which topics of a catalogue a paper lacks, repeats or should not have (the full check has no SQL, see tests)."""
    paper = v.question.where("question_id % 40 = 0 and question_id % 80 <> 0 or question_id % 320 = 0").withColumn("index", F.col("question_id").cast("int"))
    catalogue = v.item.where("topic_id <> 'Brand#7'").groupBy("topic_id").agg(F.min("grade").alias("grade"))
    cited = paper.withColumns({"grounding_evidence": F.lit(""), "source_refs": F.lit(None).cast(Q.REFS)})
    return Q.paper_errors(cited, catalogue).where("index is null").select("topic_id", "error")


@query("""SELECT question_id, array_to_string(list_filter([CASE WHEN NOT question_id % 50 BETWEEN 8 AND 40 THEN 'evidence is not of 8 to 40 words' END, CASE WHEN grade <> 6 + question_id % 6 THEN 'another grade than the catalogue''s' END, CASE WHEN question_id % 13 = 0 THEN 'no source' END,
CASE WHEN question_id % 13 <> 0 AND grade <> 6 + question_id % 6 THEN 'a source of another grade' END, CASE WHEN question_id % 13 <> 0 AND question_id % 3 = 0 THEN 'a citation without file or pages' END, CASE WHEN question_id % 13 <> 0 AND question_id % 7 = 0 THEN 'a source without chunk' END,
CASE WHEN question_id % 13 <> 0 AND question_id % 11 = 0 THEN 'a source without corpus version' END], lambda x: x IS NOT NULL), ';') AS errors FROM v_question""")
def paper_citation_errors(v: Views):
    """Evidence, grade and provenance of each question of a paper."""
    n = F.col("question_id")
    ref = F.struct(F.lit("a.md").alias("source"), (n % 3).cast("int").alias("page"), F.lit(None).cast("int").alias("page_start"), F.when(n % 2 == 0, (n % 3 + 1).cast("int")).alias("page_end"), "grade", F.when(n % 7 == 0, " ").otherwise("c").alias("chunk_id"), F.when(n % 11 != 0, "v").alias("corpus_version"))
    rows = v.question.withColumns({"wanted_grade": (6 + n % 6).cast("int"), "grounding_evidence": F.array_join(F.array_repeat(F.lit("word"), (n % 50).cast("int")), "  ")})
    cited = rows.withColumn("source_refs", F.when(n % 13 == 0, F.array().cast(Q.REFS)).otherwise(F.array(ref).cast(Q.REFS)))
    return cited.select("question_id", F.array_join(Q.reasons(*Q.citation_rules()), ";").alias("errors"))
