"""Queries on kept indexes: inverted lists of vectors, and an index of terms after documents came and went."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lexical_index import LexicalIndex
from ..operators.vector_lists import VectorLists, recall
from ..sources.store import temporary
from ..views import Views
from .registry import query
from .retrieval import _BM25, K, QUERY_TERMS

_DOT = "round(list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE))), 6)"
_BY_GRADE = f"""SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {_DOT.format("e.embedding", "q.embedding")} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.label = e.label"""


def _lists(v: Views) -> tuple[VectorLists, object]:
    vectors = v.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("grade"), "embedding")
    queries = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return VectorLists.build(vectors, temporary(v.spark, "lists")), queries


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_BY_GRADE})) WHERE rank <= {K}")
def vector_lists_exhaustive(v: Views):
    """O1 with P1: every hundredth vector's best of its grade, from all lists of the grade."""
    index, queries = _lists(v)
    return index.search_all(queries, K).select("query_id", "doc_id", "score", "rank")


@query()
def vector_lists_probed(v: Views):
    """O1: the same from three quarters of the lists, with how many of the exhaustive search's each query found. Directions of
    the test vectors are nearly uniform, which leaves little to skip; clustered vectors need far fewer lists (see the tests)."""
    index, queries = _lists(v)
    few = index.search_all(queries, K, probes=-(-3 * len(index.number) // 4))
    return few.join(recall(few, index.search_all(queries, K)), "query_id").select("query_id", "doc_id", "score", "rank", "n", "hit")


_CHANGED = "docs AS (SELECT doc_id, CASE WHEN doc_id % 11 = 4 THEN text || ' the and that' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@query(f"WITH {_CHANGED}, {_BM25.replace('FROM documents', 'FROM docs')} SELECT doc_id, score, rank FROM lex")
def lexical_index_after_changes(v: Views):
    """Nine tenths of the documents are indexed, the others come, some texts change and some documents go again."""
    docs = v.table("documents").select("doc_id", "text")
    index = LexicalIndex(v.spark, temporary(v.spark, "lexical"))
    index.change(docs.where("doc_id % 10 <> 0"))
    stays = docs.where("doc_id % 7 <> 3")
    changed = stays.where("doc_id % 11 = 4").withColumn("text", F.concat("text", F.lit(" the and that")))
    index.change(stays.where("doc_id % 10 = 0 and doc_id % 11 <> 4").union(changed), docs.where("doc_id % 7 = 3"))
    return index.search(QUERY_TERMS, K).select("doc_id", "score", "rank")
