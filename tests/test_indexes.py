"""Kept indexes against searches that read everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacora.functions.text import terms
from abacora.operators import retrieval as R
from abacora.operators.lexical_index import LexicalIndex
from abacora.operators.vector_lists import VectorLists, recall

QUERY = ["red", "green", "red", "nothing"]


def scores(docs, k=12):
    posts = R.postings(docs)
    return [tuple(r) for r in R.top(R.bm25_scores(docs, posts, R.bm25_stats(posts, docs.count()), QUERY), k).select("doc_id", "score", "rank").collect()]


def found(index, k=12):
    return [tuple(r) for r in index.search(QUERY, k).select("doc_id", "score", "rank").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["red", "green", "blue", "sun", "moon", "x1", "y2", "green", "tree"]
    return [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(90)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lexical_index_follows_changes(spark, texts, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "i"), buckets=8)
    there = dict(texts[:50])
    index.change(frame(spark, texts[:50]))
    assert found(index) == scores(frame(spark, list(there.items())))
    come = texts[50:70] + [(3, "red red green"), (4, "")]
    there |= dict(come)
    gone = [5, 6, 55, 1000]
    for d in gone:
        there.pop(d, None)
    index.change(frame(spark, [x for x in come if x[0] != 55]), frame(spark, [(d, "") for d in gone]))
    index.change(frame(spark, [(5, "green back again")]), frame(spark, [(3, "")]))
    there[5] = "green back again"
    del there[3]
    assert found(index) == scores(frame(spark, list(there.items())))
    again = LexicalIndex(spark, str(tmp_path / "i"))
    assert (again.buckets, again.about["documents"]) == (8, len(there)) and found(again, 40) == scores(frame(spark, list(there.items())), 40)
    want = {r["term"]: (r["df"], round(r["idf"], 9)) for r in R.bm25_stats(R.postings(frame(spark, list(there.items()))), len(there)).collect()}
    assert {r["term"]: (r["df"], round(r["idf"], 9)) for r in again.statistics().collect()} == want
    again.compact()
    assert found(LexicalIndex(spark, str(tmp_path / "i")), 40) == scores(frame(spark, list(there.items())), 40)
    again.change(None, frame(spark, [(d, "") for d in there]))
    assert again.about["documents"] == again.about["tokens"] == 0 and found(again) == []


def test_lexical_index_reads_its_terms_buckets(spark, texts, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "i"), buckets=64)
    index.change(frame(spark, texts))
    plan = index.hits(["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("#", "").replace("  ", " ") or "PartitionFilters: [bucket" in plan
    read = {f.split("bucket=")[1].split("/")[0] for f in index._read("postings", "term string, doc_id long, tf long, dl long, bucket int", [1], index._buckets_of(["red"])).where("term = 'red'").select("term", F.input_file_name().alias("f")).toPandas()["f"]}
    assert len(read) == 1


def test_kept_index_is_built_when_old_or_other(spark, texts, tmp_path):
    made = []

    def documents():
        made.append(1)
        return frame(spark, texts[: 10 * len(made)])

    kept = lambda print_, now: LexicalIndex.kept(spark, str(tmp_path / "k"), print_, documents, ttl=100, now=now, buckets=4)
    assert kept("a", 1000.0).about["documents"] == 10
    assert kept("a", 1099.0).about["documents"] == 10 and len(made) == 1
    assert kept("a", 1100.0).about["documents"] == 20
    assert kept("b", 1101.0).about["documents"] == 30 and found(kept("b", 1102.0)) == scores(frame(spark, texts[:30]))


def test_a_broken_change_shows_nothing(spark, texts, tmp_path, monkeypatch):
    from abacora.operators import lexical_index

    index = LexicalIndex(spark, str(tmp_path / "b"), buckets=4)
    index.change(frame(spark, texts[:20]))
    before = found(index)

    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(lexical_index, "write_manifest", broken)
    with pytest.raises(OSError):
        index.change(frame(spark, texts[20:60]))
    monkeypatch.undo()
    again = LexicalIndex(spark, str(tmp_path / "b"))
    assert found(again) == before
    again.change(frame(spark, texts[20:40]))
    assert found(again) == scores(frame(spark, texts[:40]))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    rows = [(i, i % 3, (centers[rng.integers(12)] + rng.normal(size=16) * 0.35).tolist()) for i in range(900)]
    return rows + [(2000, 1, None), (2001, 1, [float("nan")] * 16), (2002, 2, [1.0] * 5), (2003, 0, [0.0] * 16), (7, 2, rows[7][2])]


@pytest.fixture(scope="module")
def lists(spark, vectors, tmp_path_factory):
    frame = spark.createDataFrame(vectors, "doc_id long, grade int, embedding array<double>")
    return VectorLists.build(frame, str(tmp_path_factory.mktemp("lists") / "v"), lists=24, corpus="v1")


def exhaustive(vectors, query, grade, k):
    score = [(-round(float(np.dot(v, query)), 6), i) for i, g, v in vectors if g == grade and v is not None and len(v) == 16 and np.isfinite(v).all()]
    return [(i, -s) for s, i in sorted(score)[:k]]


def test_vector_lists_exhaustive_and_probed(spark, vectors, lists):
    queries = [(i, g, v) for i, g, v in vectors[:900:30]]
    frame = spark.createDataFrame(queries, "query_id long, grade int, embedding array<double>")
    whole = lists.search_all(frame, 10)
    got = {}
    for r in whole.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 5)))
    for i, g, v in queries:
        want = exhaustive(vectors, v, g, 10)
        assert got[i] == [(d, round(s, 5)) for d, s in want]
    i, g, v = queries[4]
    assert [r["doc_id"] for r in lists.search(v, g, 10).orderBy("rank").collect()] == [d for d, _ in exhaustive(vectors, v, g, 10)]
    sums = recall(lists.search_all(frame, 10, probes=6), whole).agg(F.sum("hit"), F.sum("n")).first()
    assert sums[0] >= 0.95 * sums[1]


def test_vector_lists_read_probed_partitions_only(vectors, lists):
    probed = lists.nearest(np.array([vectors[0][2]]), 2)[0].tolist()
    rows = lists.lists(0, probed)
    plan = rows._jdf.queryExecution().toString()
    part = plan[plan.index("PartitionFilters:") :].split("]")[0]
    assert "grade" in part and "list" in part
    files = {tuple(f.split("/")[-3:-1]) for f in rows.select(F.input_file_name().alias("f")).toPandas()["f"]}
    assert files <= {("grade=0", f"list={n}") for n in probed}


def test_vector_lists_stand_for_one_corpus(spark, lists):
    assert VectorLists.open(spark, lists.path, "v1").about["vectors"] == 902
    assert VectorLists.open(spark, lists.path, "v2") is None
    assert VectorLists.open(spark, lists.path + "-none", "v1") is None
    with pytest.raises(ValueError):
        VectorLists(spark, lists.path + "-none")


def test_terms_are_the_engines(spark):
    assert spark.range(1).select(terms(F.lit("Reds green")).alias("t")).first()["t"][1] == "green"
