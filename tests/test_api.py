from pyspark.sql import functions as F

from abacora import api
from abacora.views import AS_OF, SEED, Views


def test_ingest_search_status(spark, tmp_path):
    (tmp_path / "books").mkdir()
    for g in (10, 11):
        body = "\n\n".join(f"Example {i}\n" + " ".join(f"word{(i * 37 + j) % 400}" for j in range(90)) for i in range(12))
        (tmp_path / "books" / f"maths gr{g}.md").write_text(body)
    target = f"file://{tmp_path}/index"
    assert api.ingest(spark, str(tmp_path / "books"), target) == "built"
    assert api.ingest(spark, str(tmp_path / "books"), target) == "skipped"
    status = api.index_status(spark, target, (9, 10, 11))
    assert status["status"] == "ready" and status["missing"] == [9] and status["chunks"] > 4
    rows = spark.read.parquet(f"{target}/chunks")
    assert rows.where("token_count < 300 OR token_count > 450").count() == 0


def test_concept_and_topic_lift_the_lexical_hit(spark):
    docs = spark.createDataFrame(
        [("dense", "algebra and other matters", [1.0, 0.0], "c0", 10), ("lexical", "perimeter of a rectangle in metres", [0.0, 1.0], "c1", 10), *((f"x{i}", f"filler {i} text", [-1.0, 0.0], "c9", 9) for i in range(6))],
        "doc_id string, text string, embedding array<double>, concept_id string, grade int",
    )
    got = api.hybrid_search(docs, "Grade 10 perimeter rectangle", [1.0, 0.0], "perimeter rectangle", "c1", 10, k=2, depth=2).collect()
    assert [r["doc_id"] for r in got] == ["lexical", "dense"]


def test_recommend_gamify_select(spark, sf_dir):
    v = Views(spark, sf_dir)
    user = v.attempt.join(v.answer_unnumbered.where("not is_correct"), "attempt_id").select("user_id").orderBy("user_id").first()[0]
    plan = api.recommend(v.attempt, v.answer_unnumbered, user).collect()
    assert plan and all(r["min_questions"] == 7 and max(r["levels"]) >= 2 for r in plan)
    figures = api.gamification(v.score, AS_OF).where("n >= 1").collect()
    assert figures and all("first_spark" in r["badges"] for r in figures)
    history = v.attempt.where(F.col("user_id") == user).join(v.answer_unnumbered, "attempt_id")
    first = api.select_unseen(v.item, v.exposure.where(F.col("user_id") == user), history, SEED, 10)
    ids = [r["item_id"] for r in first.collect()]
    again = api.select_unseen(v.item, v.exposure.where(F.col("user_id") == user), history, SEED, 10, item_id=ids)
    assert len(set(ids)) == 10 and not set(ids) & {r["item_id"] for r in again.collect()}
