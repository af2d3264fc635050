import json

import pytest
from pyspark.sql import functions as F

from abacora.functions import mcq
from abacora.sources.providers import Exhausted, SharedLimit, budget_folder, complete, limited, retried

GOOD = {"question": "A rope of 12 m is cut into 4 equal parts. How long is each?", "options": ["A) 3 m", "B) 4 m", "C) 2 m", "D) 6 m"], "correct_answer": "3 m", "explanation": "12 divided by 4 is 3."}
COLUMNS = "question string, options array<string>, answer string, correct_answer string, explanation string, source_question_id string, topic_id string, grade int"


def test_parse():
    found = mcq.parse("```json\n" + json.dumps({"questions": [GOOD, {**GOOD, "options": ["1"]}, {**GOOD, "correct_answer": "9 m"}, "x"]}) + "\n```")
    assert len(found) == 1 and found[0]["answer"] == "A" and found[0]["options"] == ["3 m", "4 m", "2 m", "6 m"]
    more = mcq.parse(json.dumps([{**GOOD, "evidence_id": "e1 ", "grounding_evidence": "rope", "grade": 10, "concept_id": "c", "source": "a/b.md", "page": 3}]))[0]
    assert (more["evidence_id"], more["grounding_evidence"], more["grade"], more["concept_id"], more["source"], more["page"], more["source_question_id"]) == ("E1", "rope", 10, "c", "b.md", 3, None)
    by_text = {k: v for k, v in GOOD.items() if k != "correct_answer"}
    assert [mcq.parse(json.dumps([{**by_text, "answer": a}]))[0]["answer"] for a in ("b", "Option C.", "6 M")] == ["B", "C", "D"]
    assert mcq.parse(json.dumps([by_text]), need_value=True) == [] and mcq.parse("nothing") == []
    assert mcq.parse("Use {x} here: [1] and then " + repr([GOOD]))[0]["answer"] == "A"  # a Python literal behind prose


def errors(spark, *questions, sources=None, **more):
    rows = [tuple(q.get(c.split()[0]) for c in COLUMNS.split(", ")) for q in questions]
    frame = spark.createDataFrame(rows, COLUMNS).withColumns(more)
    return [r["errors"] for r in mcq.judged(frame, sources).collect()]


def test_judged(spark):
    good = {**GOOD, "options": ["3 m", "4 m", "2 m", "6 m"], "answer": "A", "topic_id": "c", "grade": 10}
    assert errors(spark, good) == [[]]
    cases = [
        ({"options": ["1/2", "0.5", "2", "3"], "correct_answer": None}, "two options of one value"), ({"options": ["3 m", "4 m", "2 m", "none of the above"]}, "an option leans on others"),
        ({"explanation": ""}, "no explanation of up to 600 characters"), ({"explanation": "x" * 601}, "no explanation of up to 600 characters"), ({"question": " "}, "no stem"),
        ({"options": None}, "not four different options"), ({"options": ["3 m", "3 M", "2", "1"]}, "not four different options"), ({"answer": "E"}, "no letter of an option as answer"),
        ({"answer": "B"}, "the stated value is another option"), ({"source_question_id": "p"}, "names a source, but none was retrieved"),
    ]
    got = errors(spark, *({**good, **change} for change, _ in cases))
    assert [want in found for (_, want), found in zip(cases, got)] == [True] * len(cases), list(zip(cases, got))
    assert errors(spark, good, blocked=F.array(F.lit(GOOD["question"]))) == [["repeats a blocked stem"]]


def test_sources(spark):
    good = {**GOOD, "options": ["3 m", "4 m", "2 m", "6 m"], "answer": "A", "topic_id": "c", "grade": 10, "source_question_id": "p"}
    source = lambda **x: spark.createDataFrame([({"question_id": "p", "concept_id": "c", "grade": 10, "question": "Something else entirely?", "canonical_answer": "3m"} | x)], "question_id string, concept_id string, grade int, question string, canonical_answer string")
    assert errors(spark, good, sources=source()) == [[]]
    assert errors(spark, {**good, "source_question_id": ""}, {**good, "source_question_id": "q"}, sources=source()) == [["names no source"], ["names an unknown source"]]
    assert errors(spark, good, sources=source(grade=11)) == [["source of another grade"]]
    assert errors(spark, good, sources=source(concept_id="d")) == [["source of another concept"]]
    assert errors(spark, good, sources=source(concept_id="")) == [[]]
    assert errors(spark, good, sources=source(question=GOOD["question"])) == [["copies its source"]]
    assert errors(spark, good, sources=source(canonical_answer="4 m")) == [["another answer than its source"]]


def test_challenge(spark):
    options = [["34 m", "36 m", "38 m", "1000 m"], ["34 m", "36 m", "38 m", "40 cm"], ["-1", "0", "1", "2"], ["1/4", "1/3", "1/2", "2/3"], ["a", "1", "2", "3"]]
    frame = spark.createDataFrame([("Define the perimeter of a square.", o) for o in options], "question string, options array<string>")
    got = [r["e"] for r in frame.select(mcq.reasons(*mcq.challenge_rules()).alias("e")).collect()]
    assert got == [["an option far from the others"], ["options of several units"], [], [], []]
    assert all("recall only" in r["e"] for r in frame.select(mcq.reasons(*mcq.challenge_rules(True)).alias("e")).collect())


def test_papers(spark):
    refs = [("a.md", 3, None, None, 10, "chunk", "v1")]
    columns = "topic_id string, index int, grade int, question string, options array<string>, answer string, explanation string, grounding_evidence string, source_refs " + mcq.REFS
    stems = {"a": "How many apples are in the red box?", "b": "Which of these numbers is a prime?"}
    paper = [(t, i, 10, s, ["3 m", "4 m", "2 m", "6 m"], "A", "Count them.", "eight words of evidence stand here for this", refs) for i, (t, s) in enumerate(stems.items())]
    catalogue = spark.createDataFrame([("a", 10), ("b", 10)], "topic_id string, grade int")
    frame = lambda rows: spark.createDataFrame(rows, columns)
    found = lambda rows: {(r["topic_id"], r["index"], r["error"]) for r in mcq.paper_errors(frame(rows), catalogue).collect()}
    assert found(paper) == set()
    mcq.check_paper(frame(paper), catalogue)
    assert found(paper[:1]) == {("b", None, "missing topic")}
    assert found([*paper, (paper[0][0], 2, *paper[0][2:])]) == {("a", None, "repeated topic"), ("a", 2, "repeats a blocked stem"), ("a", 2, "repeats a stem of the paper")}
    other = {"c" if r[0] == "a" else r[0]: r for r in paper}
    assert {("c", None, "unexpected topic"), ("a", None, "missing topic")} <= found([(t, *r[1:]) for t, r in other.items()])
    change = lambda place, value: [tuple(value if i == place else x for i, x in enumerate(paper[0])), paper[1]]
    assert ("a", 0, "another grade than the catalogue's") in found(change(2, 11))
    assert found(change(7, "too short")) == {("a", 0, "evidence is not of 8 to 40 words")}
    assert found(change(8, None)) == {("a", 0, "no source")}
    assert found(change(8, [("", 0, None, None, 11, " ", None)])) == {("a", 0, e) for e in ("a source of another grade", "a citation without file or pages", "a source without chunk", "a source without corpus version")}
    with pytest.raises(ValueError, match="missing topic"):
        mcq.check_paper(frame(paper[:1]), catalogue)


def test_table_function(spark):
    spark.udtf.register("parse_mcqs", mcq.parse_mcqs)
    spark.createDataFrame([(1, json.dumps([GOOD, {**GOOD, "grade": 9}])), (2, "nothing")], "id int, t string").createOrReplaceTempView("raw_answers")
    rows = spark.sql("SELECT id, place, answer, more FROM raw_answers, LATERAL parse_mcqs(t)").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "A", "{}"), (1, 1, "A", '{"grade": 9}')]


def test_limits_and_cooldown():
    time, calls = [0.0], []

    def provider(texts):
        calls.append(texts)
        if len(calls) == 2:
            raise Exhausted("no credit")
        return texts

    ask = limited(provider, 3, cooldown=10, clock=lambda: time[0])
    assert ask(["a"]) == ["a"]
    for _ in range(2):
        with pytest.raises(Exhausted):
            ask(["b"])
    time[0] = 11
    assert ask(["c"]) == ["c"] and len(calls) == 3
    with pytest.raises(Exhausted):
        ask(["d"])


def test_retries(spark):
    waits, calls = [], []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("gone")
        return texts

    assert retried(flaky, 3, 0.5, waits.append)(["a"]) == ["a"] and waits == [0.5, 1.0]
    with pytest.raises(Exhausted):
        retried(lambda t: (_ for _ in ()).throw(Exhausted("x")), 3, 0, waits.append)(["a"])
    assert len(waits) == 2
    frame = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    rows = complete(frame, lambda p: [x.upper() for x in p], attempts=2, wait=0, valid=lambda t: t == "GOOD").collect()
    assert {(r["prompt"], r["completion"], r["error"]) for r in rows} == {("good", "GOOD", None), ("bad", None, "the answer has another form")}


def test_budget_shared_by_all_tasks(spark, tmp_path):
    """As many calls as are allowed, over many tasks at once; a later job finds what is left, and all rest together."""
    made = str(tmp_path / "calls")

    def provider(texts):
        with open(made, "a") as f:
            f.write("x")
        return [t.upper() for t in texts]

    frame = spark.range(800).selectExpr("concat('p', id) AS prompt").repartition(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        limit = SharedLimit(provider, budget_folder(spark, tmp_path.name), 25)
        rows = complete(frame, limit, attempts=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(open(made).read()) == limit.used == 25
    assert sum(r["completion"] is not None for r in rows) == 125 and {r["error"] for r in rows if r["completion"] is None} == {"Exhausted: no calls left"}
    again = complete(frame.limit(3), SharedLimit(provider, limit.folder, 26), attempts=1).collect()
    assert all(r["completion"] for r in again) and len(open(made).read()) == 26
    limit.reset()
    now = [0.0]

    def broke(texts):
        raise Exhausted("no credit")

    one, other = (SharedLimit(p, limit.folder, 9, 10, lambda: now[0]) for p in (broke, provider))
    with pytest.raises(Exhausted, match="no credit"):
        one(["a"])
    with pytest.raises(Exhausted, match="cooling down"):
        other(["a"])
    now[0] = 11
    assert other(["a"]) == ["A"] and other.used == 2
    limit.reset()
