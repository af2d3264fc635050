import json

import pytest
from pyspark.sql import functions as F

from abacora.functions.text import file_grade
from abacora.sources import files, providers, store

GOOD = {"question_id": "q1", "question": "What is 1 + 1?", "concept_id": "c1", "concept_name": "sums", "grade": "10", "answer": "B", "solution": "two", "mapping_status": "verified", "reviewed_at": "2024-01-01T00:00:00Z"}


def test_bank_formats_agree(spark, tmp_path):
    options = ["1", "2", "3", "4"]
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1", "questions": [{**GOOD, "options": options}]}))
    (tmp_path / "b.jsonl").write_text(json.dumps({**GOOD, "options": options}) + "\n")
    (tmp_path / "c.csv").write_text("﻿" + ",".join([*GOOD, "options"]) + "\n" + ",".join([*GOOD.values(), "1|2|3|4"]) + "\n")
    (tmp_path / "d.csv").write_text(",".join([*GOOD, *(f"option_{x}" for x in "abcd")]) + "\n" + ",".join([*GOOD.values(), *options]) + "\n")
    got = [files.read_bank(spark, str(tmp_path / n)).withColumn("errors", files.bank_errors()).collect() for n in ("a.json", "b.jsonl", "c.csv", "d.csv")]
    assert all(len(g) == 1 and g[0]["errors"] == [] and g[0]["options"] == options for g in got)
    assert len({tuple(map(str, g[0])) for g in got}) == 1


def test_bad_records_say_why(spark, tmp_path):
    bad = {**GOOD, "mapping_status": "pending", "grade": "14", "reviewed_at": "2024-01-01T00:00:00", "options": ["1", "1", "2", "3"]}
    (tmp_path / "x.jsonl").write_text(json.dumps(bad) + "\n")
    errors = files.read_bank(spark, str(tmp_path / "x.jsonl")).select(files.bank_errors().alias("e")).first()["e"]
    assert errors == ["grade out of range", "four unique options are required", "mapping must be verified", "reviewed_at needs a time zone"]


def test_raw_and_versionless_files_are_refused(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps({"parts": {"one": {"questions": []}}}))
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": "0", "questions": [GOOD]}))
    for name in ("raw.json", "old.json"):
        with pytest.raises(ValueError):
            files.read_bank(spark, str(tmp_path / name))


def test_nested_dataset(spark, tmp_path):
    q = lambda i: {"question_id": i, "question_number": "1", "question_text": "t", "answers": ["a"]}
    (tmp_path / "n.json").write_text(json.dumps({"questions": [q("a")], "parts": {"p": {"questions": [q("b"), q("c")]}}}))
    assert {r["question_id"] for r in files.read_nested_dataset(spark, str(tmp_path / "n.json")).collect()} == {"a", "b", "c"}
    (tmp_path / "m.json").write_text(json.dumps({"parts": {"p": {"questions": [q("b"), q("b")]}}}))
    with pytest.raises(ValueError):
        files.read_nested_dataset(spark, str(tmp_path / "m.json"))


def test_pages_manifest_and_version(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "maths Gr 10.md").write_text("Heading\n\n\n\nbody  text " + "x" * 150)
    (tmp_path / "short.txt").write_text("short")
    (tmp_path / "other.bin").write_text("y" * 200)
    pages = files.read_pages(spark, str(tmp_path)).collect()
    assert [(p["grade"], p["text"][:18]) for p in pages] == [(10, "Heading\n\nbody text")]
    found = files.page_files(spark, str(tmp_path)).collect()
    assert len(found) == 2 and len(files.page_files(spark, str(tmp_path), (10,)).collect()) == 1
    m = files.manifest(spark, str(tmp_path))
    version = files.corpus_version(m)
    assert version == files.corpus_version(m.orderBy(F.desc("path"))) and len(version) == 64


def test_file_grades(spark):
    names = ["eGr6_x.pdf", "gr-7.md", "Grade 8 maths.txt", "G9.md", "grade_10.txt", "a gr11.md", "gr12.md", "plain.md"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(file_grade(F.col("n")).alias("g"))
    assert [r["g"] for r in df.collect()] == [6, 7, 8, 9, 10, 11, None, None]


def test_catalogue(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"grades": [{"grade": 10, "terms": [{"term": 1, "topics": [{"no": 1, "topic": "Sets", "competency_levels": ["1.1"], "periods": 3}]}]}]}))
    assert [tuple(r) for r in files.read_catalogue(spark, str(tmp_path / "t.json")).collect()] == [(10, 1, 1, "Sets", ["1.1"], 3)]


def test_upsert_resumes_and_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    rows = spark.createDataFrame([(i, f"text {i}", f"h{i}") for i in range(5)], "id long, text string, payload string")
    assert store.upsert(rows.where("id < 3"), path, "id", "payload", providers.embed) == 3
    assert store.upsert(rows, path, "id", "payload", providers.embed) == 2
    assert store.upsert(rows, path, "id", "payload", providers.embed) == 0
    changed = rows.where("id = 1").withColumn("payload", F.lit("new"))
    assert store.upsert(changed, path, "id", "payload", providers.embed) == 1
    now = store.current(spark, path, "id").collect()
    assert len(now) == 5 and {r["payload"] for r in now if r["id"] == 1} == {"new"}


def test_upsert_goes_back_to_an_earlier_payload(spark, tmp_path):
    path = f"file://{tmp_path}/aba"
    for n, payload in enumerate(("A", "B", "A", "A")):
        rows = spark.createDataFrame([(1, "text", payload), (2, "other", "x")], "id long, text string, payload string")
        assert store.upsert(rows, path, "id", "payload", providers.embed) == (2 if n == 0 else 0 if n == 3 else 1)
        assert {(r["id"], r["payload"]) for r in store.current(spark, path, "id").collect()} == {(1, payload), (2, "x")}


def test_upsert_keeps_its_contract(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    rows = spark.createDataFrame([(i, f"text {i}", f"h{i}") for i in range(4)], "id long, text string, payload string")
    put = lambda df, contract={"size": 64}: store.upsert(df, path, "id", "payload", providers.embed, contract, whole=True)  # noqa: B006, E731
    assert put(rows) == 4 and store.read_manifest(spark, f"{path}.contract.json") == {"contract": {"size": 64}, "status": "ready", "count": 4}
    with pytest.raises(ValueError, match="another contract"):
        put(rows, {"size": 32})
    assert put(rows.where("id > 1")) == 0  # the others are gone
    assert {r["id"] for r in store.current(spark, path, "id").collect()} == {2, 3}
    assert put(rows) == 2 and store.current(spark, path, "id").count() == 4
    with pytest.raises(RuntimeError, match="of 4 rows"):
        store.upsert(rows.withColumn("payload", F.lit("new")), path, "id", "payload", lambda df: providers.embed(df).where("id <> 1"), {"size": 64})
    assert store.read_manifest(spark, f"{path}.contract.json")["status"] == "building"
    plain = f"file://{tmp_path}/plain"
    store.upsert(rows, plain, "id", "payload", providers.embed)
    with pytest.raises(ValueError, match="no contract"):
        store.upsert(rows, plain, "id", "payload", providers.embed, {"size": 64})


def test_replacement_that_broke_off_is_settled(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.replace(spark.range(5), path)
    (tmp_path / "t").rename(tmp_path / "t.123.before")
    store.settle(spark, path)
    assert spark.read.parquet(path).count() == 5
    store.replace(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_vectors_are_checked_before_they_are_copied(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    good = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert store.copy_vectors(good, path, 2) == 1
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None):
        with pytest.raises(ValueError):
            store.copy_vectors(spark.createDataFrame([(1, bad)], "id long, embedding array<double>"), path, 2)
    assert spark.read.parquet(path).count() == 1


def test_records_are_loaded(spark, tmp_path):
    store.write_records(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long"), f"file://{tmp_path}/r")
    assert {(r["k"], r["n"]) for r in store.load_records(spark, f"file://{tmp_path}/r", "k string, n long", "k").collect()} == {("a", 3), ("b", 2)}
    (tmp_path / "bad.json").write_text("{\"k\": \n")
    with pytest.raises(ValueError):
        store.load_records(spark, f"file://{tmp_path}/bad.json", "k string, n long", "k")
    assert "MAX(id)" in store.Jdbc.sequence_reset("users")


def test_moved_files_change_the_version(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("same")
    before = files.corpus_version(files.manifest(spark, str(tmp_path)))
    assert [r["name"] for r in files.manifest(spark, str(tmp_path)).collect()] == ["a/x.txt"]
    (tmp_path / "a").rename(tmp_path / "b")
    assert files.corpus_version(files.manifest(spark, str(tmp_path))) != before


def test_ingest_skips_when_ready(spark, tmp_path):
    path, calls = f"file://{tmp_path}/manifest.json", []
    assert store.ingest(spark, path, "v1", lambda: calls.append(1)) == "built"
    assert store.ingest(spark, path, "v1", lambda: calls.append(1)) == "skipped"
    assert store.ingest(spark, path, "v2", lambda: calls.append(1)) == "built"
    assert len(calls) == 2 and store.read_manifest(spark, path)["status"] == "ready"


def test_replace_is_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.replace(spark.range(5).withColumn("grade", F.lit(10)), path, "grade")
    store.replace(spark.range(3).withColumn("grade", F.lit(11)), path, "grade")
    assert spark.read.parquet(path).count() == 3


def test_provider_contract():
    assert providers.checked([[3, 4, 0]], 1, 3) == [[0.6, 0.8, 0.0]]
    for bad in ([], [1, 2], [[1, 2], [3, 4]], [0, 0, 0], [float("nan"), 1, 1], [float("inf"), 1, 1], [True, 1, 1], ["1", 1, 1]):
        with pytest.raises(ValueError):
            providers.checked([bad], 1, 3)
    with pytest.raises(ValueError):
        providers.checked([], 1, 3)


def test_pdf_pages_by_a_reader(spark, tmp_path):
    (tmp_path / "book gr9.pdf").write_bytes(b"one|" + b"x" * 200)
    rows = files.read_pdf_pages(spark, str(tmp_path), lambda data: data.decode().split("|")).collect()
    assert [(r["source"], r["page"], r["grade"], len(r["text"])) for r in rows] == [("book gr9.pdf", 1, 9, 200)]


def test_commands(spark, tmp_path, capsys):
    from abacora import cli

    bank = tmp_path / "bank.jsonl"
    rows = [{**GOOD, "options": ["1", "2", "3", "4"]}, {**GOOD, "question_id": "q2", "options": ["1", "2", "3", "4"]}]
    bank.write_text("\n".join(map(json.dumps, rows)))
    target = f"file://{tmp_path}/bank"
    assert cli.main(["import-question-bank", str(bank), target]) == 0 and spark.read.parquet(target).count() == 2
    assert cli.main(["build-question-pool", target, f"file://{tmp_path}/pool"]) == 0 and spark.read.parquet(f"file://{tmp_path}/pool").count() == 1
    bank.write_text(json.dumps({**rows[0], "grade": "3"}))
    assert cli.main(["validate-question-bank", str(bank)]) == 1 and cli.main(["import-question-bank", str(bank), target]) == 1
    assert spark.read.parquet(target).count() == 2
    (tmp_path / "said.txt").write_text(json.dumps([{"question": "How many legs has an ant?", "options": ["6", "8", "4", "2"], "correct_answer": "6", "explanation": "Insects."}]))
    assert cli.main(["generate", str(tmp_path / "said.txt"), f"file://{tmp_path}/made"]) == 0 and spark.read.json(f"file://{tmp_path}/made").count() == 1
    (tmp_path / "done.jsonl").write_text('{"item_id": 3, "is_correct": true}')
    assert cli.main(["record", "7", str(tmp_path / "done.jsonl"), f"file://{tmp_path}/attempts"]) == 0
    assert [tuple(r)[:2] for r in spark.read.parquet(f"file://{tmp_path}/attempts").select("user_id", "item_id").collect()] == [(7, 3)]
    assert cli.main(["check-embeddings"]) == 0 and cli.main(["generate-template"]) == 0
    assert "schema_version" in capsys.readouterr().out
