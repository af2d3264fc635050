"""Commands over the pipelines of api.py; see --help of each."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import mcq
from .session import build
from .sources import files, providers, store
from .views import Views

TEMPLATE = {"schema_version": "1", "questions": [{"question_id": "q1", "question": "", "concept_id": "", "concept_name": "", "grade": "10", "options": ["", "", "", ""], "answer": "A", "solution": "", "mapping_status": "pending", "reviewed_at": ""}]}


def _refused(bank, most: int = 20) -> int:
    """Shows what is wrong with the records of a bank; how many are."""
    bad = bank.withColumn("errors", files.bank_errors()).where(F.size("errors") > 0)
    bad.select("question_id", "errors").show(most, truncate=False)
    return bad.count()


def ingest(spark: SparkSession, a) -> int:
    print(api.ingest(spark, a.folder, a.target, force=a.force))
    return 0


def check_index(spark: SparkSession, a) -> int:
    found = api.index_status(spark, a.target, tuple(range(6, 12)))
    print(found)
    return int(found["status"] != "ready")


def check_embeddings(spark: SparkSession, a) -> int:
    vector = providers.checked(providers.hashed_embedding(["check"], a.size), 1, a.size)[0]
    print(f"{len(vector)} dimensions, length {sum(x * x for x in vector) ** 0.5:.6f}")
    return 0


def validate_question_bank(spark: SparkSession, a) -> int:
    return int(_refused(files.read_bank(spark, a.path)) > 0)


def import_question_bank(spark: SparkSession, a) -> int:
    bank = files.read_bank(spark, a.path)
    if n := _refused(bank):
        print(f"{n} records refused, nothing imported")
        return 1
    store.replace(bank, a.target)
    print(f"{spark.read.parquet(a.target).count()} records")
    return 0


def generate_template(spark: SparkSession, a) -> int:
    print(json.dumps(TEMPLATE, indent=2))
    return 0


def generate(spark: SparkSession, a) -> int:
    """Model answers (text files) -> judged questions, written as JSON lines; rejected ones with their reasons."""
    spark.udtf.register("parse_mcqs", mcq.parse_mcqs)
    spark.read.text(a.answers, wholetext=True).createOrReplaceTempView("model_answers")
    found = mcq.judged(spark.sql("SELECT q.* FROM model_answers, LATERAL parse_mcqs(value) q"))
    store.write_records(found, a.target)
    done = spark.read.json(a.target) if found.take(1) else found
    done.groupBy((F.size("errors") == 0).alias("accepted")).count().show()
    return 0


def build_question_pool(spark: SparkSession, a) -> int:
    """The accepted records of an imported bank, one of each text, by concept."""
    bank = spark.read.parquet(a.bank)
    one = bank.groupBy(F.lower(F.trim("question")).alias("_text"), "concept_id").agg(F.min_by(F.struct(*bank.columns), "question_id").alias("r")).select("r.*")
    store.replace(one.where(F.size(files.bank_errors()) == 0), a.target, "concept_id")
    spark.read.parquet(a.target).groupBy("concept_id").count().orderBy("concept_id").show(100, truncate=False)
    return 0


def question_pool_status(spark: SparkSession, a) -> int:
    from .plans.catalog import QUERIES

    QUERIES["bucket_gap_report"](spark, a.data).where("short").orderBy("topic_id", "level").show(50)
    return 0


def record(spark: SparkSession, a) -> int:
    """Appends a user's answers (JSON lines: item_id, is_correct) to a table of attempts."""
    rows = spark.read.schema("item_id long, is_correct boolean").json(a.answers)
    if rows.where("item_id is null or is_correct is null").take(1):
        print("an answer lacks item_id or is_correct")
        return 1
    rows.withColumns({"user_id": F.lit(int(a.user)), "recorded_at": F.current_timestamp()}).write.mode("append").parquet(a.target)
    return 0


def recommend(spark: SparkSession, a) -> int:
    v = Views(spark, a.data)
    api.recommend(v.attempt, v.answer_unnumbered, int(a.user)).show(truncate=False)
    return 0


COMMANDS = {
    "ingest": (ingest, "folder", "target"), "check-index": (check_index, "target"), "check-embeddings": (check_embeddings,), "validate-question-bank": (validate_question_bank, "path"),
    "import-question-bank": (import_question_bank, "path", "target"), "generate-template": (generate_template,), "generate": (generate, "answers", "target"), "build-question-pool": (build_question_pool, "bank", "target"),
    "question-pool-status": (question_pool_status, "data"), "record": (record, "user", "answers", "target"), "recommend": (recommend, "data", "user"),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="abacora", description=__doc__)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (work, *arguments) in COMMANDS.items():
        c = sub.add_parser(name, help=(work.__doc__ or "").partition(";")[0] or None)
        for a in arguments:
            c.add_argument(a)
    sub.choices["ingest"].add_argument("--force", action="store_true")
    sub.choices["check-embeddings"].add_argument("--size", type=int, default=64)
    a = p.parse_args(argv)
    return COMMANDS[a.command][0](build(master=a.master), a)


if __name__ == "__main__":
    raise SystemExit(main())
