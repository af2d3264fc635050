"""File sources: textbook pages, manifests, catalogues, question banks and nested datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_lines, file_grade

SUFFIXES = ("md", "txt")
#: Columns of a bank record and the names they are read from, first that is not empty wins. Fixed values.
ALIASES = {
    "question_id": ("question_id", "id"),
    "question": ("question", "question_text", "stem"),
    "concept_id": ("concept_id", "topic_id"),
    "concept_name": ("concept_name", "topic"),
    "grade": ("grade",),
    "answer": ("answer", "correct_option"),
    "solution": ("solution", "explanation"),
    "mapping_status": ("mapping_status",),
    "reviewed_at": ("reviewed_at",),
}


def page_files(spark: SparkSession, folder: str, grades: tuple[int, ...] = ()) -> DataFrame:
    """Files below a folder with a known suffix (of some grades), path and size, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder).select("path", "length")
    grade = file_grade(F.element_at(F.split("path", "/"), -1)).alias("grade")
    found = found.select("path", "length", grade).distinct()
    return (found.where(F.col("grade").isin(list(grades))) if grades else found).orderBy(F.lower("path"))


def read_pages(spark: SparkSession, folder: str, least: int = 120) -> DataFrame:
    """Text files as cleaned pages (source, page, grade, text); pages below `least` characters are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").text(folder, wholetext=True)
    name = F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))
    pages = raw.select(name.alias("source"), F.posexplode(F.split("value", "\f")).alias("page", "text"))
    return pages.select("source", "page", file_grade(F.col("source")).alias("grade"), clean_lines(F.col("text")).alias("text")).where(F.length("text") >= least)


def _pdf_texts(data: bytes) -> list[str]:
    """The text of each page of a PDF, by the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ImportError("reading PDF files needs the package pypdf, or a reader of your own") from missing
    import io

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def read_pdf_pages(spark: SparkSession, folder: str, reader: Callable[[bytes], list[str]] = _pdf_texts, least: int = 120) -> DataFrame:
    """S1 for PDF files: as read_pages(); reader turns a file's bytes into the texts of its pages, one file at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                texts = reader(bytes(content))
                yield pd.DataFrame({"source": path.rsplit("/", 1)[-1], "page": range(len(texts)), "text": texts}).astype({"page": "int32"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")
    pages = raw.mapInPandas(run, "source string, page int, text string")
    return pages.select("source", "page", file_grade(F.col("source")).alias("grade"), clean_lines(F.col("text")).alias("text")).where(F.length("text") >= least)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """S3: path, name (the path below the folder), size and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    base = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return files.select("path", F.substr("path", F.lit(len(base) + 2)).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def multiset_digest(row: Column, *, parts: int = 5) -> Column:
    """An aggregate over hexadecimal sha256 digests that does not depend on their order: sums of their pieces, hashed. It is
    summed where rows lie, so no task sees all of them."""
    sums = [F.sum(F.conv(F.substring(row, 12 * i + 1, 12), 16, 10).cast("decimal(20, 0)")).cast("string") for i in range(parts)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256)


def corpus_version(files: DataFrame) -> str:
    """A digest of a manifest (name, size, sha256) that does not depend on the order of files."""
    row = F.sha2(F.concat_ws("|", "name", "size", "sha256"), 256)
    return files.select(row.alias("d")).agg(multiset_digest(F.col("d")).alias("v")).first()["v"]


CATALOGUE = "grades array<struct<grade: int, terms: array<struct<term: int, topics: array<struct<no: int, topic: string, competency_levels: array<string>, periods: int>>>>>>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The nested curriculum as rows: grade, term, no, topic, competency_levels, periods."""
    grades = spark.read.schema(CATALOGUE).option("multiLine", "true").json(path).select(F.inline("grades"))
    return grades.select("grade", F.inline("terms")).select("grade", "term", F.inline("topics"))


def _either(columns: list[str], names: tuple[str, ...]) -> Column:
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def options(columns: list[str]) -> Column:
    """Four options from an array, a JSON string, a text with bars, or four columns."""
    empty = F.lit(None).cast("array<string>")
    text = F.col("options").cast("string") if "options" in columns else F.lit(None).cast("string")
    parts = [F.from_json(text, "array<string>"), F.when(text.contains("|"), F.split(text, r"\|"))]
    letters = [f"option_{x}" for x in "abcd"]
    if all(c in columns for c in letters):
        parts.append(F.when(F.col("option_a").isNotNull(), F.array(*letters)))
    return F.transform(F.coalesce(*parts, empty), lambda x: F.trim(x))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Question records of CSV, JSONL or JSON files (an array, or an object with schema_version "1" and questions)."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", "true").option("encoding", "UTF-8").option("multiLine", "true").option("escape", '"').csv(path)
        rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    elif path.endswith(".jsonl"):
        rows = spark.read.option("primitivesAsString", "true").json(path)
    else:
        rows = spark.read.option("primitivesAsString", "true").option("multiLine", "true").json(path)
        if "parts" in rows.columns:
            raise ValueError("a raw dataset must be reviewed before it is a bank file")
        if "questions" in rows.columns:
            if rows.where("coalesce(schema_version, '') <> '1'").take(1):
                raise ValueError("unsupported schema_version")
            rows = rows.select(F.inline("questions"))
    if "options" in rows.columns and isinstance(rows.schema["options"].dataType, T.ArrayType):
        rows = rows.withColumn("options", F.to_json("options"))
    return rows.select(*(_either(rows.columns, names).alias(c) for c, names in ALIASES.items()), options(rows.columns).alias("options"))


def bank_errors() -> Column:
    """P10: what is wrong with a record; an empty array accepts it."""
    o = F.col("options")
    rules = [
        (~F.coalesce(F.col("question_id"), F.lit("")).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"), "invalid question_id"),
        (~F.coalesce(F.col("grade").try_cast("int").between(6, 11), F.lit(False)), "grade out of range"),
        (F.length(F.coalesce("question", F.lit(""))) == 0, "empty question"),
        (F.coalesce(F.size(F.array_distinct(F.transform(o, lambda x: F.lower(x)))) != 4, F.lit(True)) | F.coalesce(F.size(o) != 4, F.lit(True)), "four unique options are required"),
        (~F.coalesce(F.upper("answer").isin("A", "B", "C", "D"), F.lit(False)), "answer must be A to D"),
        (F.coalesce(F.col("mapping_status"), F.lit("")) != "verified", "mapping must be verified"),
        (~F.coalesce(F.col("reviewed_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp("reviewed_at").isNotNull(), F.lit(False)), "reviewed_at needs a time zone"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in rules)))


def catalogue_verdicts(bank: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Records (ord, question_id, question, concept_id, concept_name, grade, competency_level) against a catalogue
    (concept_id, name, grade, competency_levels) -> question_id, ord, verdict: the first thing that is wrong, else "valid".

    Of an id that repeats the first record counts, and of a text that repeats among those.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    numbered = bank.withColumn("_id", first("question_id")).withColumn("_text", norm(F.col("question")))
    texts = numbered.withColumn("_nth", F.when(F.col("_id") == 1, first("_text", F.col("_id") == 1)))
    known = catalogue.select("concept_id", norm(F.col("name")).alias("_name"), F.col("grade").alias("_grade"), "competency_levels", F.lit(True).alias("_known"))
    level = F.coalesce("competency_level", F.lit(""))
    verdict = (
        F.when(F.col("_id") > 1, "duplicate question_id").when(F.col("_nth") > 1, "duplicate text").when(F.col("_known").isNull(), "unknown concept_id")
        .when(~F.coalesce(F.col("grade").cast("int") == F.col("_grade"), F.lit(False)), "another grade than the concept's").when(norm(F.col("concept_name")) != F.col("_name"), "another name than the concept's")
        .when((level != "") & (F.size("competency_levels") > 0) & ~F.array_contains("competency_levels", level), "a level that the concept does not have").otherwise("valid")
    )
    return texts.join(known, "concept_id", "left").select("question_id", "ord", verdict.alias("verdict"))


def read_nested_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a nested dataset, at the top or in its parts; ids must be unique."""
    item = "struct<question_id: string, question_number: string, question_text: string, answers: array<string>>"
    text = spark.read.text(path, wholetext=True)
    data = text.select(F.from_json("value", f"struct<questions: array<{item}>, parts: map<string, struct<questions: array<{item}>>>>").alias("d"))
    top = data.select(F.lit(None).cast("string").alias("part"), F.inline("d.questions"))
    parts = data.select(F.explode("d.parts").alias("part", "body")).select("part", F.inline("body.questions"))
    rows = top.union(parts)
    if rows.groupBy("question_id").count().where("count > 1").take(1):
        raise ValueError("a question_id occurs twice")
    return rows
