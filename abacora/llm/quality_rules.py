"""Operator 2: quality rules and n-gram perplexity bands.

Spark counts strings of three code points over all documents, per language found; the modified Kneser-Ney model of them
stays distributed, and prices come back to each input split by joins (as in operator 4), so what is gathered grows with the
input. Documents outside their language's perplexity band are rejected.

The band of a language is its documents' median log perplexity, plus and minus WIDTH times the distance from the median to
the 5 % quantile and SHORT over the square root of the length, since short texts scatter more. Both are set by the labels
of sf0.1 (README). Scoring looks strings up in arrays sorted by their hash.

Nulls: a null text has no words (it fails the base rule); a null lang is a language of its own; a null doc_id is carried
along. Repeated rows are judged one by one, a value at the band's edge is kept. Very long texts are counted and scored in
pieces. An empty table gives no rows; other columns are ignored (keep_good() keeps them as they are, whatever their names).
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import unsqueezed
from .common import fresh, materialise, scratch, table, words
from .quality_classifier import LANGUAGES, cogrouped, in_blocks, listed, model_of_counts
from .quality_classifier import _score_block as block_scores

WIDTH, SHORT = 1.5, 2.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SIGN = re.compile(r"[#*$%&|<>]")
_BLANK = " \t\n\x0b\x0c\r"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    w = words(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            again += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return len(w), sum(map(len, w)), len(SIGN.findall(text)), again, repeated_words(w)


def repeated_words(w: list[str], size: int = REPEAT_WINDOW) -> int:
    """Words in windows of `size` words that are found twice or more."""
    grams = list(zip(*(w[i:] for i in range(size))))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    covered, reach = 0, 0
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


_SCORES = "doc_id long, rid long, language string, n_chars long, log_ppl double, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _score_block(docs: pa.Table, prices: pa.Table) -> pa.Table:
    found = block_scores(docs, prices)
    bases = [base_counts(unsqueezed(body).decode()) for body in docs.column("body").to_pylist()]
    columns = [found.column(c) for c in ("doc_id", "rid", "lang", "n_chars", "log_ppl")]
    return pa.table([*columns, *(pa.array([b[i] for b in bases], pa.int64()) for i in range(5))], names=[c.split()[0] for c in _SCORES.split(", ")])


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, rid (a hash of the row), language, n_chars, log_ppl (null for an empty text), base counts."""
    rows = in_blocks(docs)
    lists = listed(rows)
    m = model_of_counts(lists.select("lang", "g", "n"))
    return cogrouped(rows, lists, m, _score_block, _SCORES)


def bands(scores: DataFrame) -> DataFrame:
    """language, middle, width: of its log perplexities, over all its documents that pass the base rule."""
    q = scores.where(~base_failed() & F.col("log_ppl").isNotNull()).groupBy("language").agg(F.percentile_approx("log_ppl", [0.05, 0.5], 20000).alias("q"))
    return q.select("language", F.col("q")[1].alias("middle"), (WIDTH * (F.col("q")[1] - F.col("q")[0])).alias("width"))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_verdict(scores: DataFrame, band: DataFrame) -> DataFrame:
    few = len(band.select("language").limit(LANGUAGES + 1).collect()) <= LANGUAGES
    away = F.abs(F.col("log_ppl") - F.col("middle")) <= F.col("width") + SHORT / F.sqrt("n_chars")
    joined = scores.join(F.broadcast(band) if few else band, "language", "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.when(F.col("middle").isNotNull(), F.coalesce(away, F.lit(False))).otherwise(True)).drop("middle", "width")


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> the counts, base_failed, perplexity and kept of every document."""
    with scratch():
        scores = materialise(scored(docs), "scores", stays=True)
    return with_verdict(scores, materialise(bands(scores), "bands")).withColumn("perplexity", F.exp("log_ppl"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that quality() keeps, all columns as they are."""
    key = fresh(docs, "rid")
    good = quality(docs.select("doc_id", "text", "lang")).where("kept").select(F.col("rid").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "lang", "text")).join(good, key, "left_semi").select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
