"""The engine's views over the driver's tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2024-01-30"
SEED = "survey-seed"

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

SQL = {
    "v_item": """SELECT p_partkey AS item_id, p_brand AS topic_id, p_name AS topic_name, 6 + p_size % 6 AS grade, 1 + p_size % 6 AS level,
        CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'S' || CAST(p_partkey % 40 AS VARCHAR) END AS source_id,
        sha256(p_name || '|' || CAST(p_partkey AS VARCHAR)) AS item_hash, p_size % 7 <> 0 AS eligible, p_size % 11 <> 0 AS active FROM part""",
    "v_attempt": """SELECT o_orderkey AS attempt_id, o_custkey AS user_id, o_orderdate AS created_at,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'diagnostic' ELSE 'practice' END AS quiz_kind FROM orders""",
    "v_answer": f"""SELECT l_orderkey AS attempt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS question_index,
        item_id, topic_id, topic_name, grade, level, source_id, item_hash, l_returnflag <> 'R' AS is_correct FROM lineitem JOIN v_item ON l_partkey = item_id""",
    "v_exposure": "SELECT DISTINCT user_id, item_id FROM v_attempt JOIN v_answer USING (attempt_id)",
    "v_score": """SELECT attempt_id, user_id, created_at, count(*) AS total, CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS correct,
        round(100.0 * sum(CASE WHEN is_correct THEN 1 ELSE 0 END) / count(*), 6) AS score FROM v_attempt JOIN v_answer USING (attempt_id) GROUP BY attempt_id, user_id, created_at""",
    "v_question": """SELECT p_partkey AS question_id, p_brand AS topic_id, CAST(6 + p_size % 6 AS INTEGER) AS grade,
        CASE WHEN p_size % 9 = 0 THEN '  ' WHEN p_size % 9 = 1 THEN 'Define a ' || p_name || '.' ELSE 'How many ' || p_name || 's are in box ' || CAST(p_partkey AS VARCHAR) || '?' END AS question,
        [CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR), CASE WHEN p_partkey % 13 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 29 = 0 THEN ' ' ELSE CAST(p_size + 2 AS VARCHAR) END,
         CASE WHEN p_partkey % 17 = 0 THEN 'None of the above' WHEN p_partkey % 19 = 0 THEN CAST(p_size + 90 AS VARCHAR) WHEN p_partkey % 23 = 0 THEN CAST(p_size + 3 AS VARCHAR) || ' cm' ELSE CAST(p_size + 3 AS VARCHAR) END] AS options,
        CASE WHEN p_partkey % 5 = 4 THEN 'E' ELSE substr('abcd', CAST(1 + p_partkey % 4 AS INTEGER), 1) END AS answer,
        CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN repeat('x', 601) WHEN p_partkey % 37 = 0 THEN 'Let me <THINK>' ELSE 'Count them all.' END AS explanation FROM part""",
    "v_activity": "SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day, event_type, value, props FROM events",
}


def with_views(sql: str) -> str:
    """Puts the definitions of the views that a query names before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(SQL[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Views:
    """Views of one data folder; frames are lazy and cost nothing until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def item(self) -> DataFrame:
        c = F.col
        return self.table("part").select(
            c("p_partkey").alias("item_id"), c("p_brand").alias("topic_id"), c("p_name").alias("topic_name"), (6 + c("p_size") % 6).alias("grade"), (1 + c("p_size") % 6).alias("level"),
            F.when(c("p_size") % 5 != 0, F.concat(F.lit("S"), (c("p_partkey") % 40).cast("string"))).alias("source_id"),
            F.sha2(F.concat_ws("|", "p_name", c("p_partkey").cast("string")), 256).alias("item_hash"), (c("p_size") % 7 != 0).alias("eligible"), (c("p_size") % 11 != 0).alias("active"),
        )

    @property
    def attempt(self) -> DataFrame:
        kind = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "diagnostic").otherwise("practice")
        return self.table("orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), kind.alias("quiz_kind"))

    @property
    def answer(self) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy(*_LINE.split(", "))
        numbered = self.table("lineitem").withColumn("question_index", F.row_number().over(w))
        rows = numbered.select(F.col("l_orderkey").alias("attempt_id"), "question_index", F.col("l_partkey").alias("item_id"), (F.col("l_returnflag") != "R").alias("is_correct"))
        return rows.join(self.item.select("item_id", "topic_id", "topic_name", "grade", "level", "source_id", "item_hash"), "item_id")

    @property
    def answer_unnumbered(self) -> DataFrame:
        """The same without question_index, which costs a sort of all answers."""
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("item_id"), (F.col("l_returnflag") != "R").alias("is_correct"))
        return rows.join(self.item.select("item_id", "topic_id", "topic_name", "grade", "level", "source_id", "item_hash"), "item_id")

    @property
    def exposure(self) -> DataFrame:
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("item_id"))
        known = rows.join(self.table("part").select(F.col("p_partkey").alias("item_id")), "item_id", "left_semi")
        return self.attempt.select("attempt_id", "user_id").join(known, "attempt_id").select("user_id", "item_id").distinct()

    @property
    def score(self) -> DataFrame:
        from .operators.mastery import score_attempts

        return score_attempts(self.attempt, self.answer_unnumbered)

    @property
    def question(self) -> DataFrame:
        """Generated questions of all kinds, good and bad."""
        size, part = F.col("p_size"), F.col("p_partkey")
        text = lambda c: c.cast("string")
        stem = F.when(size % 9 == 0, "  ").when(size % 9 == 1, F.concat(F.lit("Define a "), "p_name", F.lit("."))).otherwise(F.concat(F.lit("How many "), "p_name", F.lit("s are in box "), text(part), F.lit("?")))
        third = F.when(part % 13 == 0, text(size)).when(part % 29 == 0, " ").otherwise(text(size + 2))
        fourth = F.when(part % 17 == 0, "None of the above").when(part % 19 == 0, text(size + 90)).when(part % 23 == 0, F.concat(text(size + 3), F.lit(" cm"))).otherwise(text(size + 3))
        answer = F.when(part % 5 == 4, "E").otherwise(F.substr(F.lit("abcd"), (1 + part % 4).cast("int"), F.lit(1)))
        explanation = F.when(part % 11 == 0, "").when(part % 31 == 0, F.repeat(F.lit("x"), 601)).when(part % 37 == 0, "Let me <THINK>").otherwise("Count them all.")
        return self.table("part").select(
            part.alias("question_id"), F.col("p_brand").alias("topic_id"), (6 + size % 6).cast("int").alias("grade"), stem.alias("question"),
            F.array(text(size), text(size + 1), third, fourth).alias("options"), answer.alias("answer"), explanation.alias("explanation"),
        )

    @property
    def activity(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), "event_type", "value", "props")
