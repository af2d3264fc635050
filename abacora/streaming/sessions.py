"""Streaming forms of the session operators; each has a batch twin in abacora.operators.sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import exists, upsert, write_manifest


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of a parquet folder as a stream; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def first_submissions(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Exactly one event of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def over_rate(events: DataFrame, limit: int, length: str, delay: str = "1 hour") -> DataFrame:
    """Closed windows in which a user was over the limit."""
    counted = events.withWatermark("ts", delay).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select("user_id", F.col("w.start").alias("start"), "n")


def prefetch_states(events: DataFrame, stale_after: int = 180) -> DataFrame:
    """Each user's last status; a user silent for `stale_after` seconds of event time is reported as stale."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "status": ["stale"], "at": [pd.Timestamp(at, unit="ms")]})
            return
        status, at = state.get if state.exists else ("idle", 0)
        for f in frames:
            last = f.sort_values(["ts", "event_id"]).iloc[-1]
            stamp = int(last["ts"].timestamp() * 1000)
            if stamp >= at:
                status, at = str(last["event_type"]), stamp
        state.update((status, at))
        state.setTimeoutTimestamp(max(at + 1000 * stale_after, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "at": [pd.Timestamp(at, unit="ms")]})

    watched = events.withWatermark("ts", "10 minutes")
    return watched.groupBy("user_id").applyInPandasWithState(step, "user_id long, status string, at timestamp", "status string, at long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drains what is there now into an in-memory table (for tests and small jobs)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class FanOut:
    """Micro-batches written to several tables, all or nothing and once only.

    A batch's rows of every table go to a folder named after the batch, and one small record, renamed into place, then makes
    them part of the tables. A batch that failed between two tables has no record, so nothing of it shows; when the stream
    starts again it brings the same batch, whose folders are written over. A batch that has its record is left alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _record(self, batch: int) -> str:
        return f"{self.path}/_batches/{batch:012d}.json"

    def write(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """False where the batch was there before."""
        if exists(self.spark, self._record(batch)):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        write_manifest(self.spark, self._record(batch), {"tables": {name: rows.schema.simpleString() for name, rows in tables.items()}})
        return True

    def table(self, name: str) -> DataFrame:
        """The rows of a table in all batches that have their record, with the batch beside them."""
        records = self.spark.read.schema("tables map<string,string>").json(f"{self.path}/_batches/*.json").select("tables", F.col("_metadata.file_name").alias("file"))
        there = records.where(F.array_contains(F.map_keys("tables"), name)).select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("batch")).collect()  # a number for each batch
        folders = [f"{self.path}/{name}/batch={r['batch']}" for r in there]  # folders without a record are never opened
        return self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/{name}").parquet(*folders)


def fan_out(stream: DataFrame, checkpoint: str, path: str, tables: dict):
    """Every micro-batch scored once and written to several tables below `path`, each a function of the frame; replayed
    batches change nothing (see FanOut)."""
    out = FanOut(stream.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            out.write(number, {name: made(batch) for name, made in tables.items()})
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_submits(questions: DataFrame, expiry: DataFrame, delay: str = "1 hour", longest: str = "60 days", grace: str = "30 days") -> DataFrame:
    """Submissions (attempt_id, at, loaded, answered, right) meet their quiz (attempt_id, started_at, expires_at) in the
    interval from its start to `grace` behind its latest end; watermarks on both sides let Spark forget what can no longer meet.
    Answers by the rule of operators.sessions.submitted(): late ones are accepted with gaps.
    """
    asked = questions.withWatermark("at", delay)
    begun = expiry.withColumnRenamed("attempt_id", "quiz").withWatermark("started_at", delay)
    met = asked.join(begun, F.expr(f"attempt_id = quiz and at >= started_at and at <= started_at + interval {longest} + interval {grace}"))
    late = F.col("at") > F.col("expires_at")
    return met.select("attempt_id", "at", "loaded", "answered", F.col("right").alias("correct"), (F.col("loaded") - F.col("right")).alias("incorrect"), late.alias("timed_out"), ((F.col("answered") == F.col("loaded")) | late).alias("accepted"))


def ingest_pages(spark: SparkSession, folder: str, schema: str, checkpoint: str, path: str, key: str, payload: str, embed, files_per_batch: int = 100):
    """Pages that arrive in a folder go into an upsert() store, each file once: the checkpoint knows which files are done,
    and a batch that was cut short is brought again, of which the upsert asks for the missing rows only."""
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*batch.columns)).alias("r")).select("r.*")
        upsert(rows, path, key, payload, embed)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
