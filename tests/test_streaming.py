"""Streams drained once give what their batch twins give."""

import random

import pytest

from abacora.operators import sessions as B
from abacora.streaming import sessions as S


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(path)
    return path


def test_first_submissions(spark, folder):
    got = S.run_to_table(S.first_submissions(S.event_stream(spark, folder), ["event_id"]), "first_submissions")
    assert got.count() == spark.read.parquet(folder).select("event_id").distinct().count()


def test_rate_limit(spark, folder):
    got = S.run_to_table(S.over_rate(S.event_stream(spark, folder), 1, "1 hour"), "over_rate")
    want = B.over_rate(spark.read.parquet(folder), 1, "1 hour")
    a, b = ({tuple(r) for r in x.collect()} for x in (got, want))
    assert a <= b and len(b - a) <= len(b) // 10 + 5  # windows that the watermark has not closed yet are still open


def test_prefetch_states(spark, folder):
    got = S.run_to_table(S.prefetch_states(S.event_stream(spark, folder)), "prefetch", "update").toPandas()
    assert "stale" in set(got["status"])
    last = got[got["status"] != "stale"].sort_values("at").groupby("user_id").tail(1).set_index("user_id")["status"].to_dict()
    want = {r["user_id"]: r["last_status"] for r in B.last_status(spark.read.parquet(folder), "2024-02-01 00:00:00", 180).collect()}
    assert last == want


SPLIT = {"all": lambda b: b, "errors": lambda b: b.where("event_type = 'error'").select("event_id", "user_id")}


def test_fan_out_writes_every_row_once(spark, folder, tmp_path):
    source = S.event_stream(spark, folder)
    for _ in range(2):  # the second start finds nothing new
        S.fan_out(source, str(tmp_path / "cp"), str(tmp_path / "out"), SPLIT).awaitTermination()
    out, events = S.FanOut(spark, str(tmp_path / "out")), spark.read.parquet(folder)
    assert sorted(r["event_id"] for r in out.table("all").collect()) == sorted(r["event_id"] for r in events.collect())
    assert out.table("errors").count() == events.where("event_type = 'error'").count()


def test_fan_out_that_fails_between_tables_leaves_no_half_and_no_double(spark, folder, tmp_path):
    state = {"broken": True, "calls": 0}

    def errors(batch):
        state["calls"] += 1
        if state["broken"] and state["calls"] == 2:
            raise OSError("the second table of the second batch")
        return batch.where("event_type = 'error'").select("event_id", "user_id")

    start = lambda: S.fan_out(S.event_stream(spark, folder), str(tmp_path / "cp"), str(tmp_path / "out"), {"all": lambda b: b, "errors": errors})
    with pytest.raises(Exception, match="second table"):
        start().awaitTermination()
    out, events = S.FanOut(spark, str(tmp_path / "out")), spark.read.parquet(folder)
    assert out.table("all").select("batch").distinct().count() == 1
    # what a writer that died later left behind is written over
    events.limit(3).write.parquet(str(tmp_path / "out/all/batch=1"), mode="overwrite")
    assert out.table("all").select("batch").distinct().count() == 1
    state["broken"] = False
    start().awaitTermination()
    assert sorted(r["event_id"] for r in out.table("all").collect()) == sorted(r["event_id"] for r in events.collect())
    assert sorted(r["event_id"] for r in out.table("errors").collect()) == sorted(r["event_id"] for r in events.where("event_type = 'error'").collect())
    # and a batch that is brought again, though it is there, changes nothing
    assert out.write(0, {"all": events}) is False and out.table("all").count() == events.count()


def test_late_submits_equal_their_batch_twin(spark, tmp_path):
    rng = random.Random(4)
    begun, asked, lines = [], [], []
    for quiz in range(60):
        start = 1_700_000_000 + 3600 * quiz
        at, loaded = start + rng.randrange(1, 7200), rng.randrange(1, 6)
        answered = rng.randrange(loaded + 1)
        right = rng.randrange(answered + 1)
        begun.append((quiz, start, start + 3600))
        asked.append((quiz, at, loaded, answered, right))
        lines += [(quiz, i < answered, i < right, at) for i in range(loaded)]
    asked.append((999, 1_700_000_500, 1, 1, 1))  # of no quiz
    b = spark.createDataFrame(begun, "attempt_id long, s long, e long").selectExpr("attempt_id", "timestamp_seconds(s) started_at", "timestamp_seconds(e) expires_at")
    a = spark.createDataFrame(asked, "attempt_id long, s long, loaded long, answered long, right long").selectExpr("attempt_id", "timestamp_seconds(s) at", "loaded", "answered", "right")
    for name, frame in (("a", a), ("b", b)):
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    stream = lambda name, frame: spark.readStream.schema(frame.schema).parquet(str(tmp_path / name))
    got = S.run_to_table(S.late_submits(stream("a", a), stream("b", b)), "late_submits").drop("at")
    line = spark.createDataFrame(lines, "attempt_id long, answered boolean, right boolean, s long").selectExpr("attempt_id", "answered", "right", "timestamp_seconds(s) at")
    want = B.submitted(line, b.select("attempt_id", "expires_at"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60


def test_ingest_continues_where_it_was_cut(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "page long, text string")
    for i in range(4):
        pages.where(f"page % 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls = spark.sparkContext.accumulator(0)
    state = {"batch": 0, "broken": True}

    def embed(rows):
        state["batch"] += 1
        if state["broken"] and state["batch"] == 3:
            raise OSError("provider away")

        def work(frames):
            for pdf in frames:
                calls.add(len(pdf))
                yield pdf.assign(embedding=[[float(len(t))] for t in pdf["text"]])

        return rows.mapInPandas(work, "page long, text string, embedding array<double>").cache()

    start = lambda: S.ingest_pages(spark, str(tmp_path / "in"), "page long, text string", str(tmp_path / "cp"), str(tmp_path / "store"), "page", "text", embed, 1)
    with pytest.raises(Exception, match="provider away"):
        start().awaitTermination()
    state["broken"] = False
    start().awaitTermination()
    start().awaitTermination()
    from abacora.sources.store import current

    assert sorted(r["page"] for r in current(spark, str(tmp_path / "store"), "page").collect()) == list(range(12))
    assert calls.value == 12
