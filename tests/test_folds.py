"""State machines: the batch form against plain Python, the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from abacora.operators import sessions as B
from abacora.streaming import folds, machines
from abacora.streaming import sessions as S


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def plain(machine, rows, until=None):
    """(key, answers) by running each key's sorted rows."""
    out, by_key = [], {}
    for r in rows:
        by_key.setdefault(r[machine.key], []).append(r)
    for key, own in by_key.items():
        state = machine.start()
        answers = [a for r in sorted(own, key=lambda r: (r["ms"], r["event_id"])) for a in machine.feed(state, r)]
        if until is not None:
            answers += machine.up_to(state, until)
        out += [(key, *(a.get(c) for c in machine.columns())) for a in answers]
    return sorted(out, key=str)


def collected(frame, machine):
    return sorted((tuple(r[c] for c in (machine.key, *machine.columns())) for r in frame.collect()), key=str)


def rows_of(rng, n, keys, gap, **columns):
    out, ms = [], 1_700_000_000_000
    for i in range(n):
        ms += rng.randrange(gap) * 1000
        out.append({"ms": ms, "event_id": i, "key": rng.randrange(keys)} | {c: rng.choice(v) for c, v in columns.items()})
    return out


STATUSES = ["queued", "preparing", "ready", "complete", "failed", "idle", "stale"]
CASES = {
    "prefetch": (machines.Prefetch("key"), rows_of(random.Random(1), 400, 12, 40, status=STATUSES), "status string"),
    "reveal": (machines.Reveal("key"), rows_of(random.Random(2), 900, 6, 20, kind=["open"] + ["answer"] * 14 + ["next"] * 4 + ["submit"], index=[None, 0, 1, 2, 3, 4, 5, 5, 10, 12, 40], answer=["A", "B", "x", None], target=[3, 5, 12]), "kind string, index long, answer string, target long"),
    "limits": (machines.SlidingLimits("key"), rows_of(random.Random(3), 500, 3, 12), ""),
    "lockout": (machines.Lockout("key"), rows_of(random.Random(4), 300, 3, 50, kind=["error"] * 5 + ["purchase", "view"]), "kind string"),
    "tokens": (machines.SingleUse("key", 60), rows_of(random.Random(5), 300, 20, 9, kind=["issue", "consume", "consume"]), "kind string"),
}


def frame_of(spark, rows, kind):
    head = "ms long, event_id long, key long" + (f", {kind}" if kind else "")
    names = [part.split()[0] for part in head.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], head)


@pytest.mark.parametrize("name", sorted(CASES))
def test_batch(spark, name):
    machine, rows, kind = CASES[name]
    until = rows[-1]["ms"] + 10**6
    got = folds.fold_batch(frame_of(spark, rows, kind).repartition(3), machine, until)
    assert collected(got, machine) == plain(machine, rows, until)


@pytest.mark.parametrize("name", sorted(CASES))
def test_stream_equals_batch(rocks, tmp_path, name):
    """Micro-batches of a few rows; a last row far ahead moves the watermark, so all timers before it go off."""
    machine, rows, kind = CASES[name]
    rows = rows[:160]
    last = {**rows[-1], "ms": rows[-1]["ms"] + 10**7, "event_id": 10**6, "key": 999}
    after = {**last, "ms": last["ms"] + 1, "event_id": 10**6 + 1}
    path = str(tmp_path / "in")
    for at in range(0, 160, 40):
        frame_of(rocks, rows[at : at + 40], kind).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(path)
    for r in (last, after):
        frame_of(rocks, [r], kind).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(path)
    source = rocks.readStream.schema(rocks.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = S.run_to_table(folds.fold_stream(source, machine, delay="0 seconds"), f"fold_{name}", checkpoint=str(tmp_path / "c"))
    want = plain(machine, rows, last["ms"] - 1)
    assert [r for r in collected(got, machine) if r[0] != 999] == want


def test_every_prefetch_transition():
    """All pairs of the seven states: what may follow does, all else is refused and changes nothing."""
    ways = {"idle": [], "queued": ["queued"], "preparing": ["queued", "preparing"], "ready": ["queued", "preparing", "ready"], "complete": ["queued", "preparing", "complete"], "failed": ["queued", "failed"], "stale": ["queued"]}
    for before, way in ways.items():
        for wanted in STATUSES:
            machine, now = machines.Prefetch("k"), 0
            state = machine.start()
            for i, status in enumerate(way):
                now += 1000
                assert machine.feed(state, {"ms": now, "event_id": i, "status": status})[-1]["accepted"]
            if before == "stale":
                now += 180_001
                assert machine.up_to(state, now)[0]["after"] == "stale"
            assert state["status"] == before
            (answer,) = machine.feed(state, {"ms": now + 1, "event_id": 9, "status": wanted})
            legal = {("idle", "queued"), ("queued", "preparing"), ("queued", "failed"), ("preparing", "ready"), ("preparing", "complete"), ("preparing", "failed"), ("ready", "preparing"), ("ready", "complete"), ("ready", "failed"), ("failed", "queued"), ("stale", "queued")}
            assert answer["accepted"] == ((before, wanted) in legal) and state["status"] == (wanted if answer["accepted"] else before)


def test_reveal_refuses_for_the_stated_reasons():
    machine = machines.Reveal("k")
    state, n = machine.start(), iter(range(99))
    say = lambda kind, index=None, answer=None, target=None: machine.feed(state, {"ms": next(n), "event_id": 0, "kind": kind, "index": index, "answer": answer, "target": target})[0]
    assert say("next", 5)["reason"] == "not active"
    assert say("open", target=7)["loaded"] == 5
    for i in (0, 1, 3, 4):
        say("answer", i, "A")
    assert say("answer", 5, "A")["reason"] == say("answer", 2, "E")["reason"] == "invalid answer"
    gap = say("next", 5)
    assert (gap["reason"], gap["first_unanswered"]) == ("incomplete_batch", 2)
    say("answer", 2, "D")
    assert say("next", 3)["reason"] == "quiz_state_changed"
    assert say("next", 5)["loaded"] == 7
    assert say("next", 5)["reason"] == "quiz_state_changed"  # the same request again: another one was faster
    assert [say("answer", i, "B")["accepted"] for i in (5, 6)] == [True, True]
    assert say("next", 7)["reason"] == "nothing left"
    assert say("submit")["accepted"] and say("answer", 0, "A")["reason"] == "not active"


def test_reveal_agrees_with_completeness(spark):
    """A batch is revealed exactly where completeness() finds all of the turns before it."""
    rng = random.Random(9)
    rows, turns, n = [], [], iter(range(10**6))
    for quiz in range(40):
        rows.append({"ms": next(n), "event_id": next(n), "key": quiz, "kind": "open", "index": None, "answer": None, "target": 10})
        answered = sorted({0, 4} | {i for i in range(5) if rng.random() < 0.8})
        rows += [{"ms": next(n), "event_id": next(n), "key": quiz, "kind": "answer", "index": i, "answer": "A", "target": None} for i in answered]
        rows.append({"ms": next(n), "event_id": next(n), "key": quiz, "kind": "next", "index": 5, "answer": None, "target": None})
        turns += [(quiz, i) for i in answered]
    machine = machines.Reveal("key")
    got = folds.fold_batch(frame_of(spark, rows, CASES["reveal"][2]), machine)
    asked = {r["event_id"] for r in rows if r["kind"] == "next"}
    revealed = {r["key"]: r["accepted"] for r in got.collect() if r["event_id"] in asked}
    whole = B.completeness(spark.createDataFrame(turns, "conv_id long, turn long"), 5)
    assert revealed == {r["conv_id"]: r["complete"] for r in whole.collect()} and set(revealed.values()) == {True, False}


def test_lockout_agrees_with_its_window_form(spark):
    machine, rows, kind = CASES["lockout"]
    events = frame_of(spark, rows, kind).select(F.col("key").alias("user_id"), "event_id", F.timestamp_millis("ms").alias("ts"), F.col("kind").alias("event_type"))
    want = sorted(tuple(r) for r in B.lockouts(events, "error", "purchase", 5).select("user_id", "event_id", "failures", "locked").collect())
    assert sorted(tuple(r) for r in folds.fold_batch(frame_of(spark, rows, kind), machine).collect()) == want


def test_null_keys_and_no_rows(spark):
    machine, rows, kind = CASES["tokens"]
    frame = frame_of(spark, rows[:5], kind).withColumn("key", F.lit(None).cast("long"))
    assert folds.fold_batch(frame, machine).collect() == [] and folds.fold_batch(frame.where("false"), machine).collect() == []
