"""State machines over the rows of a key in the order of time, as a stream (state kept by Spark, timers in event time) and as a
batch (sorted partitions, one state at a time). Both run the same machine, so they agree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The state store that transformWithState needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """A machine keeps what it knows of a key in a dict of JSON values and answers each row with rows.

    key and order name columns of the input; the first of order is ms, the event time in milliseconds. output: the columns
    of an answer besides the key, as DDL.
    """

    key = "key"
    order = ("ms", "event_id")
    output = ""
    #: Milliseconds after which the state of a silent key may go (None: it stays).
    ttl: int | None = None

    def start(self) -> dict:
        return {}

    def step(self, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When (event time) something happens by itself, if nothing comes before."""
        return None

    def timeout(self, state: dict, at: int) -> list[dict]:
        return []

    def up_to(self, state: dict, ms: int) -> list[dict]:
        """What happens by itself until (and at) a time."""
        out = []
        while (at := self.due(state)) is not None and at <= ms:
            out += self.timeout(state, at)
        return out

    def feed(self, state: dict, row: dict) -> list[dict]:
        return [*self.up_to(state, int(row["ms"])), *self.step(state, row)]

    def columns(self) -> list[str]:
        return [part.split()[0] for part in self.output.split(", ")]


def timed(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ms, the event time in milliseconds."""
    return rows.withColumn("ms", F.unix_millis(F.col(ts).cast("timestamp")))


def _frame(machine: Machine, made: list[tuple]) -> pd.DataFrame:
    """(key, answer) pairs as rows."""
    return pd.DataFrame({machine.key: [key for key, _ in made]} | {c: pd.Series([a.get(c) for _, a in made], dtype=object) for c in machine.columns()})


def _key_type(rows: DataFrame, machine: Machine) -> str:
    return dict(rows.dtypes)[machine.key]


def fold_batch(rows: DataFrame, machine: Machine, until: int | None = None) -> DataFrame:
    """Every key's rows in order through the machine; until: event time (ms) up to which timers go off at the end.

    Partitions are sorted, so a task holds one state and one batch of rows, however many rows a key has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, none, made = None, None, True, []
        for pdf in frames:
            for row in pdf.to_dict("records"):
                if none or row[machine.key] != key:
                    if not none and until is not None:
                        made += ((key, a) for a in machine.up_to(state, until))
                    key, state, none = row[machine.key], machine.start(), False
                made += ((key, a) for a in machine.feed(state, row))
                if len(made) >= 5000:
                    yield _frame(machine, made)
                    made = []
        if not none and until is not None:
            made += ((key, a) for a in machine.up_to(state, until))
        if made:
            yield _frame(machine, made)

    dealt = rows.where(F.col(machine.key).isNotNull()).repartition(machine.key).sortWithinPartitions(machine.key, *machine.order)
    return dealt.mapInPandas(run, f"{machine.key} {_key_type(rows, machine)}, {machine.output}")


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string", self.machine.ttl)

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()

    def _keep(self, state: dict) -> None:
        self.state.update((json.dumps(state),))
        due = self.machine.due(state)
        for old in list(self.handle.listTimers()):
            if old != due:
                self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, answers = self._load(), []
        found = [r for pdf in rows for r in pdf.to_dict("records")]  # one key's rows of one micro-batch
        for row in sorted(found, key=lambda r: tuple(r[c] for c in self.machine.order)):
            answers += self.machine.feed(state, row)
        self._keep(state)
        yield _frame(self.machine, [(key[0], a) for a in answers])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        answers = self.machine.up_to(state, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(state)
        yield _frame(self.machine, [(key[0], a) for a in answers])

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, machine: Machine, ts: str = "ts", delay: str = "1 minute") -> DataFrame:
    """A stream's rows through the machine, micro-batch by micro-batch; a key's rows of one micro-batch are put in order.

    Rows behind the watermark are dropped by Spark. Timers go off when the watermark reaches them. The session needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass, see ROCKS).
    """
    kind = f"{machine.key} {_key_type(rows, machine)}, {machine.output}"
    watched = timed(rows.withWatermark(ts, delay), ts).where(F.col(machine.key).isNotNull())
    return watched.groupBy(machine.key).transformWithStateInPandas(statefulProcessor=_Processor(machine), outputStructType=kind, outputMode="Append", timeMode="EventTime" if machine.ttl is None else "ProcessingTime")
