"""Small tables are written in few files, however many partitions a shuffle has."""

import random

import pytest

from abacora.llm import common, components


@pytest.fixture
def many_partitions(spark):
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_of_components(spark, many_partitions, monkeypatch):
    files = {}

    def counted(df, label, **more):
        out = common.materialise(df, label, **more)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "materialise", counted)
    rng, edges = random.Random(4), [(0, i) for i in range(1, 300)]
    edges += [(1000 + i, 1001 + i) for i in range(200) if i != 77] + [tuple(rng.sample(range(2000, 2400), 2)) for _ in range(300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert got == want
    assert len(files["low"]) > 1 and max(files["low"] + files["large"] + files["least"] + files["edges"][1:]) == 1


def test_never_more_files_and_as_many_as_the_rows_fill(spark):
    df = spark.range(0, 100, 1, 8)
    assert [common.in_few(df, n).rdd.getNumPartitions() for n in (0, 100, 3 * common.FILE_ROWS, 10**9)] == [1, 1, 4, 8]
