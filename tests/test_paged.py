"""Paged services as a source, and copies that break off."""

import json
import sys

import pytest
from pyspark import cloudpickle

from abacora.sources import paged, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not have this file


class Shelf:
    """A stand-in: vectors by number, handed out by pages; notes what it was asked for, fails when told to."""

    schema, filters = "doc_id long, grade long, text string, embedding array<double>", ("grade",)

    def __init__(self, folder, n=500, version="v1"):
        self.folder, self.n, self.name = str(folder), n, version

    def version(self):
        return self.name

    def _row(self, i):
        return (i, 9 + i % 4, "" if i % 50 == 0 else f"text {i}", [float(i + 1), 1.0])

    def count(self, equal):
        return sum(all(dict(zip(("doc_id", "grade"), self._row(i)))[c] == v for c, v in equal.items()) for i in range(self.n))

    def splits(self, n):
        step = -(-self.n // n)
        return [(a, min(self.n, a + step)) for a in range(0, self.n, step)]

    def page(self, low, high, cursor, limit, equal):
        at = low if cursor is None else cursor
        with open(f"{self.folder}/asked", "a") as f:
            f.write(json.dumps([low, at, limit, equal]) + "\n")
        import os

        if os.path.exists(f"{self.folder}/broken") and low <= 300 < high and at > low:
            raise OSError("the service is away")
        rows = [r for r in map(self._row, range(at, min(high, at + limit))) if all(dict(zip(("doc_id", "grade"), r))[c] == v for c, v in equal.items())]
        return rows, (at + limit if at + limit < high else None)

    def asked(self):
        with open(f"{self.folder}/asked") as f:
            return [json.loads(line) for line in f]


def test_pages_are_read_by_splits_and_filters_reach_the_service(spark, tmp_path):
    shelf = Shelf(tmp_path)
    rows = paged.read_pages(spark, shelf, splits=4, page=50, grade=10)
    got = rows.where("text <> ''").collect()
    assert {r["doc_id"] for r in got} == {i for i in range(500) if i % 4 == 1 and i % 50}
    assert {tuple(a[:2]) for a in shelf.asked()} == {(low, low + k) for low in range(0, 500, 125) for k in range(0, 125, 50)}
    assert all(a[2] == 50 and a[3] == {"grade": 10} for a in shelf.asked())
    assert rows.rdd.getNumPartitions() == 4


def test_filters_that_the_service_has_not_are_sparks(spark, tmp_path):
    assert [r["grade"] for r in paged.read_pages(spark, Shelf(tmp_path), doc_id=7).collect()] == [12]


def test_copy_goes_on_where_it_broke_off(spark, tmp_path):
    shelf, path = Shelf(tmp_path), f"file://{tmp_path}/copy"
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="away"):
        paged.copy_pages(spark, shelf, path, 2, splits=10, at_once=2, page=20)
    before = store.read_manifest(spark, f"{path}.copy.json")
    assert before["status"] == "copying" and before["done"] == [0, 1, 2, 3, 4, 5]
    (tmp_path / "broken").unlink()
    (tmp_path / "asked").unlink()
    assert paged.copy_pages(spark, shelf, path, 2, splits=10, at_once=2, page=20) == 500
    assert min(a[0] for a in shelf.asked()) == 300  # what was noted is not asked for again
    rows = spark.read.parquet(path).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(500))
    assert store.read_manifest(spark, f"{path}.copy.json")["status"] == "ready"
    (tmp_path / "asked").unlink()
    assert paged.copy_pages(spark, shelf, path, 2) == 500 and not (tmp_path / "asked").exists()


def test_copy_refuses_other_versions_bad_vectors_and_lost_rows(spark, tmp_path):
    path = f"file://{tmp_path}/copy"
    assert paged.copy_pages(spark, Shelf(tmp_path, 20), path, 2, splits=2) == 20
    with pytest.raises(ValueError, match="begun under version v1, now v2"):
        paged.copy_pages(spark, Shelf(tmp_path, 20, "v2"), path, 2, splits=2)
    with pytest.raises(ValueError, match="vectors refused"):
        paged.copy_pages(spark, Shelf(tmp_path, 20), f"{path}2", 3, splits=2)
    lossy = Shelf(tmp_path, 20)
    lossy.__class__ = type("Lossy", (Shelf,), {"count": lambda self, equal: 21})
    with pytest.raises(RuntimeError, match="20 of 21"):
        paged.copy_pages(spark, lossy, f"{path}3", 2, splits=2)
