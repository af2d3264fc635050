"""Services that hand out rows page by page, as a Spark source, and a copy of them that goes on where it broke off.

A service is an object that tasks can have a copy of:
    schema: DDL of its rows; filters: columns that it can compare with one value itself
    version() -> str: of what it holds; count(equal) -> int: rows for {column: value}
    splits(n) -> up to n (low, high) ranges of its keys, which together are all of them
    page(low, high, cursor, limit, equal) -> (rows as tuples, the next cursor or None)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from .store import exists, preflight, read_manifest, write_manifest

PAGE = 256


@dataclass
class Split(InputPartition):
    low: object
    high: object


class PagedReader(DataSourceReader):
    def __init__(self, service, splits: list, page: int):
        self.service, self.ranges, self.size, self.equal = service, splits, page, {}

    def pushFilters(self, filters: list) -> Iterator:
        """Equalities on columns that the service filters itself are left to it; others come back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.service.filters and self.equal.setdefault(f.attribute[0], f.value) == f.value:
                continue
            yield f

    def partitions(self) -> list[Split]:
        return [Split(low, high) for low, high in self.ranges]

    def read(self, split: Split) -> Iterator[tuple]:
        cursor = None
        while True:
            rows, cursor = self.service.page(split.low, split.high, cursor, self.size, self.equal)
            yield from rows
            if cursor is None:
                return


def register(spark: SparkSession, name: str, service, splits: int = 8, page: int = PAGE, only: list | None = None) -> str:
    """Makes a service readable as spark.read.format(name), each of its splits by a task, page after page.

    only: some of its splits, where not all are wanted. Turns the session's spark.sql.python.filterPushdown.enabled on, without
    which Spark refuses sources that take filters.
    """
    ranges = only if only is not None else service.splits(splits)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return service.schema

        def reader(self, schema) -> PagedReader:
            return PagedReader(service, ranges, page)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return name


def read_pages(spark: SparkSession, service, splits: int = 8, page: int = PAGE, only: list | None = None, **equal) -> DataFrame:
    """The rows of a service with these values, as a frame; the service filters what it can, Spark the rest."""
    rows = spark.read.format(register(spark, f"pages_{type(service).__name__.lower()}", service, splits, page, only)).load()
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return rows


def copy_pages(spark: SparkSession, service, path: str, size: int, splits: int = 64, at_once: int = 8, page: int = PAGE, column: str = "embedding") -> int:
    """All rows of a service as a table, in groups of splits. Each group is checked (size, finiteness, zeros of the vectors),
    written, and then noted; a copy that broke off goes on behind the last group noted.

    It is refused where the table was begun under another version of the service, or the version changes meanwhile, and what
    stands at the end is counted and compared with the service's count. Returns the number of rows.
    """
    note, version = f"{path}.copy.json", service.version()
    known = read_manifest(spark, note) if exists(spark, note) else None
    if known and known["version"] != version:
        raise ValueError(f"begun under version {known['version']}, now {version}")
    state = known or {"version": version, "splits": [list(s) for s in service.splits(splits)], "done": [], "status": "copying"}
    write_manifest(spark, note, state)
    left = [i for i in range(len(state["splits"])) if i not in set(state["done"])]
    for at in range(0, len(left), at_once):
        group = left[at : at + at_once]
        rows = read_pages(spark, service, page=page, only=[tuple(state["splits"][i]) for i in group])
        target = f"{path}/group={group[0]}"
        rows.write.mode("overwrite").parquet(target)
        found = preflight(spark.read.schema(rows.schema).parquet(target), size, column)
        if any(found.values()):
            raise ValueError(f"vectors refused: {found}")
        if service.version() != version:
            raise ValueError("the version changed during the copy")
        state["done"] += group
        write_manifest(spark, note, state)
    n, expected = (spark.read.parquet(path).count() if state["done"] else 0), service.count({})
    if n != expected:
        raise RuntimeError(f"{n} of {expected} rows arrived")
    write_manifest(spark, note, {**state, "status": "ready", "count": n})
    return n
