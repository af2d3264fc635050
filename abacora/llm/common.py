"""Shared pieces of the training-data operators: reading, shared tables, word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: maximal runs of anything but space and the ASCII controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SEPARATORS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
#: Rows in a file of a table that is known to be small, about.
FILE_ROWS = 20_000
#: Bytes of a batch's columns that are turned into Python objects at a time, about.
BATCH_BYTES = 32 << 20
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str) -> list[str]:
    """The words of a text by WORD; splitting on one space is much faster than the pattern."""
    return [w for w in text.translate(_SEPARATORS).split(" ") if w]


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.translate(_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table; the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a local session gets one of its own; on a
    cluster that is an error, since executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="abacora-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """What materialise() writes inside (but for what is to stay) is deleted at the end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            discard(df)


def materialise(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage, survives lost executors.

    Inside scratch() the table is deleted at its end; one that stays belongs to the scratch() around that, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    around = _OPEN[:-1] if stays else _OPEN
    if around:
        around[-1].append(out)
    return out


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """A frame of at most so many rows, about, in as few partitions as they fill: written, each is a file, which costs more
    than a few rows do. Never in more than it has."""
    return df.coalesce(rows // FILE_ROWS + 1)


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing that is still to be computed reads it."""
    path = df.__dict__.get("_written_to")
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes, a row at least, so that lists of long texts stay small."""
    rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        piece = batch.slice(at, rows)
        if rows > 1 and piece.num_rows > 1 and piece.nbytes > 2 * most:  # long rows stand together
            yield from slices(piece.slice(0, piece.num_rows // 2), most)
            yield from slices(piece.slice(piece.num_rows // 2), most)
        else:
            yield piece


def map_rows(df: DataFrame, work: Callable[[list[list]], dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow over plain columns: work gets the columns as lists, some BATCH_BYTES at a time, and returns columns."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([_array(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    if isinstance(values, np.ndarray):
        return pa.array(values, kind, from_pandas=False)
    return pa.array(values, kind)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string ("a long, b string")."""
    return pa.schema([pa.field(*(part.split()[0], _ARROW[part.split()[1]])) for part in ddl.split(",")])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
