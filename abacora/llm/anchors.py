"""Content-defined anchors: positions that any two equal stretches of tokens choose alike, so repeats can be found by few keys."""

from __future__ import annotations

import gc

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, text_or_empty

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STATE: dict = {"powers": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE["powers"]) < n:
        size = 1 << int(n).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("powers", _BASE), ("inverse", inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _STATE[name] = np.cumprod(a, dtype=np.uint64)
    return _STATE["powers"], _STATE["inverse"]


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit token values, from one running sum modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.powers, inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * inverse[:n], dtype=np.uint64, out=self.sums[1:])
        self.top = n

    def all(self, length: int) -> np.ndarray:
        """Hash of every stretch of this length."""
        m = self.top - length + 1
        return (self.sums[length:] - self.sums[:m]) * self.powers[:m]

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, end)."""
        return mix64((self.sums[end] - self.sums[start]) * self.powers[start] + (end - start).astype(np.uint64))


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of a, by doubling."""
    step = 1
    while step * 2 <= width:
        a = op(a[:-step], a[step:])
        step *= 2
    return op(a[: len(a) - (width - step)], a[width - step :]) if width > step else a


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least value of some window of `width` values; equal values all count."""
    low = sliding(np.minimum, h, width)
    pad = np.zeros(width - 1, h.dtype)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([pad, low, pad]), width) == h)


def row_key() -> Column:
    """The same for rows of equal doc_id and text only (a null text counts as empty)."""
    text = text_or_empty()
    return F.xxhash64("doc_id", text, F.length(text))


def with_row_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> rid, doc_id, text: rid is the same for equal rows only, so joins on it never multiply rows."""
    return docs.select(row_key().alias("rid"), "doc_id", text_or_empty().alias("text"))


def squeezed(texts: list[str]) -> list[bytes]:
    """Texts compressed for a shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(t.encode()) for t in texts]


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of frames that are no longer used (else they stay until the driver collects garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
