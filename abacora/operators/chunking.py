"""Ingestion: structure units of pages and packing of tokens into chunks with overlap."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_type
from ..sources.store import discard, written

BOUNDARIES = ("heading", "example", "exercise", "definition")


def structure_units(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, line) -> units: an empty line or a heading, example, exercise or definition begins a new one.

    A unit has the type of the line that opened it; prose becomes formula if one of its lines is. The section is the last
    heading on the page. Everything is window functions over one page at a time.
    """
    page = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("line") == "", "blank").otherwise(line_type(F.col("line")))
    edge = F.when(F.col("type").isin("blank", *BOUNDARIES), 1).otherwise(0)
    marked = lines.withColumn("type", kind).withColumns({"unit": F.sum(edge).over(page), "section": F.max(F.when(F.col("type") == "heading", F.col("pos"))).over(page)})
    block = F.lit("prose")
    for t in ("formula", *reversed(BOUNDARIES)):
        block = F.when(F.bool_or(F.col("type") == t), t).otherwise(block)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return marked.where("type <> 'blank'").groupBy("doc_id", "unit").agg(
        F.min("pos").alias("first_line"), F.max("pos").alias("last_line"), F.coalesce(F.max("section"), F.lit(0)).cast("long").alias("section_line"), block.alias("block_type"), text.alias("text"),
    )


def _pieces(unit: list[str], target: int, high: int, overlap: int, whole: bool) -> list[list[str]]:
    """A unit that is too large, in windows: of `target` tokens that overlap, or (whole) of what fits behind an overlap."""
    if len(unit) <= (high - overlap if whole else high):
        return [unit] if unit else []
    size, step = (high - overlap, high - overlap) if whole else (target, target - overlap)
    last = max(0, -(-(len(unit) - size) // step))
    return [unit[i * step : i * step + size] for i in range(last + 1)]


def _filled(pieces: Iterable[list[str]], target: int, high: int, overlap: int) -> Iterator[list[str]]:
    """Chunks as they fill up, one at a time."""
    current: list[str] = []
    for piece in pieces:
        if current and (len(current) + len(piece) > high or len(current) >= target):
            yield current[:high]
            current = current[:high][-overlap:]
        current = current + piece
    if current:
        yield current[:high]


def _settled(chunks: Iterator[list[str]], low: int, high: int, overlap: int, whole: bool, before: list[str] | None = None) -> Iterator[list[str]]:
    """Chunks with the short ones filled up; it looks one chunk ahead and one back (before: the chunk before the first)."""
    size, chunk = min(low + 16, high), next(chunks, None)
    while chunk is not None:
        after = next(chunks, None)
        if len(chunk) >= low or (before is None and after is None) or (whole and after is not None):
            made = chunk
        elif before is None:
            made = (chunk + after)[:size]
        else:
            own = chunk[overlap:] if whole and chunk[:overlap] == before[-overlap:] else chunk
            made = (before + own)[-max(size, len(chunk)) if whole else -size :]
        yield made
        before, chunk = made, after


def packed(units: Iterable[list[str]], low: int = 300, target: int = 360, high: int = 450, overlap: int = 60, whole: bool = False) -> Iterator[list[str]]:
    """Units of tokens of one source, in order, packed into chunks of at most `high` tokens, of which three are held at a time.

    A chunk ends when the next piece would make it too long or when it has `target` tokens; the next one begins with its last
    `overlap` tokens. What reaches beyond `high` is cut off, unless whole, where units are cut small enough for nothing to.
    A chunk below `low` becomes the last low + 16 tokens of its predecessor and itself, without one the first of itself and
    its successor (whole: only the last chunk is filled up); a source of fewer tokens stays one short chunk.
    """
    pieces = (p for u in units for p in _pieces(u, target, high, overlap, whole))
    return _settled(_filled(pieces, target, high, overlap), low, high, overlap, whole)


def pack_tokens(units: list[list[str]], **limits) -> list[list[str]]:
    """The chunks of packed() as a list."""
    return list(packed(units, **limits))


_CHUNK = "source string, index long, chunk_id string, token_count long, text string"
#: Characters of a source beyond which its packing is spread over tasks.
LONG = 64 << 20
#: Pieces whose effect on the fill is summed up together, and chunks that are written together.
BLOCK, TOGETHER = 4096, 4096


def _rows(made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(made, columns=[f.split()[0] for f in _CHUNK.split(", ")])


def _row(corpus: str, source: str, i: int, chunk: list[str]) -> tuple:
    text = " ".join(chunk)
    return source, i, hashlib.sha256(f"{corpus}|{source}|{i}|{text}".encode()).hexdigest(), len(chunk), text


def chunk_pack(units: DataFrame, corpus: str = "corpus", long: int = LONG, block: int = BLOCK, together: int = TOGETHER, **limits: int) -> DataFrame:
    """W10 over frames: (source, ord, text) -> source, index, chunk_id, token_count, text.

    Most sources are read one after another from sorted partitions, unit by unit, a few chunks at a time. One of more than
    `long` characters is spread over tasks by pack_spread(), with the same chunks. Units of equal ord go by their text.
    """
    units = units.select("source", "ord", "text")
    sizes = units.groupBy("source").agg(F.sum(F.length("text")).alias("n")).where(F.col("n") > long)
    large = written(sizes.select(F.col("source").alias("large")), "large")  # a small table, so that the join moves no units
    if not large.take(1):
        discard(large)
        return _packed_by_source(units, corpus, limits)
    same = F.col("source").eqNullSafe(F.col("large"))
    spread = pack_spread(units.join(large, same, "left_semi"), corpus, block, together, **limits)
    return _packed_by_source(units.join(large, same, "left_anti"), corpus, limits).union(spread)


def _packed_by_source(units: DataFrame, corpus: str, limits: dict) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, made = ((s, t) for f in frames for s, t in zip(f["source"].tolist(), f["text"].tolist())), []
        for source, own in itertools.groupby(rows, key=lambda r: r[0]):
            for i, chunk in enumerate(packed((t.split() for _, t in own), **limits)):
                made.append(_row(corpus, source, i, chunk))
                if len(made) == 500:
                    yield _rows(made)
                    made = []
        yield _rows(made)

    return units.repartition("source").sortWithinPartitions("source", "ord", "text").mapInPandas(run, _CHUNK)


def fill_map(sizes: Iterable[int], target: int, high: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """What pieces of these sizes do to a chunk being filled: for each fill it may have before them, the fill behind them and
    how many chunks they end. Such maps compose, so blocks of pieces are summed up independently of each other."""
    fill = np.arange(max(high, target) + overlap + 1)
    ended = np.zeros(len(fill), np.int64)
    for n in sizes:
        full = (fill > 0) & ((fill + n > high) | (fill >= target))
        fill = np.where(full, np.minimum(fill, min(high, overlap)), fill) + n
        ended += full
    return fill, ended


def pack_spread(units: DataFrame, corpus: str = "corpus", block: int = BLOCK, together: int = TOGETHER, low: int = 300, target: int = 360, high: int = 450, overlap: int = 60, whole: bool = False) -> DataFrame:
    """The chunks of packed() for sources of any length, no source in one task.

    Units are dealt by ranges of (source, ord) and cut into pieces. Where chunks end depends on sizes only: each block of pieces
    is summed up as a map of fills, and one pass over the small maps gives every block the fill and the chunk it begins with.
    Pieces then go to ranges of chunks, each with the chunks before it that its own may draw tokens from.
    """
    halo = -(-min(low + 16, high) // (overlap + 1)) + overlap + 2  # every chunk brings a token; a short one reaches so far back

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, before = TaskContext.get().partitionId() << 32, 0, ()
        for f in frames:
            made = []
            for source, text in zip(f["source"].tolist(), f["text"].tolist()):
                for piece in _pieces(text.split(), target, high, overlap, whole):
                    if (source,) != before or held == block:
                        at, held, before = at + 1, 0, (source,)
                    made.append((source, at, held, len(piece), " ".join(piece)))
                    held += 1
            yield pd.DataFrame(made, columns=["source", "block", "seq", "size", "text"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, ended = fill_map(pdf.sort_values("seq")["size"].tolist(), target, high, overlap)
        return pd.DataFrame({"source": pdf["source"].iloc[:1].tolist(), "block": pdf["block"].iloc[:1].tolist(), "fills": [fill], "ended": [ended]})

    def entered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, fill, chunk = (), 0, 0
        for f in frames:
            made = []
            for source, at, fills, ended in zip(f["source"].tolist(), f["block"].tolist(), f["fills"], f["ended"]):
                if (source,) != before:
                    before, fill, chunk = (source,), 0, 0
                made.append((at, fill, chunk))
                fill, chunk = int(fills[fill]), chunk + int(ended[fill])
            yield pd.DataFrame(made, columns=["block", "fill", "chunk"])

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        fill, chunk, carried, number = int(pdf["fill"].iloc[0]), int(pdf["chunk"].iloc[0]), [], []
        for n in pdf["size"].tolist():
            if fill and (fill + n > high or fill >= target):
                fill, chunk = min(fill, high, overlap), chunk + 1
            carried.append(fill)
            number.append(chunk)
            fill += n
        return pdf[["source", "block", "seq", "text"]].assign(carried=carried, chunk=number)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "seq"])
        first, part, source = int(pdf["chunk"].iloc[0]), int(pdf["part"].iloc[0]), pdf["source"].iloc[0]

        def chunks() -> Iterator[list]:
            current, number = [None] * int(pdf["carried"].iloc[0]), first  # tokens of chunks that are not here
            for chunk, text in zip(pdf["chunk"].tolist(), pdf["text"].tolist()):
                if chunk != number:
                    yield current[:high]
                    current, number = current[:high][-overlap:], chunk
                current = current + text.split(" ")
            yield current[:high]

        made = _settled(chunks(), low, high, overlap, whole, [None] * (low + 16) if first else None)
        return _rows([_row(corpus, source, i, c) for i, c in enumerate(made, first) if i // together == part])

    pieces = written(units.repartitionByRange("source", "ord").sortWithinPartitions("source", "ord", "text").mapInPandas(cut, "source string, block long, seq int, size int, text string"), "pieces")
    maps = pieces.select("source", "block", "seq", "size").groupBy("block").applyInPandas(summed, "source string, block long, fills array<int>, ended array<long>")
    entries = written(maps.repartition("source").sortWithinPartitions("source", "block").mapInPandas(entered, "block long, fill int, chunk long"), "entries")
    numbered = pieces.join(entries, "block").groupBy("block").applyInPandas(placed, "source string, block long, seq int, text string, carried int, chunk long")
    parts = F.sequence(F.greatest(F.lit(0), F.ceil(F.col("chunk") / together) - 1).cast("long"), F.floor((F.col("chunk") + halo) / together).cast("long"))
    return numbered.withColumn("part", F.explode(parts)).groupBy("source", "part").applyInPandas(joined, _CHUNK)
