"""Operator 1: packs tokenised documents into fixed sequences by shortest-pack-first over the length histogram.

Token ids are those of the `tokenizers` library for the given file. Since that library cuts text before every space
that a non-space follows, ids are looked up per such slice in a bounded cache and the library (or, for the same
vocabulary, its rank file) is asked only for slices not seen before. Documents longer than a sequence are cut into full
sequences and one remainder; remainders are packed.

Nulls: a null text is an empty document (its ids are the closing id alone); a null doc_id is carried along. Rows with the
same doc_id are packed one by one. Ties: of pieces of one length it does not matter which takes which place. Very long texts
are read whole and cut, slices of LONG characters or more are not kept in the cache. An empty table gives no rows. Other
columns of the input are ignored, also those named like this module's own.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, table, text_or_empty

SEQUENCE = 1024
END_ID = 0
CACHE = 400_000
#: Slices of so many characters are encoded anew each time, so that the cache is bounded in bytes too.
LONG = 200
#: Rows of one length that are ranked in one group.
RANK_GROUP = 50_000

_ODD_SPACE = re.compile(r" (?:\s|$)")


class SliceIds(dict):
    """Slice of text -> its ids as little-endian unsigned 32-bit bytes; holds at most `limit` slices, none of them long."""

    def __init__(self, json_path: str, ranks_path: str | None, limit: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.limit = limit
        self.quick = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        ids = self.quick(text) if self.quick else self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece)
        if len(self) < self.limit and len(piece) < LONG:
            self[piece] = found
        return found

    def document(self, text: str) -> bytes:
        """The ids of a whole text."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text:
            return b""
        if _ODD_SPACE.search(text):  # runs of white space do not end at every space
            return self.encode(text)
        first, *rest = text.split(" ")
        return (self.encode(first) if first else b"") + b"".join(map(self.__getitem__, [" " + x for x in rest]))


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) -> one row per piece of at most `sequence` ids: doc_id, start, length, ids_crc32, doc_tokens."""
    step, close, state = 4 * sequence, np.array([end_id], "<u4").tobytes(), {}

    def work(columns):
        ids = state.get("ids") or state.setdefault("ids", SliceIds(json_path, ranks_path))
        out = defaultdict(list)
        for doc, text in zip(*columns):
            raw = ids.document(text or "") + close
            for at in range(0, len(raw), step):
                part = raw[at : at + step]
                out["doc_id"].append(doc)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(len(raw) // 4)
        return {k: out[k] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, lengths): lengths go longest first, each into the packs with most room left.

    Works on counts of equal packs, so its time and result depend on the number of lengths, not of documents.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = {size: {}}  # room left -> pattern -> count
    for length in sorted(histogram, reverse=True):
        waiting = histogram[length]
        while waiting > 0:
            room = max((r for r, packs in open_packs.items() if packs and r >= length), default=None)
            if room is None:  # each new pack has most room until no more of this length fits
                each = size // length
                pattern, used = (length,) * min(each, waiting), max(1, waiting // each)
                room, fit = size, len(pattern)
            else:
                pattern, count = open_packs[room].popitem()
                fit, used = 1, min(count, waiting)
                if used < count:
                    open_packs[room][pattern] = count - used
                pattern += (length,)
            packs = open_packs.setdefault(room - fit * length, {})
            packs[pattern] = packs.get(pattern, 0) + used
            waiting -= used * fit
    return [(count, pattern) for room in sorted(open_packs) for pattern, count in open_packs[room].items()]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Per length, ranges of ranks and the place they go to: arrays length, rank, sequence, offset, sorted."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, next_rank[length], base, offset))
            next_rank[length] += count
            offset += length
        base += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(pieces: DataFrame, size: int = SEQUENCE, rank_group: int = RANK_GROUP) -> DataFrame:
    """Adds sequence_id and offset to the pieces (doc_id, start, length, ...).

    The driver gets the histogram only: at most `size` lengths. Ranks within a length are counted in groups of about
    `rank_group` rows, whose sizes are then summed up, so one frequent length is spread over many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))  # bounded by size, not by documents
    groups = max(1, sum(histogram.values()) // rank_group)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    before = (
        dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
        .select("length", "part", "before")
    )
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def located(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = place.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        first = np.searchsorted(s["length"], n, "left")
        key = s["length"].astype(np.float64) * 2.0**40 + s["rank"]
        at = np.maximum(np.searchsorted(key, n.astype(np.float64) * 2.0**40 + r, "right") - 1, first)
        return pd.DataFrame({"sequence_id": s["sequence"][at] + r - s["rank"][at], "offset": s["offset"][at]})

    return (
        ranked.join(before, ["length", "part"])
        .withColumn("at", located("length", F.col("before") + F.col("own")))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
    )


def pack_documents(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Tokenises and packs (doc_id, text); the pieces are kept in the shared folder between the two passes."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = token_pieces(docs.select("doc_id", text_or_empty().alias("text")), json_path, ranks_path, size)
    return pack(materialise(pieces, "pieces"), size)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
