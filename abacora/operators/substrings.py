"""Which texts hold which of many strings (P5, J16): automata over shards of the strings, one pass over the texts for some shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import PREFIX, Automaton, laid_out

#: States of one automaton, at most about; with 100 different bytes its table takes 26 MB.
STATES = 1 << 16
#: Automata in one pass over the texts; more strings take more passes.
SHARDS = 8
#: Bytes of text that are scanned together, about.
TOGETHER = 8 << 20
_FOUND = "id long, pattern_id long, at long"


def _scan(pairs: list[tuple[int, str]], shards: int, first: int):
    """mapInArrow over (id, text) for the patterns of a pass, dealt to automata by their numbers."""
    kind = pa.schema([("id", pa.int64()), ("pattern_id", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for s in range(shards):
            own = pairs[s::shards]
            if own:
                made.append((np.array([i for i, _ in own], np.int64), Automaton([p.encode() for _, p in own])))
        for batch in batches:
            rows = max(1, int(batch.num_rows * TOGETHER / max(TOGETHER, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, edges = laid_out(part.column(1))
                for numbers, automaton in made:
                    text, pattern, begin = automaton.find(data, edges)
                    if not len(text):
                        continue
                    order = np.lexsort((begin, pattern, text))
                    text, pattern, begin = text[order], pattern[order], begin[order]
                    once = np.r_[True, (text[1:] != text[:-1]) | (pattern[1:] != pattern[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[text[once]]), pa.array(numbers[pattern[once]]), pa.array(begin[once])], schema=kind)

    return run


def contained(texts: DataFrame, patterns: DataFrame, states: int = STATES, shards: int = SHARDS) -> DataFrame:
    """(id, text) and (pattern_id, pattern) -> id, pattern_id, at: each text with each pattern that it holds, and where (in bytes)
    the pattern begins first.

    Patterns go to the tasks in shards of bounded size, some shards to a pass over the texts; nothing is joined or shuffled.
    The number of passes grows with the patterns, so this is for patterns that are few beside the texts. Null and empty
    patterns are held by no text, null texts hold none; repeated ids give a row for each text, repeated pattern ids likewise.
    """
    spark = texts.sparkSession
    real = patterns.select(F.col(patterns.columns[0]).cast("long").alias("pattern_id"), F.col(patterns.columns[1]).alias("pattern")).where(F.length("pattern") > 0)
    total = real.agg(F.sum(F.least(F.octet_length("pattern"), F.lit(PREFIX)))).first()[0] or 0
    if not total:
        return spark.createDataFrame([], _FOUND)
    passes = -(-total // (states * shards))
    rows = texts.select(F.col(texts.columns[0]).cast("long").alias("id"), F.col(texts.columns[1]).alias("text")).where("text is not null")
    found = None
    for i in range(passes):
        own = real.where(F.pmod(F.xxhash64("pattern", F.lit(5)), F.lit(passes)) == i) if passes > 1 else real
        pairs = [(r["pattern_id"], r["pattern"]) for r in own.collect()]  # at most about states * shards bytes of heads
        heads = sum(min(PREFIX, len(p.encode())) for _, p in pairs)
        part = rows.mapInArrow(_scan(pairs, max(1, -(-heads // states)), i), _FOUND)
        found = part if found is None else found.union(part)
    return found
