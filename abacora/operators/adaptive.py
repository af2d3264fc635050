"""Order-dependent choices: diverse weighted selection, budgets, passages, positions; and stubborn JSON."""

from __future__ import annotations

import ast
import hashlib
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def race(rows: list[dict], n: int, rng: random.Random, families: Counter, age_of) -> list[dict]:
    """Draws n rows without replacement by exponential races; families drawn before slow their rows down."""
    pool = list(rows)
    start = {r["topic_id"]: -math.log(max(rng.random(), 1e-12)) / (max(1, min(30, r.get("periods", 5))) * (1 + 0.4 * min(20, max(0, age_of(r))))) for r in pool}
    out = []
    while pool and len(out) < n:
        best = min(pool, key=lambda r: (start[r["topic_id"]] * (1 + 0.6 * sum(families[f] for f in set(r["families"]))), r["topic_id"]))
        pool.remove(best)
        out.append(best)
        families.update(set(best["families"]))
    return out


def select_topics(rows: list[dict], seed: str, size: int = 25, attempts: int = 0, odd: int = 0) -> list[dict]:
    """Topics (topic_id, grade, families, periods, seen, accuracy, last_attempt) chosen by grade quotas that alternate:
    up to a third weak ones, then unseen ones, then any."""
    rng, families, chosen = random.Random(hashlib.sha256(seed.encode()).hexdigest()), Counter(), []
    grades = sorted({r["grade"] for r in rows})
    for i, grade in enumerate(grades):
        quota = size // len(grades) + (1 if i == odd % len(grades) and size % len(grades) else 0)
        pool = sorted((r for r in rows if r["grade"] == grade), key=lambda r: r["topic_id"])
        age = lambda r: attempts - r.get("last_attempt", 0)
        mine: list[dict] = []
        for candidates, most in (([r for r in pool if r["seen"] and r["accuracy"] < 0.8], quota // 3), ([r for r in pool if not r["seen"]], quota), (pool, quota)):
            used = {r["topic_id"] for r in mine}
            mine += race([r for r in candidates if r["topic_id"] not in used], min(most, quota - len(mine)), rng, families, age)
        chosen += mine
    return chosen


def adaptive_select(students: DataFrame, catalogue: list[dict], seed: str, size: int = 25) -> DataFrame:
    """O6 for many students: (student_id, history: array of topic_id, accuracy, last_attempt) -> student_id, topic_id, place in
    the order of choice. Each student chooses alone, where their row is; nothing is joined, grouped or shuffled.

    catalogue: the topics (topic_id, grade, families, periods), a curriculum, so it goes to the tasks with the function. Topics
    that a student's history does not name are unseen.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for student, history in zip(pdf["student_id"].tolist(), pdf["history"].tolist()):
                known = {h["topic_id"]: h for h in ([] if history is None else history)}
                none = {"accuracy": None, "last_attempt": 0}
                rows = [{**t, "seen": t["topic_id"] in known, **{k: known.get(t["topic_id"], none)[k] for k in none}} for t in catalogue]
                attempts = max((int(r["last_attempt"] or 0) for r in rows), default=0)
                out += ((student, r["topic_id"], place) for place, r in enumerate(select_topics(rows, f"{seed}:{student}", size, attempts, int(student)), 1))
            yield pd.DataFrame(out, columns=["student_id", "topic_id", "place"])

    return students.select("student_id", "history").mapInPandas(run, "student_id long, topic_id string, place long")


def budget_fill(parts, start, limit: int = 3600):
    """From place `start` on and around, parts that still fit into `limit` characters (two for each join)."""
    n = F.size(parts)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(parts, (F.pmod(start + i, n) + 1).cast("int")))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(s, p):
        size = s["used"] + F.length(p) + F.when(F.size(s["kept"]) > 0, 2).otherwise(0)
        return F.when(size <= limit, F.struct(size.alias("used"), F.concat(s["kept"], F.array(p)).alias("kept"))).otherwise(s)

    return F.when(n > 0, F.aggregate(turned, empty, step, lambda s: F.array_join(s["kept"], "\n\n"))).otherwise("")


def evidence_passages(text, least: int = 8, most: int = 40, step: int = 28):
    """Sentences of 8 to 40 words; longer ones as windows of 40 words every 28; each once."""
    sentences = F.split(F.regexp_replace(F.trim(text), r"\s+", " "), r"(?<=[.!?])\s+")
    words = F.transform(sentences, lambda s: F.split(s, " "))

    def cut(w):
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
        starts = F.filter(starts, lambda i: (i == 0) | (i - step + most < n))
        return F.when(n <= most, F.array(F.array_join(w, " "))).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, most), " ")))

    found = F.flatten(F.transform(words, cut))
    return F.array_distinct(F.filter(found, lambda p: F.size(F.split(p, " ")) >= least))


def pseudonym(key: bytes, namespace: str):
    """a keyed reference (HMAC-SHA-256) of 16 hex digits as a column expression; the key is the caller's, null stays null."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))

    def ref(value: Column) -> Column:
        message = F.encode(F.concat(F.lit(f"{namespace}:"), value.cast("string")), "UTF-8")
        return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256), 1, 16)

    return ref


#: A backslash, with what it escapes in JSON if it does.
_BACKSLASH = re.compile(r'\\(["\\/bfnrt]|u[0-9a-fA-F]{4})?')


def _readings(text: str) -> Iterator[str]:
    """A text as it is, with stray backslashes doubled, and without trailing commas too."""
    doubled = _BACKSLASH.sub(lambda m: m[0] if m[1] else r"\\", text)
    yield from dict.fromkeys((text, doubled, re.sub(r",(\s*[\]}])", r"\1", doubled)))


def salvaged(text: str) -> Iterator:
    """Every object or list that a model's answer holds, as JSON or as a Python literal, best guess first.

    Looked at are the answer without its fences, then what begins at each bracket in it; whatever follows a whole value is
    left out, and nothing is looked for inside a value that was found.
    """
    bare = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text or "").strip()
    decode, skip = json.JSONDecoder().raw_decode, 0
    for start in dict.fromkeys([0, *(m.start() for m in re.finditer(r"[\[{]", bare))]):
        if start < skip:
            continue
        for reading in _readings(bare[start:]):
            value, used = None, 0
            try:
                value, used = decode(reading)
            except (ValueError, RecursionError):
                literal = reading[: max(reading.rfind("]"), reading.rfind("}")) + 1]
                try:
                    value, used = ast.literal_eval(literal), len(literal)
                except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                    continue
            if isinstance(value, (dict, list)):
                skip = start + used
                yield value
                break


def salvage(text: str):
    """the first object or list of a model's answer; None if there is none."""
    return next(salvaged(text), None)


@F.pandas_udf(T.StringType())
def json_salvage(text: pd.Series) -> pd.Series:
    """F33 over columns: canonical JSON or null."""
    return pd.Series([None if (v := salvage(t)) is None else json.dumps(v, sort_keys=True, ensure_ascii=False, default=str) for t in text], dtype=object)
