"""Similarity of question stems, and which stems differ in their mathematical data."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import plain, quantity

#: From which similarity on stems are too similar. Fixed value.
SIMILAR = 0.84
#: What normalised text keeps. Fixed value.
_KEPT = re.compile(r"[^a-z0-9√π%+\-*/=.^∪∩∈∉⊂⊆⊃⊇≤≥≠<>²³{}\[\]]+")


def normal(text) -> str:
    return " ".join(_KEPT.sub(" ", str(text or "").lower()).split())


def pairs(text: str) -> set:
    t = normal(text).split()
    return set(zip(t, t[1:])) if len(t) > 1 else {tuple(t)} - {()}


def similarity(a: str, b: str) -> float:
    """The larger of the character ratio and the shared part of word pairs."""
    x, y = normal(a), normal(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    p, q = pairs(a), pairs(b)
    return max(SequenceMatcher(None, x, y).ratio(), len(p & q) / max(1, len(p | q)))


@lru_cache(maxsize=1 << 16)
def _parts(text) -> tuple[str, Counter, set]:
    form = normal(text)
    return form, Counter(form), pairs(text)


def similarity_from(a: str, b: str, threshold: float) -> float:
    """similarity() where it reaches the threshold, else something below: characters are only aligned where enough are shared."""
    (x, cx, p), (y, cy, q) = _parts(a), _parts(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    words = len(p & q) / max(1, len(p | q))
    if 2 * sum(min(n, cy[c]) for c, n in cx.items()) / (len(x) + len(y)) < threshold - 1e-6:
        return words
    return max(SequenceMatcher(None, x, y).ratio(), words)


def _data(text: str) -> tuple[dict, Counter, Counter]:
    sets = {n: tuple(sorted({plain(e) for e in body.split(",")})) for n, body in re.findall(r"\b([A-Z])\s*=\s*\{([^{}]*)\}", text)}
    bare = re.sub(r"\b(?:question|item|fixture)\s+[\w-]+", "", text, flags=re.I).replace("−", "-")
    numbers = Counter(str(q[0]) for m in re.findall(r"(?<![\w.])[+-]?\d+(?:\.\d+)?(?:/\d+)?%?", bare) if (q := quantity(plain(m))))
    signs = Counter(re.findall(r"[∪∩∈∉⊂⊆⊃⊇≤≥≠<>]|\b(?:union|intersection|complement)\b", bare.lower()))
    return sets, numbers, signs


def different_data(a: str, b: str) -> bool:
    """Whether both stems state sets, numbers or set operators, and not the same ones."""
    (s1, n1, o1), (s2, n2, o2) = _data(a), _data(b)
    other_sets = bool(s1 and s2) and s1 != s2 and sorted(s1.values()) != sorted(s2.values())
    return other_sets or any(bool(x and y) and x != y for x, y in ((n1, n2), (o1, o2)))


def too_similar(a: str, b: str, threshold: float = SIMILAR) -> bool:
    return similarity(a, b) >= threshold and not different_data(a, b)


@F.pandas_udf(T.DoubleType())
def stem_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(similarity(x, y), 6) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.BooleanType())
def is_too_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([too_similar(x, y) for x, y in zip(a, b)], dtype=bool)


def keep_first(stems: list[tuple[str, str]], threshold: float = SIMILAR) -> list[int]:
    """Places of the (concept, stem) kept in order: a stem goes if its normal form was kept before anywhere, or a similar
    one was kept before in its concept; empty stems always stay."""
    kept, seen, by_concept = [], set(), {}
    for i, (concept, stem) in enumerate(stems):
        form = normal(stem)
        mine = by_concept.setdefault(concept, [])
        if form and (form in seen or any(too_similar(stem, other, threshold) for other in mine)):
            continue
        kept.append(i)
        if form:
            seen.add(form)
            mine.append(stem)
    return kept
