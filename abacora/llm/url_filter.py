"""Operator 3: URL filter by rules and a character language-model ratio.

Rules decide where one fits. The other URLs are judged by two smoothed variable-order Markov models, of the URLs that rules
allow and of those they block: the difference of log-likelihoods per character, against a threshold calibrated on a fifth
of the labelled URLs that the models have not seen. Models are counts of 4-symbol strings over 40 symbols, so they have at
most 2 * 40**4 cells whatever the input; counts are made by all tasks over all labelled URLs.

The models read whole URLs, scheme, query string and fragment included; host and path are for the rules only.

Nulls: a null URL has an empty host and path, no rule, and the score 0 that an empty URL has; one without "://" has an empty
host and path and is scored as it stands. With no labelled URLs every score and the threshold are 0, which allows; so does a
score at the threshold. A null page_id is carried along, repeated rows are judged one by one, very long URLs are taken whole,
an empty table gives no rows, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: (verdict, host, path). Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Symbols: 0 pads, 1-26 letters, 27 digits, then these signs, then other ASCII, then all else.
SIGNS = "./-_%=&~:?"
SYMBOLS = 40
ORDER = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the labelled URLs, one in FOLDS is held out for calibration.
FOLDS = 5
BINS = 400


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule = verdict = None
    for says, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(says))
    return rule, verdict


def symbol_table() -> np.ndarray:
    t = np.full(0x110000, SYMBOLS - 1, np.uint8)
    t[:128] = SYMBOLS - 2
    t[97:123] = np.arange(1, 27)
    t[65:91] = np.arange(1, 27)
    t[48:58] = 27
    for i, c in enumerate(SIGNS):
        t[ord(c)] = 28 + i
    return t


_STATE: dict = {}


def codes(text: str) -> np.ndarray:
    """The strings of ORDER symbols that end at each character, packed into integers; pads stand before the text."""
    if "t" not in _STATE:
        _STATE["t"] = symbol_table()
    s = _STATE["t"][np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
    s = np.concatenate([np.zeros(ORDER - 1, np.int64), s])
    out = np.zeros(len(s) - ORDER + 1, np.int64)
    for i in range(ORDER):
        out = out * SYMBOLS + s[i : len(out) + i]
    return out


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(verdict, page) -> verdict, code, n; summed within each batch before anything is shuffled."""

    def work(columns):
        out = {"verdict": [], "code": [], "n": []}
        for says in ("allow", "block"):
            c = [codes(p) for v, p in zip(*columns) if v == says]
            if c:
                code, n = np.unique(np.concatenate(c), return_counts=True)
                out["verdict"] += [says] * len(code)
                out["code"] += code.tolist()
                out["n"] += n.tolist()
        return out

    return map_rows(labelled, work, "verdict string, code long, n long").groupBy("verdict", "code").agg(F.sum("n").alias("n"))


def log_model(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of every packed string: each order leans on the next shorter one by the number of
    symbols seen behind its context (Witten-Bell), the shortest on the uniform distribution."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for k in range(1, ORDER + 1):
        count = np.bincount(code % SYMBOLS**k, n, SYMBOLS**k).reshape(-1, SYMBOLS)
        kinds = (count > 0).sum(axis=1, keepdims=True)
        total = count.sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if k > 1 else 1, 1))
        p = np.where(total > 0, (count + kinds * shorter) / np.maximum(total + kinds, 1), shorter).reshape(-1)
    return np.log(p)


def log_ratio(counts: pd.DataFrame) -> np.ndarray:
    both = [log_model(c["code"].to_numpy(np.int64), c["n"].to_numpy(np.float64)) for c in (counts[counts["verdict"] == v] for v in ("allow", "block"))]
    return (both[0] - both[1]).astype(np.float32)


def scores(pages: DataFrame, ratio: np.ndarray, column: str = "page") -> DataFrame:
    """Adds score: the ratio's mean over the characters of a column (0 for an empty text)."""
    shared = pages.sparkSession.sparkContext.broadcast(ratio)  # SYMBOLS ** ORDER cells

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        r = shared.value
        return pd.Series([float(r[codes(t)].mean(dtype=np.float64)) if t else 0.0 for t in texts.fillna("")], dtype="float64")

    return pages.withColumn("score", score(F.col(column)))


def calibrated(held: DataFrame) -> float:
    """The threshold with the best mean of both classes' accuracies on held-out labelled URLs, from a histogram of scores."""
    low, high = -4.0, 4.0
    cell = F.floor((F.least(F.greatest("score", F.lit(low)), F.lit(high)) - low) / (high - low) * BINS).cast("int")
    n = np.zeros((2, BINS + 1))
    for r in held.groupBy("verdict", cell.alias("cell")).count().collect():
        n[int(r["verdict"] == "allow"), r["cell"]] += r["count"]
    blocked, allowed = n
    if not blocked.sum() or not allowed.sum():
        return 0.0
    right = np.r_[0, np.cumsum(blocked)] / blocked.sum() + 1 - np.r_[0, np.cumsum(allowed)] / allowed.sum()
    best = np.flatnonzero(right == right.max())
    return float(low + (high - low) * best[len(best) // 2] / BINS)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("page")).withColumns({"rule": rule, "says": says})
    labelled = parts.where("says is not null").select(F.col("says").alias("verdict"), "page", (F.pmod(F.xxhash64("page"), F.lit(FOLDS)) == 0).alias("held"))
    ratio = log_ratio(gram_counts(labelled.where("not held").select("verdict", "page")).toPandas())
    threshold = calibrated(scores(labelled.where("held"), ratio))
    return scores(parts, ratio).select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
