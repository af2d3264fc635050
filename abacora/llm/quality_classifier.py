"""Operator 4: quality classifier by an interpolated modified Kneser-Ney model of trusted text.

The model is of three code points, per language, from all documents that are labelled good and not toxic; which these are
is found by a join, so their number has no bound. Its tables stay distributed: counts, discounts, context totals and lower orders are joined by
shuffles. For scoring, each input split lists the strings it holds; the list is priced by joins with the tables and comes
back to the split's documents, so what is gathered grows with the input and no table needs to fit in one place.
Documents go whose log perplexity lies above their language's quantile: its distance from the median of the trusted
documents, times the square root of the length (short texts scatter more; so measured, all lengths scatter alike), is above
the QUANTILE of the same measure over the trusted documents of that language.

Nulls: a null or empty text has no perplexity and is kept, as is a document of a language without trusted text; a null lang
is a language of its own; a null doc_id is carried along and never trusted. Repeated rows are judged one by one, a value at
the threshold is kept. Very long texts are counted and scored in pieces. Empty tables give no rows (documents) or keep all
(labels). Other columns are ignored; keep_good() keeps them as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import release, squeezed, unsqueezed
from .common import fresh, in_few, map_rows, materialise, mix64, scratch, table, text_or_empty

QUANTILE = 0.999
#: Quantiles are exact up to half as many trusted documents of a language; of more, ranks are off by one in so many.
ACCURACY = 200_000
POINT = 21  # bits of a code point; 0x110000 stands before a text
PAD = 0x110000
#: Rows in a block of documents that are scored together, about.
BLOCK_ROWS = 4096
#: Above this many languages their quantiles are joined, not sent to the tasks.
LANGUAGES = 10_000


def grams(text: str) -> np.ndarray:
    """For each character, the packed code points of it and the two before it."""
    p = np.full(len(text) + 2, PAD, np.int64)
    p[2:] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (p[:-2] << 2 * POINT) | (p[1:-1] << POINT) | p[2:]


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed strings of some texts and how often; texts are taken in pieces, so memory is bounded."""
    keys, times, held = [], [], 0
    pending: list[np.ndarray] = []

    def fold():
        k, n = np.unique(np.concatenate(pending), return_counts=True)
        keys.append(k)
        times.append(n)
        pending.clear()

    for t in texts:
        pending.append(grams(t))
        held += len(t)
        if held > 2_000_000:
            fold()
            held = 0
    if pending:
        fold()
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(times)).astype(np.int64)


def _counted(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys..., text) -> keys..., g, n for each Arrow batch."""
    types = ", ".join(f"{k} {t}" for k, t in rows.dtypes if k in keys).replace("bigint", "long")

    def work(columns):
        groups: dict[tuple, list[str]] = {}
        for *key, text in zip(*columns):
            if text:
                groups.setdefault(tuple(key), []).append(text)
        made = [(key, *_distinct(texts)) for key, texts in groups.items()]
        out = {name: [key[i] for key, g, _ in made for _ in range(len(g))] for i, name in enumerate(keys)}
        out["g"] = np.concatenate([np.empty(0, np.int64), *(g for _, g, _ in made)])
        out["n"] = np.concatenate([np.empty(0, np.int64), *(n for *_, n in made)])
        return out

    return map_rows(rows.select(*keys, "text"), work, f"{types}, g long, n long")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def _order(c: DataFrame, lower: DataFrame | None, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, g, n) and the lower order (lang, g, p) -> this order (lang, g, p) and (lang, ctx, share)."""
    k = [F.count_if(F.col("n") == i) for i in range(1, 5)]
    y = k[0] / (k[0] + 2 * k[1])
    d = [F.greatest(F.lit(0.05), F.least(F.lit(i + 0.95), F.try_subtract(F.lit(i + 1.0), F.try_divide((i + 2) * y * k[i + 1], k[i])))) for i in range(3)]
    whole = F.least(*k) > 0
    spare = (0.5, 0.75, 0.9)
    per_lang = c.groupBy("lang").agg(*(F.when(whole, d[i]).otherwise(F.lit(spare[i])).alias(f"d{i + 1}") for i in range(3)), F.count("*").alias("kinds"))
    ctx: Column = F.shiftright("g", POINT)
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    taken = c.join(F.broadcast(per_lang) if _few(per_lang) else per_lang, "lang").select("lang", "g", "n", "kinds", ctx.alias("ctx"), discount.alias("d"))
    shares = taken.groupBy("lang", "ctx").agg((F.sum("d") / F.sum("n")).alias("share"), F.sum("n").alias("total"))
    both = taken.join(shares, ["lang", "ctx"])
    if lower is None:
        below = 1.0 / (F.col("kinds") + 1)
    else:
        both = both.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << bits) - 1))).join(lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        below = F.col("below")
    return both.select("lang", "g", ((F.col("n") - F.col("d")) / F.col("total") + F.col("share") * below).alias("p")), shares.select("lang", "ctx", "share")


def _few(per_lang: DataFrame) -> bool:
    return len(per_lang.select("lang").limit(LANGUAGES + 1).collect()) <= LANGUAGES


def model(trusted: DataFrame) -> dict[str, DataFrame]:
    """(lang, text) -> the three orders' probabilities and shares, as written tables."""
    return model_of_counts(_counted(trusted, ("lang",)))


def model_of_counts(counted: DataFrame) -> dict[str, DataFrame]:
    """(lang, g, n) in parts -> the tables of model()."""
    c3 = materialise(counted.groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    low = lambda c, bits: c.groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << bits) - 1)).alias("g")).agg(F.count("*").alias("n"))
    n3 = c3.count()
    c2 = materialise(in_few(low(c3, 2 * POINT), n3), "grams")
    n2 = c2.count()
    c1 = materialise(in_few(low(c2, POINT), n2), "grams")
    p1, _ = _order(c1, None, 0)
    p1 = materialise(in_few(p1, c1.count()), "order")
    p2, share2 = _order(c2, p1, POINT)
    p2, share2 = materialise(in_few(p2, n2), "order"), materialise(in_few(share2, n2), "share")
    p3, share3 = _order(c3, p2, 2 * POINT)
    return {"p1": p1, "p2": p2, "p3": materialise(in_few(p3, n3), "order"), "share2": share2, "share3": materialise(in_few(share3, n3), "share")}


def priced(needed: DataFrame, m: dict[str, DataFrame]) -> DataFrame:
    """(lang, g) -> lang, g, logp: by the longest order that has seen the string; only languages that have a model."""
    known = m["p1"].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("unseen"))
    q = needed.join(F.broadcast(known) if _few(known) else known, "lang").withColumns({"g2": F.col("g").bitwiseAND(F.lit((1 << 2 * POINT) - 1)), "g1": F.col("g").bitwiseAND(F.lit((1 << POINT) - 1)), "x2": F.shiftright("g", POINT)})
    q = q.withColumn("x1", F.shiftright("g2", POINT))
    for key, name, column in (("g", "p3", "g"), ("g2", "p2", "g"), ("g1", "p1", "g"), ("x2", "share3", "ctx"), ("x1", "share2", "ctx")):
        value = "p" if name[0] == "p" else "share"
        q = q.join(m[name].select("lang", F.col(column).alias(key), F.col(value).alias(name)), ["lang", key], "left")
    two = F.coalesce("p2", F.coalesce("share2", F.lit(1.0)) * F.coalesce("p1", "unseen"))
    return q.select("lang", "g", F.log(F.coalesce("p3", F.coalesce("share3", F.lit(1.0)) * two)).cast("float").alias("logp"))


_SCORES = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("log_ppl", pa.float64())])


class SortedHashes:
    """A block's part of a model: log probabilities in an array sorted by a 64-bit hash of their strings (a bijective one, so
    that no two strings share it)."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        h = mix64(keys.view(np.uint64))
        order = np.argsort(h)
        self.hashes, self.logs = h[order], logs[order].astype(np.float64)

    def log_perplexity(self, text: str) -> float:
        g, total = grams(text), 0.0
        for at in range(0, len(g), 1 << 20):
            total -= self.logs[np.searchsorted(self.hashes, mix64(g[at : at + (1 << 20)].view(np.uint64)))].sum()
        return float(total / len(g))


def _score_block(docs: pa.Table, prices: pa.Table) -> pa.Table:
    keys, logs = prices.column("g").to_numpy(), prices.column("logp").to_numpy()
    langs = np.array(prices.column("lang").to_pylist(), object)
    models = {lang: SortedHashes(keys[langs == lang], logs[langs == lang]) for lang in set(langs.tolist())}
    out = {f.name: [] for f in _SCORES}
    for doc, rid, lang, body in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "rid", "lang", "body"))):
        text = unsqueezed(body).decode()
        value = models[lang].log_perplexity(text) if text and lang in models else None
        for name, x in zip(out, (doc, rid, lang, len(text), value)):
            out[name].append(x)
    return pa.table(out, _SCORES)


def in_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> block, doc_id, rid (a hash of the row), lang, text.

    A block is made of whole input splits, so that its strings are mostly counted before the shuffle; there is about one
    for each BLOCK_ROWS rows, however many splits they lie in, so that lists of strings do not grow with the splits.
    """
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, docs.rdd.getNumPartitions())))  # where rows come from no file
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.when(F.input_file_name() == "", spread))
    block = F.pmod(split, F.lit(docs.count() // BLOCK_ROWS + 1))
    return docs.select(block.alias("block"), "doc_id", F.xxhash64("doc_id", "lang", "text").alias("rid"), F.coalesce("lang", F.lit("")).alias("lang"), text_or_empty().alias("text"))


def listed(rows: DataFrame) -> DataFrame:
    """block, lang, g, n: the strings of each block, written."""
    return materialise(_counted(rows.select("block", "lang", "text"), ("block", "lang")).groupBy("block", "lang", "g").agg(F.sum("n").alias("n")), "lists")


def bodies_of(rows: DataFrame) -> DataFrame:
    """in_blocks() with the texts compressed, for shuffles."""
    return map_rows(rows.select("block", "doc_id", "rid", "lang", "text"), lambda c: {"block": c[0], "doc_id": c[1], "rid": c[2], "lang": c[3], "body": squeezed(c[4])}, "block long, doc_id long, rid long, lang string, body binary")


def cogrouped(rows: DataFrame, lists: DataFrame, m: dict[str, DataFrame], work, schema: str) -> DataFrame:
    """work over each block's documents (text compressed in body) and the prices of its strings."""
    prices = lists.select("block", "lang", "g").join(materialise(in_few(priced(lists.select("lang", "g").distinct(), m), lists.count()), "prices"), ["lang", "g"])
    return bodies_of(rows).groupBy("block").cogroup(prices.select("block", "lang", "g", "logp").groupBy("block")).applyInArrow(work, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, rid (a hash of the row), lang, n_chars, log_ppl, trusted."""
    rows = in_blocks(docs)
    ids = materialise(trusted_ids(labels), "trusted").hint("shuffle_hash")  # as many as there are, so never sent to all tasks
    own = bodies_of(rows).join(ids, "doc_id", "left_semi").select("lang", "body")
    m = model(map_rows(own, lambda c: {"lang": c[0], "text": [unsqueezed(b).decode() for b in c[1]]}, "lang string, text string"))
    release(docs.sparkSession)
    found = cogrouped(rows, listed(rows), m, _score_block, "doc_id long, rid long, lang string, n_chars long, log_ppl double")
    return found.join(ids.withColumn("trusted", F.lit(True)).hint("shuffle_hash"), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def limits(found: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Scores -> lang, middle, reach: the median of its trusted documents, and the quantile of how far they lie above it."""
    trusted = found.where("trusted and log_ppl is not null").select("lang", "n_chars", "log_ppl")
    middle = materialise(trusted.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, ACCURACY).alias("middle")), "middle")
    away = trusted.join(F.broadcast(middle) if _few(middle) else middle, "lang").withColumn("away", (F.col("log_ppl") - F.col("middle")) * F.sqrt("n_chars"))
    return away.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx("away", quantile, ACCURACY).alias("reach"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang) -> doc_id, rid, lang, n_chars, perplexity, threshold, kept."""
    with scratch():
        found = materialise(scores(docs, labels), "scores", stays=True)
        bounds = materialise(limits(found), "limits", stays=True)
    joined = found.join(F.broadcast(bounds) if _few(bounds) else bounds, "lang", "left")
    top = F.when(F.col("n_chars") > 0, F.col("middle") + F.col("reach") / F.sqrt("n_chars"))
    kept = F.coalesce((F.col("log_ppl") - F.col("middle")) * F.sqrt("n_chars") <= F.col("reach"), F.lit(True))
    return joined.select("doc_id", "rid", "lang", "n_chars", F.exp("log_ppl").alias("perplexity"), F.exp(top).alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that verdicts() keeps, all columns as they are."""
    key = fresh(docs, "rid")
    bad = verdicts(docs.select("doc_id", "text", "lang"), labels).where("not kept").select(F.col("rid").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "lang", "text")).join(bad, key, "left_anti").select(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return verdicts(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")).select("doc_id", "lang", "n_chars", "perplexity", "threshold", "kept")
