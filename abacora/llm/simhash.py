"""Operator 7: SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 (seed 42) of word shingles. Equal fingerprints are one node. Nodes
meet where two of radius + 2 bit blocks agree, which any pair within the radius does at least once. Inside such a bucket
fingerprints lie as vertical bit planes; distances of many lanes grow together in carry-save counters, and a block of
lanes is left as soon as all exceed the radius. A bucket yields a spanning forest of its links, not all pairs. Buckets
with more than BUCKET nodes are linked exactly another way: each node is also put under each of its one-bit variants, and
nodes within two bits share a variant, under which at most 65 nodes can lie.

Nulls: a null or wordless text has fingerprint 0, linked like any other; a null doc_id is carried along and never becomes
a component_id unless its component has no other. Repeated rows and ties share fingerprint and component. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, map_rows, materialise, scratch, table, words
from .components import components

SEED = 42
BUCKET = 4096
#: Nodes handled together in one task, about.
TASK_NODES = 60_000
SMALL = 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    w = words(ascii_lower(text))
    if not w:
        return 0
    if len(w) < shingle:
        parts = [" ".join(w)]
    else:
        parts = list(map(" ".join, zip(*(w[i:] for i in range(shingle)))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(p, seed) for p in parts], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (the fingerprint's bits as a signed long)."""

    def work(columns):
        return {"doc_id": columns[0], "fp": np.array([fingerprint(t or "", shingle) for t in columns[1]], np.uint64).view(np.int64)}

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """[64, words]: plane b holds bit b of all fingerprints, 64 lanes a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def far(difference, shape: tuple[int, ...], radius: int, over: np.ndarray | None = None) -> np.ndarray:
    """Lanes whose distance exceeds the radius; difference(b) gives bit b's differences, as words of lanes.

    Counters are vertical: counters[k] holds bit k of every lane's count. `over` may rule lanes out from the start.
    """
    width = int(radius + 1).bit_length()
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64) if over is None else over.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        carry = difference(b)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b >= radius and (b % 4 == 3 or b == 63):
            over |= _more_than(counters, radius)
            if (over == full).all():
                break
    return over


def _more_than(counters: list[np.ndarray], radius: int) -> np.ndarray:
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return more


def _lanes(near: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(near.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one bucket: breadth first, a block of nodes against all planes at a time."""
    planes, n, out = bit_planes(fps), len(fps), []
    waiting = np.ones(n, bool)
    while waiting.any():
        front = np.flatnonzero(waiting)[:1]
        waiting[front] = False
        while len(front):
            block, front = front[:64], front[64:]
            q = fps[block]
            masks = [np.where(q >> np.uint64(b) & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None] for b in range(64)]
            near = _lanes(~far(lambda b: planes[b][None, :] ^ masks[b], (len(block), planes.shape[1]), radius), n) & waiting
            found = np.flatnonzero(near.any(axis=0))
            if len(found):
                out.append((fps[found], fps[block[near[:, found].argmax(axis=0)]]))
                waiting[found] = False
                front = np.append(front, found)
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key; keys may be many. Small buckets are compared together, lane i with lane i + shift."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], np.ascontiguousarray(fps[order])
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    ks, fs = keys[small], np.ascontiguousarray(fps[small])
    for shift in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        if shift >= len(ks):
            break
        left, right = fs[:-shift], np.ascontiguousarray(fs[shift:])
        meet = np.flatnonzero(ks[:-shift] == ks[shift:])
        if not len(meet):
            break
        left, right = np.ascontiguousarray(left[meet]), np.ascontiguousarray(right[meet])
        p, q = bit_planes(left), bit_planes(right)
        near = _lanes(~far(lambda bit: p[bit] ^ q[bit], (p.shape[1],), radius), len(meet))
        a.append(left[near])
        b.append(right[near])
    for i in np.flatnonzero(sizes > SMALL):
        for x, y in forest(np.ascontiguousarray(fps[bounds[i] : bounds[i + 1]]), radius):
            a.append(x)
            b.append(y)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def block_keys(radius: int) -> list[F.Column]:
    """For each pair of radius + 2 bit blocks, a key of both blocks' bits (and of which pair it is)."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    out = []
    for k, (i, j) in enumerate(combinations(range(n), 2)):
        mask = masks[i] | masks[j]
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return out


def links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what links within the radius connect."""
    keyed = nodes.select("fp", F.explode(F.array(*block_keys(radius))).alias("k")).select("fp", F.xxhash64("k.pair", "k.bits").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, "key"), "buckets")
    tasks = with_rows(shared)
    pairs = (
        shared.where(F.col("n") <= bucket)
        .groupBy(F.pmod("key", F.lit(tasks)).alias("task"))
        .applyInPandas(lambda pdf: _linked(pdf, radius), "a long, b long")
    )
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    if radius != 2:
        if crowded.take(1):
            raise ValueError("buckets beyond their bound can be linked by variants for a radius of 2 only")
        return pairs
    flips = [0, *(1 << b for b in range(63)), -(1 << 63)]
    variants = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in flips))).alias("near"))
    met = variants.withColumn("low", F.min("fp").over(Window.partitionBy("near"))).where("low <> fp").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.union(met)


def with_rows(df: DataFrame) -> int:
    return df.count() // TASK_NODES + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _linked(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    a, b = bucket_links(pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64), radius)
    pair = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0)
    return pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1]})


def near_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp) -> doc_id, fp, component_id: the smallest doc_id reachable over links, itself included."""
    with scratch():
        nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
        roots = components(links(nodes.select("fp"), radius))
        named = materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
        lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
        known = materialise(named.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "known", stays=True)
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialise(fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")), "fingerprints")
    return near_components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
