"""Near copies by SimHash for corpora: word shingles, a stated similarity, one document of each group stays.

Operator 7's links at two bits find only nearly equal texts. For a similarity of 0.8 over five-word shingles, documents
first meet in bands of least shingle hashes (any such pair shares a band with probability above 0.999); inside a bucket
the SimHash fingerprints are compared as bit planes with carry-save counters, lanes beyond RADIUS are left early, and
signatures put a pair in reach. These candidates make components, and inside each the links are searched once more with
the whole shingle sets: texts are linked if what they share is at least 0.8 of what both hold, and not otherwise.

Equal shingle sets are one node, buckets of equal nodes are one bucket, and a bucket gives a spanning forest of its links,
so groups of copies cost what they hold, not its square. Buckets of more than BUCKET nodes, or of more bytes than
BUCKET_BYTES, are dealt to several tasks in pairs of parts, all of which are compared.

Nulls: null and wordless texts have the same, empty, shingle set and are one group; of a group the row with the smallest
doc_id stays (rows with a null doc_id last, then the smaller row hash); of equal rows one stays. Other columns are kept,
also those named like this module's own. Very long texts: sketches take one pass, sets are kept up to SET_BYTES a task and
made again beyond that. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Rolling, release, row_key, squeezed, unsqueezed, with_row_key
from .common import discard, fresh, in_few, map_rows, materialise, mix64, scratch
from .components import components
from .simhash import _lanes, bit_planes, far
from .window_index import one_spaced, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Bits of 64 that texts of the stated similarity may differ in (mean 10, deviation 3) and still be compared further.
RADIUS = 24
#: Estimates from 144 entries have a deviation of 0.033 at 0.8; a pair is a candidate from this much below the similarity.
SLACK = 0.1
BUCKET = 4096
#: Bytes of compressed texts and sketches in a bucket that one task compares.
BUCKET_BYTES = 32 << 20
#: Bytes of a row's sketch, about.
SKETCH = 400
#: Buckets of up to so many nodes are compared together, lane i with lane i + shift.
SMALL = 16
#: Bytes of rows in one task, about, and of shingle sets that a task keeps.
TASK_BYTES = 16 << 20
SET_BYTES = 256 << 20
_MULTIPLIERS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles (A-Z lower-cased); fewer words than a shingle has are one shingle."""
    h = word_hashes(one_spaced(text).lower())[2]
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(mix64(Rolling(h).all(min(size, len(h)))))


def signature(h: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of BANDS * ROWS multipliers; zeros for an empty set."""
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    if not len(h):
        return np.zeros(BANDS * ROWS, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(low, (h[at : at + 2048, None] * _MULTIPLIERS[None, :]).min(axis=0), out=low)
    return low


def majority(h: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def sketches(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, text) -> rid, doc_id, node (hash of the shingle set), fp, bands (keys), short (16 bits of each entry)."""

    def work(columns):
        out = {"rid": columns[0], "doc_id": columns[1], "node": [], "fp": [], "bands": [], "short": []}
        for text in columns[2]:
            h = shingle_hashes(text, size)
            low = signature(h)
            band = low.reshape(BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)
            for i in range(ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + band[:, i])
            total = mix64(h.sum(dtype=np.uint64, keepdims=True) + mix64(np.array([len(h)], np.uint64)))
            out["node"].append(int(total.view(np.int64)[0]))
            out["fp"].append(majority(h))
            out["bands"].append(key.view(np.int64).tolist())
            out["short"].append((mix64(low) >> np.uint64(48)).astype(np.uint16).tobytes())
        return out

    return map_rows(rows.select("rid", "doc_id", "text"), work, "rid long, doc_id long, node long, fp long, bands array<long>, short binary")


def shift_pairs(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all rows of equal key; keys are sorted and none has more than `most` rows."""
    none = np.empty(0, np.int64)
    left, right = [none], [none]
    for shift in range(1, min(most, len(key))):
        i = np.flatnonzero(key[:-shift] == key[shift:])
        if not len(i):
            break
        left.append(i)
        right.append(i + shift)
    return np.concatenate(left), np.concatenate(right)


class Bucket:
    """Rows that are compared with each other: fingerprints, signatures and, for exact links, shingle sets."""

    def __init__(self, fps: np.ndarray, short: np.ndarray, bodies=None, similarity: float = SIMILARITY):
        self.fps, self.short, self.bodies, self.similarity = np.ascontiguousarray(fps), short, bodies, similarity
        self.need = int(np.ceil((similarity - SLACK) * short.shape[1]))
        self.sets: dict[int, np.ndarray] = {}
        self.held = 0

    def shingles(self, i: int) -> np.ndarray:
        """The sorted shingle hashes of a row, from its text; at most SET_BYTES of them are kept."""
        found = self.sets.pop(i, None)
        if found is None:
            found = shingle_hashes(unsqueezed(self.bodies[i]).decode())
            self.held += found.nbytes
        self.sets[i] = found  # the last used stands last
        while self.held > SET_BYTES and len(self.sets) > 2:
            self.held -= self.sets.pop(next(iter(self.sets))).nbytes
        return found

    def linked(self, a: int, b: int) -> bool:
        """Exact: what both sets share, of all they hold, is at least the similarity."""
        x, y = self.shingles(a), self.shingles(b)
        if min(len(x), len(y)) < self.similarity * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common >= self.similarity * (len(x) + len(y) - common)

    def estimated(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs, which agree in enough entries of their signatures."""
        ok = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 15):
            part = slice(at, at + (1 << 15))
            ok[part] = (self.short[a[part]] == self.short[b[part]]).sum(axis=1) >= self.need
        return ok

    def pairs(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Of given pairs, those that are linked: bit planes, then signatures, then (with texts) the sets."""
        if not len(a):
            return []
        p, q = bit_planes(np.ascontiguousarray(self.fps[a])), bit_planes(np.ascontiguousarray(self.fps[b]))
        near = _lanes(~far(lambda bit: p[bit] ^ q[bit], (p.shape[1],), RADIUS), len(a))
        a, b = a[near], b[near]
        ok = self.estimated(a, b)
        found = zip(a[ok].tolist(), b[ok].tolist())
        return [(x, y) for x, y in found if self.bodies is None or self.linked(x, y)]

    def forest(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """Links that span the components of some rows: breadth first, blocks of rows against all planes."""
        fps = np.ascontiguousarray(self.fps[rows])
        planes, n, out = bit_planes(fps), len(rows), []
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        waiting = np.ones(n, bool)
        while waiting.any():
            front = np.flatnonzero(waiting)[:1]
            waiting[front] = False
            while len(front):
                block, front = front[:32], front[32:]
                masks = [np.where(fps[block] >> np.uint64(b) & np.uint64(1), full, np.uint64(0))[:, None] for b in range(64)]
                near = _lanes(~far(lambda b: planes[b][None, :] ^ masks[b], (len(block), planes.shape[1]), RADIUS), n) & waiting
                at, other = np.nonzero(near)
                ok = self.estimated(rows[block[at]], rows[other])
                reached = []
                for x, y in zip(block[at[ok]].tolist(), other[ok].tolist()):
                    if waiting[y] and (self.bodies is None or self.linked(int(rows[x]), int(rows[y]))):
                        waiting[y] = False
                        reached.append(y)
                        out.append((int(rows[y]), int(rows[x])))
                front = np.append(front, np.array(reached, np.int64))
        return out


_LINKED = "a long, b long"


def _links_in_task(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(bucket, node, fp, short, maybe body) -> links within each bucket."""
    pdf = pdf.sort_values(["bucket", "node"], kind="stable")
    key, node = pdf["bucket"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    short = np.frombuffer(b"".join(pdf["short"]), np.uint16).reshape(len(pdf), -1)
    rows = Bucket(pdf["fp"].to_numpy(np.int64).view(np.uint64), short, list(pdf["body"]) if "body" in pdf else None, similarity)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    few = np.flatnonzero(np.repeat(size <= SMALL, size))
    a, b = shift_pairs(key[few], SMALL)
    found = rows.pairs(few[a], few[b])
    for i in np.flatnonzero(size > SMALL):
        found += rows.forest(np.arange(edge[i], edge[i + 1]))
    pair = np.unique(node[np.array(found, np.int64).reshape(-1, 2)], axis=0)
    return pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1]})


def _compared(met: DataFrame, nodes: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """(node, bucket, n: rows of the bucket, held: their bytes) -> links; large buckets are dealt in pairs of parts.

    nodes: (node, fp, short, weight: bytes of the row, maybe body); only weights are joined to size the tasks.
    """
    parts = F.greatest(F.ceil(F.col("n") / (bucket / 2)), F.ceil(F.col("held") / (BUCKET_BYTES / 2)))
    m = F.when((F.col("n") <= bucket) & (F.col("held") <= BUCKET_BYTES), 1).otherwise(parts).cast("int")
    dealt = met.withColumn("m", m).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("node", F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("bucket"))
    tasks = int(dealt.join(nodes.select("node", "weight"), "node").agg(F.sum("weight")).first()[0] or 0) // TASK_BYTES + 1
    rows = dealt.join(nodes.drop("weight"), "node").withColumn("task", F.pmod("bucket", F.lit(tasks)))
    return rows.groupBy("task").applyInPandas(lambda pdf: _links_in_task(pdf, similarity), _LINKED)


def _buckets(keyed: DataFrame) -> DataFrame:
    """(node, key, weight) -> node, bucket, n, held: keys with the same nodes are one bucket, keys with one node none."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("held"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    return materialise(keyed.join(sizes, "key").select("node", F.xxhash64("n", "members").alias("bucket"), "n", "held").distinct(), "bands")


def links(nodes: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(node, fp, bands, short) -> candidate links (a, b): pairs that their signatures put above the similarity less SLACK."""
    weighed = nodes.withColumn("weight", F.lit(SKETCH).cast("long"))
    met = _buckets(weighed.select("node", F.explode("bands").alias("key"), "weight"))
    return _compared(met, weighed.select("node", "fp", "short", "weight"), similarity, bucket)


def exact_links(nodes: DataFrame, near: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that span what shingle sets of at least the similarity connect.

    near: (node, root), the components of the candidate links, outside which no link is looked for. A component of up to
    `bucket` nodes and BUCKET_BYTES is one bucket; the nodes of a larger one meet in their bands again. texts: (node, body).
    """
    weighed = texts.withColumn("weight", F.length("body").cast("long") + SKETCH)
    light = weighed.select("node", "weight")
    sizes = materialise(in_few(near.join(light, "node").groupBy("root").agg(F.count("*").alias("size"), F.sum("weight").alias("held")), near.count()), "sizes")
    placed, one = near.join(sizes, "root"), (F.col("size") <= bucket) & (F.col("held") <= BUCKET_BYTES)
    whole = placed.where(one).select("node", F.col("root").alias("bucket"), F.col("size").alias("n"), "held")
    large = placed.where(~one).select("node", "root").join(nodes.select("node", "bands"), "node").join(light, "node")
    banded = _buckets(large.select("node", F.explode("bands").alias("band"), "root", "weight").select("node", F.xxhash64("root", "band").alias("key"), "weight"))
    return _compared(whole.union(banded), nodes.select("node", "fp", "short").join(weighed, "node"), similarity, bucket)


def groups(docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text) -> rid (a hash of doc_id and text), doc_id, root (of its group), one row per row of docs."""
    rows = with_row_key(docs)
    made = materialise(sketches(rows), "sketches")
    one = made.groupBy("node").agg(F.min("rid").alias("rid"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    nodes = materialise(in_few(one, made.count()), "nodes")
    near = materialise(components(links(nodes, similarity, bucket)), "near")
    release(docs.sparkSession)
    # the text of one row for each node that has a candidate
    packed = map_rows(rows.select("rid", "text"), lambda c: {"rid": c[0], "body": squeezed(c[1])}, "rid long, body binary")
    texts = packed.join(near.join(nodes.select("node", "rid"), "node").select("rid", "node"), "rid").groupBy("node").agg(F.first("body").alias("body"))
    texts = materialise(texts, "texts")
    release(docs.sparkSession)
    roots = components(exact_links(nodes, near, texts, similarity, bucket))
    discard(texts)
    return made.select("rid", "doc_id", "node").join(roots, "node", "left").select("rid", "doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, all columns as they are."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    key, copy = fresh(docs, "rid"), fresh(docs, "copy")
    with scratch():
        first = materialise(groups(docs, similarity).groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.rid").alias(key)), "first", stays=True)
    kept = docs.withColumn(key, row_key()).join(first, key, "left_semi")
    return kept.withColumn(copy, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(copy) == 1).select(*docs.columns)
