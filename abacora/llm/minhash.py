"""Operator 11: near-duplicates by b-bit MinHash, links confirmed on full shingle sets.

Each document's set of word shingles has BANDS * ROWS minima. Whole minima make the band keys; of each minimum only the low
BITS bits are kept, packed as bit planes. Documents meet where a band agrees; there the number of agreeing entries, counted on
the planes, is corrected for the share 2**-BITS of entries that agree by chance, and what stays SLACK or more below the
asked similarity is left. These candidates make components, and inside each the links are decided by the whole sets in
integers. At exactly 0.8 a pair shares no band with probability 1.3e-7 and is estimated too low with about 5e-7.

Equal sets are one node. A bucket yields links that span its components, not all pairs. Buckets are cut by the bytes they
hold: first every part is linked in itself and with one common node; then the nodes that this did not connect to the common
node's component, and they alone, meet all others. So a group of near copies of any size costs what it holds, no pair of
different components stays unseen, and no task holds more than a bounded number of bytes (a very long text as such aside).

Nulls: a null, empty or wordless text has an empty set and is linked with nothing, not even its like. A null doc_id is
carried along; it is a component_id only where its component has no other, and such rows are kept (kept is true where doc_id
and component_id are the same, null or not). Repeated rows have equal sets and share a component. Very long texts are read
whole; a set is made again from its text where a task cannot keep all. Ties do not arise: minima of components are unique.
An empty table gives no rows. Other columns are ignored, also those named like this module's own.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import release, squeezed, unsqueezed
from .common import map_rows, materialise, mix64, scratch, table
from .components import components
from .near_copies import shift_pairs, shingle_hashes

SHINGLE, PERCENT = 4, 80
BANDS, ROWS, BITS = 40, 5, 4
SIZE = BANDS * ROWS
WORDS = -(-SIZE // 64)
#: The estimate's deviation at 0.8 is 0.03; candidates begin five of them below the asked similarity.
SLACK = 0.15
#: Bytes of one part of a bucket: sketches (about 4,096 of them), and texts.
SKETCH_BYTES = 200
PART_SKETCHES, PART_TEXTS = 4096 * SKETCH_BYTES, 16 << 20
#: Bytes of rows in one task, about, and of shingle sets that a task keeps.
TASK_BYTES = 16 << 20
SET_BYTES = 256 << 20
#: Cells of up to so many rows are compared together, lane i with lane i + shift.
SMALL = 16
_MULTIPLIERS = mix64(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of SIZE multipliers."""
    low = np.full(SIZE, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 512):
        np.minimum(low, (h[at : at + 512, None] * _MULTIPLIERS[None, :]).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """The low BITS bits of each (mixed) minimum, one plane of SIZE bits after another."""
    low = mix64(low)
    planes = np.zeros((BITS, WORDS * 64), np.uint8)
    for b in range(BITS):
        planes[b, :SIZE] = (low >> np.uint64(b)) & np.uint64(1)
    return np.packbits(planes, axis=1, bitorder="little").tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    band = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + band[:, i])
    return key.view(np.int64)


def need(percent: int) -> int:
    """How many entries of two signatures must agree for the corrected estimate to be in reach of the similarity."""
    chance = 2.0**-BITS
    return int(np.ceil(SIZE * (chance + (percent / 100 - SLACK) * (1 - chance))))


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> row, doc_id, n (size of the set), digest (of the whole set), bands, planes, body (the text, compressed)."""

    def work(columns):
        out = {"row": columns[0], "doc_id": columns[1], "n": [], "digest": [], "bands": [], "planes": [], "body": []}
        for text in columns[2]:
            h = shingle_hashes(text or "", size)
            low = minima(h) if len(h) else None
            out["n"].append(len(h))
            out["digest"].append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            out["bands"].append(band_keys(low).tolist() if len(h) else None)
            out["planes"].append(packed(low) if len(h) else None)
            out["body"].append(squeezed([text])[0] if len(h) else None)
        return out

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return map_rows(numbered, work, "row long, doc_id long, n long, digest binary, bands array<long>, planes binary, body binary")


class Held:
    """Rows of one task: planes, set sizes and, for exact links, texts whose sets are made when asked for."""

    def __init__(self, pdf: pd.DataFrame, percent: int, size: int):
        self.planes = np.frombuffer(b"".join(pdf["planes"]), np.uint64).reshape(len(pdf), BITS, WORDS)
        self.n = pdf["n"].to_numpy(np.int64)
        self.bodies = list(pdf["body"]) if "body" in pdf else None
        self.percent, self.size, self.need = percent, size, need(percent)
        self.sets: OrderedDict[int, np.ndarray] = OrderedDict()
        self.bytes = 0

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of rows (arrays that broadcast), which are candidates: sizes first, then agreeing entries."""
        x, y = self.n[a], self.n[b]
        ok = 100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)
        p, q = self.planes[a], self.planes[b]
        differ = np.bitwise_or.reduce(p ^ q, axis=-2)
        return ok & (SIZE - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) >= self.need)

    def shingles(self, i: int) -> np.ndarray:
        found = self.sets.pop(i, None)
        if found is None:
            found = shingle_hashes(unsqueezed(self.bodies[i]).decode(), self.size)
            self.bytes += found.nbytes
        self.sets[i] = found
        while self.bytes > SET_BYTES and len(self.sets) > 2:
            self.bytes -= self.sets.popitem(last=False)[1].nbytes
        return found

    def linked(self, a: int, b: int) -> bool:
        """Exact, in integers: 100 * intersection >= percent * union. Sketches alone link every candidate."""
        if self.bodies is None:
            return True
        x, y = self.shingles(a), self.shingles(b)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def connect(self, rows: np.ndarray, label: np.ndarray, active: np.ndarray) -> list[tuple[int, int]]:
        """Links between rows of one cell that join different labels; each pair with an active row is looked at until one label is left."""
        label, found, left = label.copy(), [], len(np.unique(label))
        for x in active:
            if left == 1:
                break
            other = np.flatnonzero(label != label[x])
            other = other[self.near(rows[x : x + 1], rows[other])]
            for y in other.tolist():
                if label[y] != label[x] and self.linked(int(rows[x]), int(rows[y])):
                    found.append((int(rows[x]), int(rows[y])))
                    label[label == label[y]] = label[x]
                    left -= 1
        return found


def _links(pdf: pd.DataFrame, percent: int, size: int) -> pd.DataFrame:
    """(cell, node, label, active, n, planes, maybe body) -> links within each cell."""
    pdf = pdf.sort_values(["cell", "node"], kind="stable").drop_duplicates(["cell", "node"])
    cell, node = pdf["cell"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
    label, active = pdf["label"].to_numpy(np.int64), pdf["active"].to_numpy(bool)
    held = Held(pdf, percent, size)
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    sizes = np.diff(edge)
    few = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    a, b = (few[x] for x in shift_pairs(cell[few], SMALL))
    found = []
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        ok = (label[x] != label[y]) & (active[x] | active[y])
        x, y = x[ok], y[ok]
        ok = held.near(x, y)
        found += [(i, j) for i, j in zip(x[ok].tolist(), y[ok].tolist()) if held.linked(i, j)]
    for i in np.flatnonzero(sizes > SMALL):
        rows = np.arange(edge[i], edge[i + 1])
        found += held.connect(rows, label[rows], np.flatnonzero(active[rows]))
    pair = np.unique(node[np.array(found, np.int64).reshape(-1, 2)], axis=0)
    return pd.DataFrame({"a": pair[:, 0], "b": pair[:, 1]})


def _compared(cells: DataFrame, held: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, w, cell, label, active) -> links (a, b), written."""
    tasks = int(cells.agg(F.sum("w")).first()[0] or 0) // TASK_BYTES + 1
    rows = cells.drop("w").join(held, "node").withColumn("task", F.pmod("cell", F.lit(tasks)))
    return materialise(rows.groupBy("task").applyInPandas(lambda pdf: _links(pdf, percent, size), "a long, b long"), "links")


def spanning(met: DataFrame, held: DataFrame, part_bytes: int, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(node, w: its bytes, bucket), written -> links (a, b) that connect exactly what all links within buckets connect.

    held: (node, n, planes), and body where the links are to be exact.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    sizes = materialise(met.groupBy("bucket").agg(F.sum("w").alias("bytes"), F.min("node").alias("center"), F.max("w").alias("widest")).withColumn("m", F.floor(F.col("bytes") / part_bytes) + 1), "sizes")
    dealt = met.join(sizes.select("bucket", "m"), "bucket").select("node", "w", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), "m")).alias("cell"))
    large = sizes.where("m > 1")
    centers = large.select(F.col("center").alias("node"), F.col("widest").alias("w"), "bucket", every(F.col("m")).alias("part")).select("node", "w", F.xxhash64("bucket", "part").alias("cell"))
    first = _compared(dealt.union(centers).withColumn("label", F.col("node")).withColumn("active", F.lit(True)), held, percent, size)
    if not large.take(1):
        return first
    named = met.join(large.select("bucket", "m", "center"), "bucket").join(components(first).withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named, "named")
    main = named.where("node = center").select("bucket", F.col("label").alias("main"))
    apart = materialise(named.join(main, "bucket").withColumn("active", F.col("label") != F.col("main")), "apart")
    few = apart.where("active").groupBy("bucket").agg((F.floor(F.sum("w") / part_bytes) + 1).alias("q"))
    placed = apart.join(few, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), "m")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "q"))
    own = ["node", "w", "label", "active"]
    others = placed.where("not active").withColumn("j", every(F.col("q"))).select(*own, F.xxhash64("bucket", F.lit("others"), "i", "j").alias("cell"))
    against = placed.where("active").withColumn("i", every(F.col("m"))).select(*own, F.xxhash64("bucket", F.lit("others"), "i", "j").alias("cell"))
    mutual = placed.where("active").withColumn("k", every(F.col("q"))).select(*own, F.xxhash64("bucket", F.lit("mutual"), F.least("j", "k"), F.greatest("j", "k")).alias("cell"))
    second = _compared(others.union(against).union(mutual).select("node", "w", "cell", "label", "active"), held, percent, size)
    return first.union(second)


def groups(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, part_sketches: int = PART_SKETCHES, part_texts: int = PART_TEXTS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    with scratch():
        made = materialise(sketches(docs, size), "sketches")
        same = made.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"))
        placed = materialise(made.where("n > 0").select("row", "doc_id", "digest").join(same, "digest").select("row", "doc_id", "node"), "placed")
        nodes = materialise(made.select("row", "n", "bands", "planes").join(placed.where("row = node").select("row"), "row").withColumnRenamed("row", "node"), "nodes")
        keyed = nodes.select("node", F.explode("bands").alias("key"))
        # keys with the same nodes are one bucket, keys with one node none
        shared = keyed.groupBy("key").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("members")).where("many > 1")
        met = materialise(keyed.join(shared, "key").select("node", F.lit(SKETCH_BYTES).cast("long").alias("w"), F.xxhash64("many", "members").alias("bucket")).distinct(), "met")
        release(spark)
        near = materialise(components(spanning(met, nodes.select("node", "n", "planes"), part_sketches, percent, size)), "near")
        texts = made.select(F.col("row").alias("node"), "n", "planes", "body").join(near, "node")
        texts = materialise(texts, "texts")
        release(spark)
        inside = materialise(texts.select("node", (F.length("body") + SKETCH_BYTES).cast("long").alias("w"), F.col("root").alias("bucket")), "inside")
        roots = components(spanning(inside, texts.select("node", "n", "planes", "body"), part_texts, percent, size))
        lows = placed.groupBy("node").agg(F.min("doc_id").alias("low"))
        named = materialise(lows.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")), "named")
        least = named.groupBy("root").agg(F.min("low").alias("component_id"))
        known = materialise(named.select("node", "root").join(least, "root").select("node", "component_id"), "known")
        found = placed.select("row", "node").join(known, "node").select("row", "component_id")
        # rows without a set are their own component
        linked = made.select("row", "doc_id", "n").where("n > 0").join(found, "row").select("doc_id", "n", "component_id")
        alone = made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
        out = materialise(linked.union(alone), "groups", stays=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents", "doc_id", "text"))


#: Sets by grouping shingles, pairs that share a shingle, components by recursion over links.
OP11_SQL = r"""
with recursive worded as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingled as (
    select r, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from worded),
sized as materialized (select r, doc_id, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as node, s from shingled),
nodes as materialized (select node, any_value(n) as n, any_value(s) as s, min(doc_id) as low from sized where n > 0 group by node),
entries as materialized (select node, n, unnest(s) as g from nodes),
pairs as (
    select a.node as x, b.node as y from entries a join entries b on a.g = b.g and a.node <> b.node
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.node, b.node having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach as (select node as x, node as y from nodes union select reach.x, pairs.y from reach join pairs on reach.y = pairs.x),
least_ids as (select reach.x as node, min(nodes.low) as component_id from reach join nodes on nodes.node = reach.y group by reach.x)
select doc_id, n as n_shingles, case when n = 0 then doc_id else component_id end as component_id,
    doc_id is not distinct from (case when n = 0 then doc_id else component_id end) as kept
from sized left join least_ids using (node)
"""
