"""Operator 9: removes long repeated byte strings by suffix sorting with linear grouping construction.

How it scales: every text is cut at content-defined anchors. A stretch of `length` bytes has one anchor that decides for
it, chosen by its own bytes only, and holds a fixed core around that anchor. Counting cores finds the anchors that can
matter. An anchor with all its stretches is a context, known by the XXH3 hash of its bytes; of each different context of a
repeated core one copy is fetched, and two (the first and the last) of one that occurs twice or more. Their bytes before and
behind the core are cut into 16-byte symbols, many contexts together are suffix-sorted, and stretches that share all but
the last symbol stand side by side in the suffix array. Their last bytes are then compared exactly. (Contexts of equal bytes are sorted
once, and a symbol that no other context has at its distance from the core ends what is sorted.) What is found holds for
every place of the context. Cores are the same only if a second, 128-bit hash of their bytes agrees too.
A core with more than CROWD different contexts is no single group: its stretches are counted one by one, by the MD5 digest
of their bytes.

The suffix sorter groups suffixes by Lyndon prefix: groups are processed in descending order, every member finds the
nearest position before it in a lower group (previous-smaller pointers), whose group is refined by how often it was
reached; one ascending pass then emits each group's order, with no renaming and no recursion.

Nulls: a null text is empty and has no removed bytes; a null doc_id is carried along. Repeated rows count as different
places, so their long strings are removed from each of them. Very long texts take memory in proportion to their own bytes.
An empty table gives no rows; other columns are ignored (cut_repeats() keeps them as they are, whatever their names).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Rolling, minimizers, release, row_key, squeezed, unsqueezed, with_row_key
from .common import discard, fresh, in_few, map_rows, materialise, mix64, scratch, table

LENGTH = 400
GRAM = 16
SYMBOL = 16
#: Different contexts of one core that are sorted together.
CROWD = 8192
#: Contexts in one task, about.
TASK_CONTEXTS = 15_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of integers >= 1 (0 is put behind them as the end), by grouping on Lyndon prefixes."""
    s = np.append(np.asarray(s, np.int64), 0)
    n = len(s)
    order = np.argsort(s, kind="stable")
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    firsts = np.flatnonzero(np.r_[True, s[order][1:] != s[order][:-1]])
    sizes = np.diff(np.append(firsts, n))
    start = np.empty(n, np.int64)
    start[order] = np.repeat(firsts, sizes)
    size = np.zeros(n, np.int64)
    size[firsts] = sizes
    sa, isa, group, count = order.tolist(), where.tolist(), start.tolist(), size.tolist()
    before = [-1] * n
    end = n
    while end > 0:
        low = group[sa[end - 1]]
        reached: dict[int, int] = {}
        for i in sorted(sa[low:end]) if end - low > 1 else (sa[low],):
            p = i - 1
            while p >= 0 and group[p] >= low:  # groups at or above this one have their pointers already
                p = before[p]
            before[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            by_count: dict[int, list[int]] = {}
            for p, c in reached.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved = by_count[c]
                for p in moved:  # to the end of its group
                    g = group[p]
                    count[g] -= 1
                    last = g + count[g]
                    a, q = isa[p], sa[last]
                    sa[a], sa[last] = q, p
                    isa[q], isa[p] = a, last
                for p in moved:
                    g = group[p]
                    new = g + count[g]
                    group[p] = ~new  # marked until all have been placed
                for p in moved:
                    new = group[p] = ~group[p]
                    count[new] += 1
        end = low
    free = list(range(n))  # next free place of the group that starts there
    done = [False] * n
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return np.array(out[1:], np.int64)


class Geometry:
    """How anchors, cores and contexts lie, for stretches of `length` bytes."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.grams = length - GRAM + 1
        # the largest window for which an anchor's fate is decided within the stretch; free bytes are a multiple of SYMBOL
        self.window = max(SYMBOL, (self.grams + 2) // 3 // SYMBOL * SYMBOL)
        if 3 * self.window - 2 > self.grams:
            raise ValueError("stretches are too short for this symbol size")
        self.side = self.window - 1  # bytes before the anchor that belong to the core
        self.right = length - self.side - self.window  # bytes from the anchor on that belong to the core
        self.free = self.window  # free bytes of a stretch: e before the core, free - e behind it

    def contexts(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """anchor, most, key, context hash: of each anchor that decides for some stretch.

        Its stretches start at anchor - side - e for e from max(0, anchor + length - side - size) to most.
        """
        none = np.empty(0, np.int64)
        n = len(data)
        if n < self.length:
            return none, none, none, none
        roll = Rolling(_BYTES[data])
        all_a = minimizers(mix64(roll.all(GRAM)), self.window)
        gap = np.diff(all_a, prepend=-(10**9))
        most = np.minimum(np.minimum(gap - 1, self.free - 1), all_a - self.side)
        least = np.maximum(0, all_a + self.length - self.side - n)
        ok = (most >= 0) & (least <= most)
        a, most, least = all_a[ok], most[ok], least[ok]
        key = roll.at(a - self.side, a + self.right).view(np.int64)
        raw, digest = memoryview(data), xxhash.xxh3_64_intdigest
        whole = [digest(raw[i:j]) for i, j in zip((a - self.side - most).tolist(), (a + self.length - self.side - least).tolist())]
        context = (np.array(whole, np.uint64) ^ mix64((least * 1024 + most).astype(np.uint64))).view(np.int64)
        return a, most, key, context


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
SPAN = 1 << 16  # a removed span has fewer bytes than this
BITS = 1 << 10  # loc = anchor * BITS + most


def _each(columns, geometry: Geometry):
    for rid, text in zip(columns[0], columns[1]):
        yield rid, geometry.contexts(np.frombuffer(text.encode(), np.uint8))


def repeated_keys(rows: DataFrame, geometry: Geometry) -> DataFrame:
    """(rid, text) -> key: cores that occur twice or more; summed per batch before the shuffle."""

    def work(columns):
        found = [k for _, (_, _, k, _) in _each(columns, geometry)]
        key, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
        return {"key": key, "n": n}

    return map_rows(rows.select("rid", "text"), work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def repeated_places(rows: DataFrame, geometry: Geometry) -> DataFrame:
    """(rid, text) -> key, context, rid, loc: every place of a core that occurs twice or more."""

    def work(columns):
        parts = [(np.full(len(k), rid, np.int64), a * BITS + m, k, c) for rid, (a, m, k, c) in _each(columns, geometry) if len(k)]
        made = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
        return dict(zip(("rid", "loc", "key", "context"), made))

    keys = materialise(repeated_keys(rows, geometry), "keys")
    release(rows.sparkSession)
    met = materialise(map_rows(rows.select("rid", "text"), work, "rid long, loc long, key long, context long").join(keys, "key"), "places")
    discard(keys)
    release(rows.sparkSession)
    return met


def wanted_contexts(met: DataFrame, crowd: int) -> DataFrame:
    """Places -> those to be fetched: rid, key, context, loc, first (else the last place of a context), crowd, twin.

    Equal rows have one rid, so a context of theirs can have one (rid, loc) several times: it is a copy of itself (twin).
    """
    at = F.struct("rid", "loc")
    # both written, so that the join has no aggregate in its way and a core of very many contexts can be split
    each = materialise(in_few(met.groupBy("key", "context").agg(F.min(at).alias("low"), F.max(at).alias("high"), (F.count("*") > 1).alias("copy")), met.count()), "contexts")
    kinds = materialise(in_few(each.groupBy("key").agg((F.count("*") > crowd).alias("crowd"), (F.count("*") > 1).alias("several"), F.count_if("copy").alias("copied")).where("several or copied > 0"), each.count()), "kinds")
    both = each.join(kinds, "key").where("several or copy").withColumn("twin", F.expr("copy and low = high"))
    place = F.explode(F.array_distinct(F.array("low", "high")))
    return both.select("key", "context", "crowd", "twin", "low", place.alias("place")).select("place.rid", "key", "context", "place.loc", (F.col("place") == F.col("low")).alias("first"), "crowd", "twin")


_CONTEXTS = "key long, core binary, context long, loc long, lefts binary, rights binary, first boolean, crowd boolean"


def fetched(bodies: DataFrame, wanted: DataFrame, geometry: Geometry) -> DataFrame:
    """(rid, body) and wanted_contexts() -> their bytes before and behind the core, and a hash of the core's."""
    marks = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "context", "loc", "first", "crowd", "twin")).alias("marks"))
    names, g = [p.split()[0] for p in _CONTEXTS.split(", ")], geometry

    def work(columns):
        out = {name: [] for name in names}
        for body, marked in zip(*columns):
            data = unsqueezed(body)
            for m in {m["loc"]: m for m in marked}.values():
                a, most = divmod(m["loc"], BITS)
                least = max(0, a + g.length - g.side - len(data))
                made = m["key"], xxhash.xxh3_128_digest(data[a - g.side : a + g.right]), m["context"], m["loc"], data[a - g.side - most : a - g.side], data[a + g.right : a + g.right + g.free - least], m["first"], m["crowd"]
                for name, x in zip(names, made):
                    out[name] += [x, False if name == "first" else x] if m["twin"] else [x]
        return out

    one = bodies.join(marks, "rid").dropDuplicates(["rid"])  # rows that are repeated hold the same bytes
    return map_rows(one.select("body", "marks"), work, _CONTEXTS)


def sorted_repeats(core: np.ndarray, lefts: list[bytes], rights: list[bytes], geometry: Geometry) -> np.ndarray:
    """[contexts, free + 1] booleans: does the stretch with e bytes before the core occur in another context of the core."""
    g, n = geometry, len(core)
    left_size, right_size = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    rows = np.zeros(n, [("core", np.int64), ("sizes", np.int64), ("left", f"V{g.free}"), ("right", f"V{g.free}")])
    rows["core"], rows["sizes"] = core, left_size * 1024 + right_size
    rows["left"] = np.frombuffer(b"".join(x.rjust(g.free, b"\0") for x in lefts), f"V{g.free}")
    rows["right"] = np.frombuffer(b"".join(x.ljust(g.free, b"\0") for x in rights), f"V{g.free}")
    _, first, inverse, times = np.unique(rows.view(f"V{rows.itemsize}"), return_index=True, return_inverse=True, return_counts=True)
    inverse = inverse.reshape(-1)
    e = np.arange(g.free + 1)[None, :]
    # equal bytes: all stretches of the context are in its copy; of each different context one is sorted
    whole = (times[inverse] > 1)[:, None] & (e <= left_size[:, None]) & (e >= (g.free - right_size)[:, None])
    one = rows[first]
    left = np.ascontiguousarray(one["left"]).view(np.uint8).reshape(-1, g.free)
    right = np.ascontiguousarray(one["right"]).view(np.uint8).reshape(-1, g.free)
    return _sorted(one["core"], left, right, left_size[first], right_size[first], g)[inverse] | whole


def _sorted(core: np.ndarray, left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, g: Geometry) -> np.ndarray:
    """sorted_repeats() for contexts that all differ."""
    n, blocks = len(core), g.free // SYMBOL
    out = np.zeros((n, g.free + 1), bool)
    cells = np.concatenate([left.reshape(n, blocks, SYMBOL), right.reshape(n, blocks, SYMBOL)], 1)
    _, ids = np.unique(cells.reshape(-1, SYMBOL).copy().view(f"V{SYMBOL}").reshape(-1), return_inverse=True)
    ids = ids.reshape(n, 2 * blocks).astype(np.int64)
    place = np.arange(2 * blocks)[None, :]
    within = (place >= blocks - left_size[:, None] // SYMBOL) & (place < blocks + right_size[:, None] // SYMBOL)
    # a symbol that stands at its distance from this core in one context only ends what that context can share
    _, code = np.unique(core, return_inverse=True)
    _, at, times = np.unique(((code[:, None] * (2 * blocks) + place) << 32 | ids).reshape(-1), return_inverse=True, return_counts=True)
    shared = within & (times[at.reshape(-1)] > 1).reshape(n, -1)
    whole_left = np.minimum.accumulate(shared[:, blocks - 1 :: -1], axis=1).sum(axis=1)
    whole_right = np.minimum.accumulate(shared[:, blocks:], axis=1).sum(axis=1)
    alive = np.flatnonzero(whole_left + whole_right >= blocks - 1)
    if len(alive) < 2:
        return out
    core, code, ids, left, right, left_size, right_size, whole_left, whole_right = (x[alive] for x in (core, code, ids, left, right, left_size, right_size, whole_left, whole_right))
    n, width = len(alive), 2 * blocks + 2
    # each context as symbols: what it shares before the core, the core, what it shares behind it, an end mark
    text = np.ones((n, width), np.int64)
    text[:, :blocks], text[:, blocks], text[:, blocks + 1 : -1] = ids[:, :blocks] + 2, code + ids.max() + 3, ids[:, blocks:] + 2
    place = np.arange(width)[None, :]
    keep = (place >= (blocks - whole_left)[:, None]) & ((place < (blocks + 1 + whole_right)[:, None]) | (place == width - 1))
    flat, owner, column = text[keep], np.broadcast_to(np.arange(n)[:, None], text.shape)[keep], np.broadcast_to(place, text.shape)[keep]
    sa = suffix_array(flat)
    padded = np.append(flat, np.ones(blocks, np.int64))
    # suffixes that begin j symbols before the core and agree in `blocks` symbols (core included) stand together
    begins = column[sa]
    inside = (begins <= blocks) & (begins > 0)
    joined = np.ones(len(sa), bool)
    head = sa[:-1], sa[1:]
    for k in range(blocks):
        joined[1:] &= padded[head[0] + k] == padded[head[1] + k]
    joined[0] = False
    group = np.cumsum(~joined)
    j = blocks - begins
    fits = inside & (whole_right[owner[sa]] >= blocks - 1 - j) & (j < blocks)
    at, who, j = group[fits], owner[sa][fits], j[fits]
    sizes = np.bincount(at, minlength=1)
    many = sizes[at] > 1
    at, who, j = at[many], who[many], j[many]
    if not len(at):
        return out
    # the free bytes of such a group: SYMBOL before and SYMBOL behind what is shared
    z = np.zeros((len(at), 2 * SYMBOL), np.uint8)
    offset = np.arange(SYMBOL)
    wide_left = np.concatenate([np.zeros((n, SYMBOL), np.uint8), left], 1)
    z[:, :SYMBOL] = wide_left[who[:, None], (g.free - SYMBOL * j)[:, None] + offset]
    z[:, SYMBOL:] = right[who[:, None], (g.free - SYMBOL * (j + 1))[:, None] + offset]
    least = g.free - right_size
    record = np.zeros(len(at), [("g", np.int64), ("z", f"V{SYMBOL}")])
    record["g"] = at
    for x in range(SYMBOL + 1):
        e = SYMBOL * j + x
        valid = np.flatnonzero((e <= left_size[who]) & (e >= least[who]))
        if len(valid) < 2:
            continue
        part = record[valid].copy()
        part["z"] = np.ascontiguousarray(z[valid, SYMBOL - x : 2 * SYMBOL - x]).view(f"V{SYMBOL}").reshape(-1)
        raw = np.ascontiguousarray(part).view(f"V{8 + SYMBOL}").reshape(-1)
        _, inverse, times = np.unique(raw, return_inverse=True, return_counts=True)
        hit = valid[times[inverse.reshape(-1)] > 1]
        out[alive[who[hit]], e[hit]] = True
    return out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """[from, to] of the true stretches of a boolean row."""
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


_HITS = "key long, context long, e1 int, e2 int"


def sorted_hits(contexts: DataFrame, geometry: Geometry) -> DataFrame:
    """Contexts with their bytes -> key, context, e1, e2: stretches with e1 to e2 bytes before the core that occur elsewhere."""
    g = geometry
    row = contexts.agg(F.count("*").alias("n"), F.max(F.col("crowd").cast("int")).alias("crowd")).first()
    tasks = row["n"] // TASK_CONTEXTS + 1

    def in_task(pdf: pd.DataFrame) -> pd.DataFrame:
        _, core = np.unique(np.array([k.to_bytes(8, "little", signed=True) + c for k, c in zip(pdf["key"].tolist(), pdf["core"])]), return_inverse=True)
        hits = sorted_repeats(core, list(pdf["lefts"]), list(pdf["rights"]), g)
        key, context = pdf["key"].to_numpy(np.int64), pdf["context"].to_numpy(np.int64)
        made = [(key[i], context[i], *run) for i in np.flatnonzero(hits.any(axis=1) & pdf["first"].to_numpy(bool)) for run in _runs(hits[i])]
        columns = list(zip(*made)) or [[]] * 4
        return pd.DataFrame({n: np.array(x, t) for n, x, t in zip(("key", "context", "e1", "e2"), columns, (np.int64, np.int64, np.int32, np.int32))})

    few = contexts.where("not crowd").withColumn("task", F.pmod("key", F.lit(tasks))).groupBy("task").applyInPandas(in_task, _HITS)
    if not row["crowd"]:
        return few
    # crowded cores: each stretch by itself, so no group is gathered
    e = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(g.free) - F.length("rights")), F.length("lefts")))
    body = F.concat("core", F.expr("substring(lefts, length(lefts) - e + 1, e)"), F.expr(f"substring(rights, 1, {g.free} - e)"))
    stretches = contexts.where("crowd").select("key", "core", "context", "first", "lefts", "rights", e.alias("e")).select("key", "context", "first", "e", F.unhex(F.md5(F.concat(F.encode(F.concat_ws(" ", "key", "e"), "utf-8"), body))).alias("h"))
    stretches = materialise(stretches, "stretches")
    twice = materialise(stretches.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    return few.union(stretches.where("first").join(twice, "h").select("key", "context", F.col("e").alias("e1"), F.col("e").alias("e2")))


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, overlapping or touching spans made one."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def cleaned(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text) -> rid, doc_id, body (compressed UTF-8 bytes of the whole text), spans (bytes to remove: first * SPAN + bytes)."""
    with scratch():
        g, spark = Geometry(length), docs.sparkSession
        rows = with_row_key(docs)
        met = repeated_places(rows, g)
        bodies = map_rows(rows.select("rid", "doc_id", "text"), lambda c: {"rid": c[0], "doc_id": c[1], "body": squeezed(c[2])}, "rid long, doc_id long, body binary")
        contexts = materialise(fetched(bodies.select("rid", "body"), wanted_contexts(met, crowd), g), "stretches")
        release(spark)
        hits = materialise(in_few(sorted_hits(contexts, g).groupBy("key", "context").agg(F.collect_list(F.struct("e1", "e2")).alias("hits")), contexts.count()), "hits")
        discard(contexts)
        release(spark)
        begin = F.floor(F.col("loc") / BITS).cast("long") - g.side
        lost = F.transform("hits", lambda h: (begin - h["e2"]) * SPAN + g.length + h["e2"] - h["e1"])
        spans = materialise(met.join(hits, ["key", "context"]).select("rid", lost.alias("lost")).groupBy("rid").agg(F.flatten(F.collect_list("lost")).alias("spans")), "spans", stays=True)
        release(spark)
    return bodies.join(spans, "rid", "left").select("rid", "doc_id", "body", "spans")


def _spans(found) -> np.ndarray:
    first, n = np.divmod(np.array(found or [], np.int64), SPAN)
    return merged_spans(np.stack([first, first + n], 1))


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    at = [0, *spans.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(at[::2], at[1::2]))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> doc_id, kept (bytes that stay), n_bytes, spans (removed, as pairs)."""

    def work(columns):
        out = {"doc_id": columns[1], "kept": [], "n_bytes": [], "spans": []}
        for body, found in zip(*columns[2:]):
            data, spans = unsqueezed(body), _spans(found)
            out["kept"].append(kept_bytes(data, spans))
            out["n_bytes"].append(len(data))
            out["spans"].append(spans.reshape(-1).tolist())
        return out

    return map_rows(cleaned(docs, length), work, "doc_id long, kept binary, n_bytes long, spans array<long>")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents with repeats cut out of their text, other columns as they are, n_chars (if there) following the text.

    A character that loses only some of its bytes goes as a whole.
    """

    def work(columns):
        out = {"rid": [], "kept_text": []}
        for rid, body, found in zip(columns[0], *columns[2:]):
            data, spans = unsqueezed(body), _spans(found)
            if len(spans):
                out["rid"].append(rid)
                out["kept_text"].append(kept_bytes(data, spans).decode(errors="ignore"))
        return out

    cut = map_rows(cleaned(docs.select("doc_id", "text"), length), work, "rid long, kept_text string").dropDuplicates(["rid"])
    key, kept = fresh(docs, "rid"), fresh(docs, "kept_text")
    cut = cut.select(F.col("rid").alias(key), F.col("kept_text").alias(kept))
    joined = docs.withColumn(key, row_key()).join(cut, key, "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*docs.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(columns):
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
        out = {"doc_id": columns[1], **{n: [] for n in names}}
        for body, found in zip(*columns[2:]):
            data, spans = unsqueezed(body), _spans(found)
            for name, value in zip(names, (len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest())):
                out[name].append(value)
        return out

    found = cleaned(table(spark, sf_dir, "documents", "doc_id", "text"))
    return map_rows(found, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
