"""Operator 6: incremental removal of repeated word windows with a log-structured fingerprint index.

Documents come in batches of ascending doc_id. Of every window of `size` words one gram of GRAM words, the longest by their
bytes, stands for it (chosen by the window's own words, so equal windows choose alike); what is indexed is that gram's
fingerprint, once for each run of windows that shares it. A batch becomes an immutable run of the index, bucketed and sorted
by fingerprint, and is merge-joined with the runs of earlier batches (without a shuffle, for the buckets are the same); when
there are FAN_IN runs, they are compacted into one before the next batch comes.

Fingerprints met twice lead back to the texts. There a run of windows with all its words is a context. A context that an
earlier document has too, by its fingerprint and by the XXH3 hash of its words' bytes (two unrelated 64-bit hashes), goes
whole. Of the other contexts of such a fingerprint one copy each is fetched, and their windows are compared word by word.
A fingerprint with more than CROWD different contexts is no single group: its windows are counted one by one, by a
128-bit BLAKE2 digest of their words.

Nulls: a null text has no words; a null doc_id is not smaller or larger than any, so such rows neither lose words nor make
others lose any. Rows of equal doc_id do not remove each other's words, and repeated rows are judged alike. Very long texts
take memory in proportion to their own words. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Rolling, release, sliding, squeezed, unsqueezed, with_row_key
from .common import discard, map_rows, materialise, mix64, remove, scratch, shared_folder, table
from .suffix_dedup import merged_spans

SIZE = 13
#: Words of the gram that stands for a window.
GRAM = 4
CHUNK = 1 << 23
BATCHES = 3
FAN_IN = 2
CROWD = 4096
#: Bytes of contexts in one task, about.
TASK_BYTES = 12 << 20
#: Bytes of texts that are cut into words together, about.
TOGETHER = 2 << 20
#: Words of more bytes than this are hashed one by one.
LANES = 64
#: A run of windows has fewer windows than this (they share a gram), so place and length go into one number.
RUN = 64
#: A removed span has fewer words than this.
SPAN = 256


def one_spaced(text: str) -> bytes:
    """The words of a text, one space between them (bytes are split at exactly the separators of words)."""
    return b" ".join(text.encode().split())


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a text with one space between words begins, its size, and a hash of it.

    A word of up to eight bytes is mixed as one number, so that words of equal size never share a hash; longer ones are
    mixed eight bytes at a time, very long ones are hashed by XXH64.
    """
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    raw = np.frombuffer(data + b" " * 8, np.uint8)
    eights = np.ndarray((len(data) + 1,), np.uint64, raw, strides=(1,))  # the eight bytes from each position on
    end = np.append(np.flatnonzero(raw[: len(data)] == 32), len(data))
    start = np.append(0, end[:-1] + 1)
    size = end - start
    h = mix64(size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    left = np.flatnonzero(size <= LANES) if size.max() > LANES else np.arange(len(size))
    for at in range(0, LANES, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        unused = np.maximum(0, 8 - (size[left] - at)).astype(np.uint64) * np.uint64(8)
        h[left] = mix64(h[left] ^ (eights[start[left] + at] << unused))
    for w in np.flatnonzero(size > LANES).tolist():
        h[w] = xxhash.xxh64_intdigest(data[start[w] : end[w]], 6)
    return start, size, h


def standing(sizes: np.ndarray, h: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Word sizes and hashes -> for every window, where its standing gram begins and that gram's hash. Of a window's grams the
    one of the most bytes in its words stands (what parts the words does not count), then the lower hash, then the first."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, grams = [], []
    upto = np.append(0, np.cumsum(sizes))
    for c in range(0, n, CHUNK):  # a chunk's places fit into 24 bits
        roll = Rolling(h[c : c + CHUNK + size - 1])
        gram = mix64(roll.all(GRAM))
        long = np.minimum(upto[c + GRAM : c + GRAM + len(gram)] - upto[c : c + len(gram)], 255).astype(np.uint64)
        rank = ((np.uint64(255) - long) << np.uint64(56)) | ((gram >> np.uint64(32)) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
        at = (sliding(np.minimum, rank, size - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        places.append(at + c)
        grams.append(gram[at].view(np.int64))
    return np.concatenate(places), np.concatenate(grams)


class Runs:
    """Runs of windows with one standing gram, of some texts: owner (which text), at (first window in it), n (windows), key."""

    def __init__(self, texts: list[str], size: int = SIZE):
        each = [one_spaced(t) for t in texts]
        self.data = b" ".join(filter(None, each))
        self.start, self.sizes, h = word_hashes(self.data)
        counts = np.array([x.count(b" ") + 1 if x else 0 for x in each], np.int64)
        begin = np.cumsum(counts) - counts
        place, gram = standing(self.sizes, h, size)
        text = np.repeat(np.arange(len(texts)), counts)[: len(place)]
        inside = np.arange(len(place)) + size <= (begin + counts)[text]  # windows that reach into the next text are none
        edge = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])]) if len(place) else np.empty(0, np.int64)
        n = np.diff(np.append(edge, len(place)))
        good = inside[edge]
        self.first, self.n, self.size = edge[good], n[good], size
        self.key, self.owner = gram[self.first], text[self.first]
        self.at = self.first - begin[self.owner]

    def contexts(self) -> np.ndarray:
        """The XXH3 hash of each run's words, one space between them."""
        data, digest, last = self.data, xxhash.xxh3_64_intdigest, self.first + self.n + self.size - 2
        spans = zip(self.start[self.first].tolist(), (self.start[last] + self.sizes[last]).tolist())
        return np.array([digest(data[a:b]) for a, b in spans], np.uint64).view(np.int64)


def together(texts: list[str], most: int = TOGETHER):
    """Ranges of texts of about `most` characters, a text at least."""
    low = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(low, i)
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield slice(low, len(texts))


class FingerprintIndex:
    """Sorted immutable runs of (key, lo, shared): a fingerprint, its lowest doc_id, whether several documents have it.

    They lie in the shared folder (spark.checkpoint.dir), where every executor finds them.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        """buckets: sorted files of every run, by default as many as the session's shuffles have partitions."""
        self.spark, self.fan_in, self.runs, self.tables, self.compactions = spark, fan_in, [], [], 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _sorted(self, postings: DataFrame) -> DataFrame:
        return self._write(postings.repartition(self.buckets, "key").groupBy("key").agg(F.min("lo").alias("lo"), (F.bool_or("shared") | (F.min("lo") < F.max("lo"))).alias("shared")))

    def _write(self, summed: DataFrame) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        self.tables.append(name)  # before the write, so that drop() also finds one that was cut short
        out = summed.write.option("path", self._path(name)).option("parquet.enable.dictionary", "false")
        out.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def _path(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{name}"

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self._path(name))

    def drop(self) -> None:
        """Deletes the runs, for an index that is of no further use."""
        self._remove(self.tables)
        self.runs, self.tables = [], []

    def add(self, postings: DataFrame) -> DataFrame:
        """Adds a batch as a run; returns the written keys of its fingerprints that some other document has, in it or before it."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        run = self._sorted(postings)
        release(self.spark)
        found = run.where("shared").select("key")
        for old in self.runs:
            found = found.union(run.join(old.select("key"), "key").select("key"))
        self.runs.append(run)
        return materialise(found, "keys")

    def compact(self) -> None:
        """Merges all runs into one, whose tables replace theirs."""
        before, merged = list(self.tables), self.runs[0]
        for run in self.runs[1:]:  # merged as they lie: buckets and order are the same, so nothing is shuffled
            one, other = merged.select("key", "lo", "shared"), run.select("key", F.col("lo").alias("lo2"), F.col("shared").alias("shared2"))
            both = F.col("lo").isNotNull() & F.col("lo2").isNotNull()
            merged = one.join(other, "key", "full").select("key", F.least("lo", "lo2").alias("lo"), (both | F.coalesce("shared", "shared2")).alias("shared"))
        self.runs = [self._write(merged)]
        self.tables = self.tables[len(before) :]
        self._remove(before)
        self.compactions += 1
        release(self.spark)


def postings(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text) -> key, lo, shared, summed over each Arrow batch."""

    def work(columns):
        ids, made = np.array(columns[0], np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for part in together(columns[1]):
            runs = Runs(columns[1][part], size)
            made.append((runs.key, ids[part][runs.owner]))
        key, doc = map(np.concatenate, zip(*made))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        last = np.append(first[1:], len(key)) - 1 if len(key) else first
        return {"key": key[first], "lo": doc[first], "shared": doc[first] < doc[last]}

    return map_rows(rows.select("doc_id", "text"), work, "key long, lo long, shared boolean")


def places(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(rid, doc_id, text) -> key, context (hash of all its words), rid, doc, at (first window * RUN + windows)."""

    def work(columns):
        rids, ids = (np.array(c, np.int64) for c in columns[:2])
        made = [(np.empty(0, np.int64),) * 5]
        for part in together(columns[2]):
            runs = Runs(columns[2][part], size)
            made.append((runs.key, runs.contexts(), rids[part][runs.owner], ids[part][runs.owner], runs.at * RUN + runs.n))
        return dict(zip(("key", "context", "rid", "doc", "at"), map(np.concatenate, zip(*made))))

    return map_rows(rows.select("rid", "doc_id", "text"), work, "key long, context long, rid long, doc long, at long")


def lowest_places(met: DataFrame) -> DataFrame:
    """Places of repeated fingerprints -> one row for each different context: key, context, and a place in its lowest
    document (doc, rid, at)."""
    return met.groupBy("key", "context").agg(F.min(F.struct("doc", "rid", "at")).alias("low")).select("key", "context", "low.*")


_CONTEXTS = "key long, context long, doc long, words binary, crowd boolean"


def fetched(bodies: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """(rid, body) and contexts (key, context, doc, rid, at, crowd) -> their words, one space between them."""
    marks = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "context", "doc", "at", "crowd")).alias("marks"))

    def work(columns):
        out = {"key": [], "context": [], "doc": [], "words": [], "crowd": []}
        for body, marked in zip(*columns):
            words = unsqueezed(body).split()
            for key, context in {(m["key"], m["context"]): m for m in marked}.items():
                at, n = divmod(context["at"], RUN)
                out["words"].append(b" ".join(words[at : at + n + size - 1]))
                out["key"].append(key[0])
                out["context"].append(key[1])
                out["doc"].append(context["doc"])
                out["crowd"].append(context["crowd"])
        return out

    return map_rows(bodies.join(marks, "rid").select("body", "marks"), work, _CONTEXTS)


_HITS = "key long, context long, lo int, hi int"


def window_bytes(words: bytes, size: int) -> list[bytes]:
    w = words.split(b" ")
    return [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]


def compared(pdf: pd.DataFrame, size: int = SIZE) -> pd.DataFrame:
    """Contexts of some fingerprints -> key, context, lo, hi: words covered by windows that a lower document has too."""
    lowest: dict[bytes, int] = {}
    docs, held = pdf["doc"].tolist(), pdf["words"].tolist()
    for doc, words in zip(docs, held):
        for w in window_bytes(words, size):
            if lowest.setdefault(w, doc) > doc:
                lowest[w] = doc
    made = []
    for key, context, doc, words in zip(pdf["key"].tolist(), pdf["context"].tolist(), docs, held):
        lo = None
        found = [lowest[w] < doc for w in window_bytes(words, size)]
        for i, hit in enumerate([*found, False]):
            if hit and lo is None:
                lo = i
            elif not hit and lo is not None:
                made.append((key, context, lo, i - 1 + size))
                lo = None
    columns = list(zip(*made)) or [[], [], [], []]
    return pd.DataFrame({name: pd.Series(x, dtype=kind) for name, x, kind in zip(("key", "context", "lo", "hi"), columns, ("int64", "int64", "int32", "int32"))})


def compared_singly(crowded: DataFrame, size: int = SIZE) -> DataFrame:
    """As compared(), for fingerprints of any number of contexts: each window is a row, known by its words' digest."""

    def work(columns):
        out = {"key": [], "context": [], "doc": [], "p": [], "w": []}
        for key, context, doc, words in zip(*columns):
            digests = [hashlib.blake2b(w, digest_size=16).digest() for w in window_bytes(words, size)]
            out["w"] += digests
            out["p"] += range(len(digests))
            for name, x in (("key", key), ("context", context), ("doc", doc)):
                out[name] += [x] * len(digests)
        return out

    each = materialise(map_rows(crowded.select("key", "context", "doc", "words"), work, "key long, context long, doc long, p int, w binary"), "windows")
    low = materialise(each.groupBy("w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("w", "low"), "low")
    return each.join(low, "w").where("doc > low").select("key", "context", F.col("p").alias("lo"), (F.col("p") + size).alias("hi"))


def verified(contexts: DataFrame, size: int = SIZE) -> DataFrame:
    """Contexts with their words -> key, context, lo, hi: words (counted in the context) that a lower document's windows cover."""
    row = contexts.agg(F.sum(F.length("words") + 32).alias("bytes"), F.max(F.col("crowd").cast("int")).alias("crowd")).first()
    tasks = int(row["bytes"] or 0) // TASK_BYTES + 1
    few = contexts.where("not crowd").withColumn("task", F.pmod("key", F.lit(tasks))).groupBy("task").applyInPandas(lambda pdf: compared(pdf, size), _HITS)
    return few.union(compared_singly(contexts.where("crowd"), size)) if row["crowd"] else few


def remove_windows(docs: DataFrame, size: int = SIZE, batches: int = BATCHES, index: FingerprintIndex | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text) -> doc_id, body (compressed text), spans: words covered by earlier documents' windows (first * SPAN + words).

    An index that is given is kept, one of the call's own is deleted as soon as all batches are in, or when one fails."""
    if size - GRAM + 1 >= RUN:
        raise ValueError(f"windows of up to {RUN + GRAM - 2} words only")
    spark = docs.sparkSession
    own = index is None
    index = index or FingerprintIndex(spark)
    with scratch(), contextlib.ExitStack() as ends:
        if own:
            ends.callback(index.drop)  # also where a batch fails
        rows = with_row_key(docs)
        dated = rows.where("doc_id is not null")
        shares = [(2**i - 1) / (2**batches - 1) for i in range(1, batches)]  # each batch is twice the one before it
        edges = sorted({int(x) for x in dated.stat.approxQuantile("doc_id", shares, 0.01)}) if shares else []
        found = []
        for low, high in zip([None, *edges], [*edges, None]):
            part = dated if low is None else dated.where(F.col("doc_id") > low)
            part = part if high is None else part.where(F.col("doc_id") <= high)
            found.append(index.add(postings(part, size)))
        keys = found[0]
        for more in found[1:]:
            keys = keys.union(more)
        if own:
            index.drop()
        release(spark)
        met = materialise(places(dated, size).join(keys, "key", "left_semi"), "places")
        for old in found:
            discard(old)
        release(spark)
        lowest = materialise(lowest_places(met), "contexts")
        # written, so that the join has no aggregate in its way and a fingerprint of very many contexts can be split
        several = materialise(lowest.groupBy("key").agg((F.count("*") > crowd).alias("crowd"), F.count("*").alias("kinds")).where("kinds > 1"), "several")
        release(spark)
        bodies = map_rows(rows.select("rid", "doc_id", "text"), lambda c: {"rid": c[0], "doc_id": c[1], "body": squeezed(c[2])}, "rid long, doc_id long, body binary")
        wanted = lowest.join(several.select("key", "crowd"), "key")
        contexts = materialise(fetched(bodies.select("rid", "body"), wanted, size), "words")
        release(spark)
        hits = verified(contexts, size).groupBy("key", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))
        judged = materialise(lowest.select("key", "context", F.col("doc").alias("low")).join(hits, ["key", "context"], "left"), "judged")
        discard(contexts)
        release(spark)
        # a place of a later document loses all its words, one of the lowest document those that were found in others
        at = F.shiftright("at", RUN.bit_length() - 1)
        whole = F.array(at * SPAN + F.col("at") % RUN + size - 1)
        lost = F.when(F.col("doc") > F.col("low"), whole).otherwise(F.transform("hits", lambda s: (at + s["lo"]) * SPAN + s["hi"] - s["lo"]))
        gone = met.join(judged, ["key", "context"]).select("rid", lost.alias("lost")).where("lost is not null")
        spans = materialise(gone.groupBy("rid").agg(F.flatten(F.collect_list("lost")).alias("spans")), "spans", stays=True)
        release(spark)
    return bodies.join(spans, "rid", "left").select("doc_id", "body", "spans")


def kept_words(data: bytes, spans) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside the spans."""
    words = data.split()  # bytes split at exactly the separators of words
    if not spans:
        return len(words), words
    first, n = np.divmod(np.array(spans, np.int64), SPAN)
    merged = merged_spans(np.stack([first, first + n], 1))
    at = [0, *merged.reshape(-1).tolist(), len(words)]
    return len(words), [w for a, b in zip(at[::2], at[1::2]) for w in words[a:b]]


def op6_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(columns):
        both = [kept_words(unsqueezed(body), spans) for body, spans in zip(*columns[1:])]
        return {"doc_id": columns[0], "n_words": [n for n, _ in both], "n_removed": [n - len(k) for n, k in both], "kept_sha256": [hashlib.sha256(b" ".join(k)).hexdigest() for _, k in both]}

    found = remove_windows(table(spark, sf_dir, "documents", "doc_id", "text"))
    return map_rows(found, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
