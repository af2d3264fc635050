"""Operator 5: exact top-k inner products by a uniform threshold in three phases.

The dimensions are dealt to a few nodes, each of which knows its own part of every score, and no other. Queries and
candidates meet in rectangular blocks of bounded size. Phase 1: over a bounded sample of the rows (PROBE) every node lists
its best entries for each query; the k-th best of the listed entries' whole scores is a cutoff that the answer cannot fall
below, as it is the score of k rows that exist. It travels with its query. Phase 2: at a cutoff c each of the m nodes
collects its entries of at least c / m; an entry that no node collects scores less than c and is never summed. Of the
collected ones those go whose known parts, and c / m for each part that its node did not collect, stay below c. Phase 3: only
what is left is resolved, by the other nodes' parts, in integers. A block raises its cutoff by what it has found.

All arithmetic is exact: floor(256 x) is a whole number, products of small components are summed in doubles below 2**53,
and rows with larger components are multiplied as Python integers, without a threshold. A score beyond a long is returned
as the nearest long, but ranked by its true value.

Nulls: a vector that is null, empty, or holds null or non-finite components takes no part, neither does a null vec_id.
Every row counts, also rows that repeat a vec_id: each is a candidate (for its namesakes too) and, where its id asks for it, a
query. Candidates of another dimension than the query's are left out. Ties go to the smaller vec_id, then to the row that is
read first; fewer candidates than k give fewer rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SCALE = 256
NODES = 4
#: Rows that set the first cutoffs, about: those whose hash is 0 modulo a divisor that follows from the number of rows.
PROBE = 2048
#: Bytes of one side of a block, and how many scores of it are held at a time.
BLOCK_BYTES = 16 << 20
CELLS = 1 << 20
#: Sums below this are exact in doubles.
EXACT = 2**53
_FOUND = "query long, query_id long, vec_id long, row long, score long, beyond string"


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> row (a number of its own), vec_id, size, x: components as doubles; only vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size(x).alias("size"), F.transform(x, lambda c: c.cast("double")).alias("x"))


class Side:
    """One side of a block: ids, quantised components as doubles, and which rows are too large for doubles."""

    def __init__(self, rows: pa.Table):
        self.n = rows.num_rows
        self.row, self.vec_id = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
        raw = rows.column("x").combine_chunks()
        self.raw = raw.flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1)
        with np.errstate(over="ignore"):
            self.v = np.floor(self.raw * SCALE)
        self.large = np.abs(self.v).max(axis=1) > np.sqrt(EXACT / self.v.shape[1]) - 1
        self.small = np.flatnonzero(~self.large)

    def whole(self, i: int) -> list[int]:
        """Row i in Python integers."""
        return [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in self.raw[i].tolist()]


def _edges(size: int, nodes: int) -> list[tuple[int, int]]:
    cut = [size * i // nodes for i in range(nodes + 1)]
    return [(a, b) for a, b in zip(cut, cut[1:]) if b > a]


def probed(queries: Side, rows: Side, k: int, nodes: int) -> list[np.ndarray]:
    """Phase 1: for each query the k best whole scores of what the nodes list (small rows only, best first)."""
    parts = _edges(queries.v.shape[1], nodes)
    best = [np.empty(0)] * queries.n
    c = rows.v[rows.small]
    if not len(c):
        return best
    each = max(1, CELLS // len(c))
    for at in range(0, len(queries.small), each):
        q = queries.small[at : at + each]
        lists = [np.argpartition(p, -min(k + 1, len(c)), axis=1)[:, -min(k + 1, len(c)) :] for p in (queries.v[q, a:b] @ c[:, a:b].T for a, b in parts)]
        listed = np.concatenate(lists, axis=1)
        for i, entries in zip(q.tolist(), listed):
            entries = np.unique(entries)
            entries = entries[rows.row[rows.small[entries]] != queries.row[i]]
            best[i] = -np.sort(-(c[entries] @ queries.v[i]))[:k]
    return best


def resolved(queries: Side, rows: Side, cutoff: np.ndarray, k: int, nodes: int) -> tuple[list[tuple], int]:
    """Phases 2 and 3: entries (query, row, whole score) that can be among a query's k best, and how many were resolved.

    cutoff: for each query, a score that k of its candidates reach; minus infinity where none is known.
    """
    parts = _edges(queries.v.shape[1], nodes)
    m, made, count = len(parts), [], 0
    cut = cutoff.copy()
    held: dict[int, np.ndarray] = {}  # each query's best scores so far
    c_all, step = rows.v[rows.small], max(1, CELLS // max(1, len(queries.small)))
    for at in range(0, len(rows.small), step):
        which = rows.small[at : at + step]
        c, q = c_all[at : at + step], queries.small
        local = [queries.v[q, a:b] @ c[:, a:b].T for a, b in parts]
        share = np.floor(cut[q] / m)[:, None]
        reached = [p >= share for p in local]
        i, j = np.nonzero(np.logical_or.reduce(reached))
        # what is known of an entry, and less than the share for every part that was not collected
        most = sum(np.where(r[i, j], p[i, j], share[i, 0]) for r, p in zip(reached, local))
        keep = (most >= cut[q[i]]) & (queries.row[q[i]] != rows.row[which[j]])
        i, j = i[keep], j[keep]
        score = sum(p[i, j] for p in local)
        count += len(i)
        keep = score >= cut[q[i]]
        i, j, score = q[i[keep]], which[j[keep]], score[keep]
        order = np.lexsort((rows.row[j], rows.vec_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        i, j, score = i[keep], j[keep], score[keep]
        made.append((i, j, score.astype(np.int64)))
        edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
        for x, new in zip(i[edge].tolist() if len(i) else [], np.split(score, edge[1:]) if len(i) else []):
            held[x] = -np.sort(-np.concatenate([held.get(x, np.empty(0)), new]))[:k]
            if len(held[x]) == k:
                cut[x] = max(cut[x], held[x][-1])
    out = [(a, b, int(s)) for i, j, score in made for a, b, s in zip(i.tolist(), j.tolist(), score.tolist()) if s >= cut[a]]
    big_q, big_c = np.flatnonzero(queries.large), np.flatnonzero(rows.large)
    pairs = [(a, b) for a in big_q.tolist() for b in range(rows.n)] + [(a, b) for a in queries.small.tolist() for b in big_c.tolist()]
    for a, b in pairs:
        if queries.row[a] != rows.row[b]:
            out.append((a, b, sum(x * y for x, y in zip(queries.whole(a), rows.whole(b)))))
    return out, count + len(pairs)


def _sortable(score: int) -> str | None:
    """For a score beyond a long, text that sorts as the score does, among its like of the same sign (else null)."""
    if -(2**63) <= score < 2**63:
        return None
    digits = f"{abs(score):0700d}"
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210"))


def _cutoffs(queries: pa.Table, rows: pa.Table, k: int, nodes: int) -> pa.Table:
    kind = pa.schema([("row", pa.int64()), ("cutoff", pa.float64())])
    if not queries.num_rows or not rows.num_rows:
        return kind.empty_table()
    side = Side(queries)
    best = probed(side, Side(rows), k, nodes)
    full = [i for i in range(side.n) if len(best[i]) == k]
    return pa.table([side.row[full], np.array([best[i][-1] for i in full], np.float64)], schema=kind)


def _entries(queries: pa.Table, rows: pa.Table, k: int, nodes: int) -> pa.Table:
    kind = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in _FOUND.split(", ")])
    if not queries.num_rows or not rows.num_rows:
        return kind.empty_table()
    a, b = Side(queries), Side(rows)
    cutoff = queries.column("cutoff").to_pandas().fillna(-np.inf).to_numpy(np.float64)
    found, _ = resolved(a, b, cutoff, k, nodes)
    by_query: dict[int, list] = {}
    for i, j, score in found:
        by_query.setdefault(i, []).append((-score, int(b.vec_id[j]), int(b.row[j])))
    best = [(int(a.row[i]), int(a.vec_id[i]), v, r, -s) for i, entries in by_query.items() for s, v, r in sorted(entries)[:k]]
    columns = list(zip(*best)) or [[]] * 5
    clipped = [min(max(s, -(2**63)), 2**63 - 1) for s in columns[4]]
    return pa.table([pa.array(x, f.type) for x, f in zip([*columns[:4], clipped, [_sortable(s) for s in columns[4]]], kind)], schema=kind)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, nodes: int = NODES, block_bytes: int = BLOCK_BYTES, probe: int = PROBE) -> DataFrame:
    """Vectors of taking_part(), written -> query_id, rank, vec_id, score: for every query row its k best other rows."""
    spark = vectors.sparkSession
    sizes = vectors.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.count_if(is_query).alias("queries")).first()
    dimensions = int(sizes["size"] or 1)
    cells = max(1, block_bytes // (8 * dimensions))
    row_blocks = max(sizes["n"] // cells + 1, min(2 * spark.sparkContext.defaultParallelism, sizes["n"] // 1024 + 1))
    query_blocks = sizes["queries"] // cells + 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    own = [F.col(c).alias(c) for c in ("size", "row", "vec_id", "x")]  # columns of the queries' own, apart from the rows'
    queries = vectors.where(is_query).select(*own, dealt(query_blocks).alias("qb"))
    sample = vectors.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(sizes["n"] // probe + 1)) == 0).select("size", "row", "vec_id", "x", every(query_blocks).alias("qb"))
    cutoffs = queries.groupBy("size", "qb").cogroup(sample.groupBy("size", "qb")).applyInArrow(lambda q, c: _cutoffs(q, c, k, nodes), "row long, cutoff double")
    cut = queries.join(materialise(cutoffs, "cutoffs"), "row", "left").select("size", "row", "vec_id", "x", "cutoff", "qb", every(row_blocks).alias("rb"))
    rows = vectors.select("size", "row", "vec_id", "x", every(query_blocks).alias("qb"), dealt(row_blocks).alias("rb"))
    keys = ["size", "qb", "rb"]
    found = cut.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(lambda q, c: _entries(q, c, k, nodes), _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(taking_part(table(spark, sf_dir, "embeddings", "vec_id", "embedding")), "vectors")
    return top_k(vectors, F.col("vec_id") % 50 == 0)
