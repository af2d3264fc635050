"""Operator 12: centroid clustering (Lloyd's rounds) by annulus search, in exact integers.

Centroids are sorted by norm. For each vector the centroid of the nearest norm gives an upper bound on the distance to its
own; by the triangle inequality only centroids whose norms lie within that bound of the vector's norm can be as near. That
annulus is found by binary search (widened by a relative 1e-9 against rounding, so ties on its boundary are inside), and its
centroids alone are compared, exactly. On vectors of about one length annuli hold nearly all centroids, so little is saved;
on vectors of varied lengths most comparisons fall away.

A round is one pass over the table: tasks add up the vectors of each centroid and Spark adds up the tasks' sums, so the
driver gets centroids times components numbers, however large the table is. A lost task is read again from the table.

Components that doubles cannot add exactly are handled as Python integers. A distance beyond a long is compared by its true
value and returned as the largest long; inertias are sums of returned distances, and likewise.

Nulls: a vector that is null, of another number of components, or holds a null or non-finite component takes no part and
gives no row. A null vec_id takes part, but starts as a centroid only where other vectors are too few. Repeated rows count
each; of equal hashes (repeated vec_ids) the smaller vector, component by component, starts first. Fewer vectors than
centroids give fewer centroids. Ties between centroids go to the smaller number. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Squares of differences of such components are added exactly in doubles (up to 2**11 components).
FINE = 2**20
#: (vector, centroid) pairs compared at a time.
PAIRS = 1 << 15
#: Relative width of what rounding may hide.
ROUNDING = 1e-9
_LIMB = 40
_MOST = 2**63 - 1


def kept(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, embedding) -> vec_id, x of the vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(fine).select("vec_id", x.alias("x"))


def whole(x: list[float], scale: int = SCALE) -> list[int]:
    """floor(scale * component) of a vector, in Python integers."""
    return [int(c) * scale if abs(c) >= 2.0**53 else int(np.floor(c * scale)) for c in x]


class Centroids:
    """Centroids (Python integers) sorted by norm."""

    def __init__(self, at: list[list[int]]):
        self.at = at
        c = np.array([[float(x) for x in row] for row in at])
        with np.errstate(over="ignore"):
            norm = np.sqrt((c**2).sum(axis=1))
        self.number = np.argsort(norm, kind="stable")  # by norm, what number
        self.norm, self.c = norm[self.number], c[self.number]
        self.fine = np.abs(self.c).max(axis=1) < FINE

    def nearest(self, raw: np.ndarray, scale: int) -> tuple[np.ndarray, list[int], int]:
        """Of vectors: each one's centroid and squared distance, and how many pairs were compared."""
        with np.errstate(over="ignore", invalid="ignore"):
            v = np.floor(raw * float(scale))
            fine, norm = np.abs(v).max(axis=1) < FINE, np.sqrt((v**2).sum(axis=1))
            side = np.searchsorted(self.norm, norm).clip(1, max(1, len(self.norm) - 1)) - 1
            after = np.minimum(side + 1, len(self.norm) - 1)
            pivot = np.where(np.abs(self.norm[after] - norm) < np.abs(self.norm[side] - norm), after, side)
            bound = np.sqrt(((v - self.c[pivot]) ** 2).sum(axis=1))
            room = (norm + bound) * ROUNDING + ROUNDING
            low = np.searchsorted(self.norm, norm - bound - room, "left")
            high = np.searchsorted(self.norm, norm + bound + room, "right")
            unsure = ~np.isfinite(norm + bound)
            low[unsure], high[unsure] = 0, len(self.norm)
        best, number = [0] * len(v), np.zeros(len(v), np.int64)
        upto = np.append(0, np.cumsum(high - low))
        at = 0
        while at < len(v):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            count = (high - low)[at:end]
            i = np.repeat(np.arange(at, end), count)
            j = np.arange(len(i)) - np.repeat(upto[at:end] - upto[at], count) + np.repeat(low[at:end], count)
            with np.errstate(over="ignore", invalid="ignore"):
                d = ((v[i] - self.c[j]) ** 2).sum(axis=1)
            self._choose(raw, scale, i, j, d, fine[i] & self.fine[j], number, best)
            at = end
        return number, best, int(upto[-1])

    def _choose(self, raw, scale, i, j, d, exact, number, best) -> None:
        """Writes each vector's least distance; pairs of large components that may be the least are computed in integers."""
        order = np.lexsort((self.number[j], d, i))
        i, j, d, exact = i[order], j[order], d[order], exact[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        all_exact = np.logical_and.reduceat(exact, first)
        for f, row in zip(first[all_exact].tolist(), i[first[all_exact]].tolist()):
            best[row] = int(d[f])
        number[i[first[all_exact]]] = self.number[j[first[all_exact]]]
        ends = np.append(first[1:], len(i))
        for f, e in zip(first[~all_exact].tolist(), ends[~all_exact].tolist()):
            own = whole(raw[i[f]].tolist(), scale)
            limit = np.nanmin(d[f:e] * (1 + ROUNDING)) if np.isfinite(d[f:e]).any() else np.inf
            near = [int(self.number[j[p]]) for p in range(f, e) if not d[p] * (1 - ROUNDING) > limit]
            best[i[f]], number[i[f]] = min((sum((a - b) ** 2 for a, b in zip(own, self.at[n])), n) for n in near)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(x), -1)


def limbs(value: int) -> list[int]:
    """An integer as limbs of 40 bits, least first; the last one has the sign. Sums of limbs of many tasks fit into longs."""
    out = []
    while not -(1 << _LIMB) <= value < 1 << _LIMB:
        value, rest = divmod(value, 1 << _LIMB)
        out.append(rest)
    return [*out, value]


def sums(vectors: DataFrame, centroids: Centroids, scale: int, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid with vectors: how many, and their componentwise sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * len(centroids.at), np.zeros((len(centroids.at), dimensions), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch)
            number, _, _ = centroids.nearest(raw, scale)
            with np.errstate(over="ignore"):
                v = np.floor(raw * float(scale))
            fine = np.abs(v).max(axis=1) < FINE
            for k in np.unique(number).tolist():
                own = number == k
                count[k] += int(own.sum())
                total[k] += v[own & fine].astype(np.int64).sum(axis=0).astype(object)
                for row in raw[own & ~fine]:
                    total[k] += np.array(whole(row.tolist(), scale), object)
        found = [(k, d, i, limb) for k, n in enumerate(count) if n for d, value in [(-1, n), *enumerate(total[k].tolist())] for i, limb in enumerate(limbs(int(value)))]
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "component", "limb", "part"])

    made = vectors.select("x").mapInArrow(run, "cluster long, component long, limb long, part long")
    out: dict[int, dict[int, int]] = {}
    # at most centroids x (components + 1) x limbs rows
    for r in made.groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect():
        own = out.setdefault(r["cluster"], {})
        own[r["component"]] = own.get(r["component"], 0) + (r["part"] << (_LIMB * r["limb"]))
    return {k: (own[-1], [own[d] for d in range(dimensions)]) for k, own in out.items()}


def assigned(vectors: DataFrame, centroids: Centroids, scale: int) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, best, _ = centroids.nearest(_matrix(batch), scale)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(number, pa.int32()), pa.array([min(d, _MOST) for d in best], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, cluster int, distance long")


def starting(vectors: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors whose ids hash lowest (null ids last), quantised."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select(hashed.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return [whole(r["x"], scale) for r in found]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, own = vectors.sparkSession, kept(vectors, dimensions)
    at = starting(own, k, scale)
    if not at:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for number, (count, total) in sums(own, Centroids(at), scale, dimensions).items():
            at[number] = [x // count for x in total]
    found = materialise(assigned(own, Centroids(at), scale), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    clip = lambda x: min(x, _MOST)
    facts = [(c, clip(own), clip(sum(inertia.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for c, own in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _round_sql(n: int) -> str:
    return f"""
near{n} as materialized (select r, any_value(vec_id) as vec_id, arg_min(c, (d, c)) as c, min(d) as d from (
    select v.r, v.vec_id, s.c, sum((v.x - s.x) * (v.x - s.x))::bigint as d from v join start{n} s on v.i = s.i group by v.r, v.vec_id, s.c) group by r)"""


def _move_sql(n: int) -> str:
    return f""",
start{n + 1} as materialized (select s.c, s.i, coalesce(m.x, s.x) as x from start{n} s left join (
    select c, i, floor(sum(x)::double / count(*))::bigint as x from v join near{n} using (r) group by c, i) m on s.c = m.c and s.i = m.i)"""


#: Rounds spelled out; sums of 500 small components are exact in doubles.
OP12_SQL = (
    """
with k as (select row_number() over () as r, vec_id, embedding as e from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
v as materialized (select r, vec_id, unnest(range(64)) as i, unnest(list_transform(e, lambda c: floor(64 * c::double)::bigint)) as x from k),
start0 as materialized (select c, i, x from v join (
    select r, row_number() over (order by sha256('1:' || vec_id) nulls last, e) - 1 as c from k qualify c < 16) using (r)),"""
    + "".join(_round_sql(n) + _move_sql(n) + "," for n in range(ROUNDS))
    + _round_sql(ROUNDS)
    + f"""
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256
from near{ROUNDS} join (select c, sha256(string_agg(x::varchar, ',' order by i)) as h from start{ROUNDS} group by c) using (c)
"""
)
