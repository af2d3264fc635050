"""Operator 13: hard negatives by a Voronoi-partitioned k-nearest-neighbour join of inner products.

An inner product becomes a distance by one component more: rows get sqrt(M**2 - |x|**2) (M: the largest norm), anchors get
zero; then the larger product is the smaller distance. Pivots (a bounded sample of PIVOTS rows, and the origin) cut the space
into cells. A request is an anchor that wants its k best rows with scores in an interval, of its own label or of others.

1. Every request is joined with rows of its own cell, so its k-th best score there is a lower limit.
2. Interval and limit bound the distance of rows that a request can use; over the requests of a cell this gives a shell
   around the cell's pivot. A row is copied to those cells only whose shell its distance to their pivots meets.
3. Each cell's requests and rows meet in blocks of bounded size and are joined exactly; a request's best of all blocks stay.

First the positives are requested (same label, any score), then for each positive its negatives (another label, the interval
the positive's score allows). Bounds are doubles widened by a relative 1e-6, scores are integers: floor(scale * x) is exact, sums
of small components are below 2**53, rows of larger ones go to every cell and are multiplied as Python integers. Scores beyond
a long are returned as the nearest long, but compared by their true value.

In 64 random dimensions shells are wide, and most rows are copied to most cells; the work is then anchors times rows in
blocks, dealt evenly. Rows of one label or one cell may be a third of all: blocks cut them by counts.

Nulls: a null vec_id, label or vector, an empty vector, or a null or non-finite component takes no part. Vectors of another
dimension than the anchor's are no partners. Every row counts, also rows that repeat a vec_id, each as anchor and as partner
of its namesakes. Ties go to the smaller vec_id, then to the row that is read first. A positive of a negative score
allows no interval and gives no row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .topk_search import SCALE, Side, _sortable

#: Rows that are pivots, at most; the table of pivots is sent to all tasks.
PIVOTS = 48
#: Bytes of one side of a block, and scores held at a time.
BLOCK_BYTES = 8 << 20
CELLS = 1 << 20
ROUNDING = 1e-6
#: The cell of anchors whose components are too large for bounds: all rows are copied to it.
ANYWHERE = -1
_KIND = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
_ROW = "row long, vec_id long, label long, size int, x array<double>, norm double, large boolean"
_REQUEST = "arow long, slot int, anchor_id long, label long, size int, x array<double>, norm double, large boolean, low string, high string"
_PLACED = f"{_REQUEST}, cell int, far double"
_FOUND = "arow long, slot int, vec_id long, row long, score long, beyond string"


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(*(part.split()[0], _KIND[part.split()[1]])) for part in ddl.split(", ")])


def _batches(work, ddl: str):
    """mapInArrow's function from one of a batch (rows, at least one) to columns."""
    target = _schema(ddl)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, made[f.name]) for f in target)], schema=target)

    return run


def _vectors(batch) -> list[np.ndarray]:
    """Each row's quantised components as doubles (rows of different sizes)."""
    x = batch.column("x").combine_chunks() if isinstance(batch, pa.Table) else batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        v = np.floor(flat * SCALE)
    ends = np.cumsum(x.value_lengths().to_numpy())
    return np.split(v, ends[:-1])


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> row (a number of its own), vec_id, label, size, x, norm (of the quantised vector), large."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.where(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size(x).alias("size"), F.transform(x, lambda c: c.cast("double")).alias("x"))

    def measured(batch):
        made = {name: batch.column(name) for name in ("row", "vec_id", "label", "size", "x")}
        v = _vectors(batch)
        with np.errstate(over="ignore"):
            made["norm"] = [float(np.sqrt((a**2).sum())) for a in v]
        made["large"] = [bool(np.abs(a).max() > np.sqrt(2.0**53 / len(a)) - 1) for a in v]
        return made

    return rows.mapInArrow(_batches(measured, _ROW), _ROW)


class Pivots:
    """Pivot vectors by dimension, with their added component; pivot 0 is the origin, whatever the dimension."""

    def __init__(self, rows: list, most: float):
        self.most, self.at = most, {}
        for r in rows:
            self.at.setdefault(r["size"], []).append(np.floor(np.array(r["x"]) * SCALE))
        self.at = {size: np.array([np.zeros(size), *v]) for size, v in self.at.items()}
        self.added = {size: np.sqrt(np.maximum(0, most**2 - (v**2).sum(axis=1))) * (np.arange(len(v)) > 0) for size, v in self.at.items()}

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.at[size], self.added[size]) if size in self.at else (np.zeros((1, size)), np.zeros(1))

    def distances(self, v: np.ndarray, anchor: bool) -> np.ndarray:
        """From vectors of one dimension to their pivots, [vectors, pivots]."""
        p, added = self.of(v.shape[1])
        square = (v**2).sum(axis=1)
        own = np.zeros(len(v)) if anchor else np.sqrt(np.maximum(0, self.most**2 - square))
        return np.sqrt(np.maximum(0, square[:, None] + (p**2).sum(axis=1)[None, :] - 2 * v @ p.T + (own[:, None] - added[None, :]) ** 2))

    def room(self, norm: float) -> float:
        return ROUNDING * (self.most + norm + 1)


def _by_size(v: list[np.ndarray], large: np.ndarray):
    """Positions of small vectors of each dimension, and these as a matrix."""
    sizes = np.array([len(a) for a in v])
    for size in np.unique(sizes[~large]).tolist():
        at = np.flatnonzero((sizes == size) & ~large)
        yield at, np.array([v[i] for i in at])


def placed(requests: DataFrame, pivots: Pivots) -> DataFrame:
    """Each request with the cell of its anchor and the anchor's distance to that cell's pivot."""

    def work(batch):
        made = {f: batch.column(f) for f in _schema(_REQUEST).names}
        v, large = _vectors(batch), batch.column("large").to_numpy(zero_copy_only=False)
        cell, far = np.full(len(v), ANYWHERE, np.int32), np.zeros(len(v))
        for at, matrix in _by_size(v, large):
            d = pivots.distances(matrix, True)
            cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
        return made | {"cell": cell, "far": far}

    return requests.mapInArrow(_batches(work, _PLACED), _PLACED)


def home_cells(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """row, cell: the cell whose pivot is nearest, for small rows."""

    def work(batch):
        v, large = _vectors(batch), batch.column("large").to_numpy(zero_copy_only=False)
        cell = np.full(len(v), ANYWHERE, np.int32)
        for at, matrix in _by_size(v, large):
            cell[at] = pivots.distances(matrix, True).argmin(axis=1)  # as an anchor at this place would be dealt
        return {f: batch.column(f) for f in _schema(_ROW).names} | {"cell": cell}

    return rows.mapInArrow(_batches(work, f"{_ROW}, cell int"), f"{_ROW}, cell int")


def shells(requests: DataFrame, pivots: Pivots) -> DataFrame:
    """size, key, cell, inner, outer for each placed request: between which distances to the cell's pivot its rows lie."""

    def work(batch):
        norm, far = batch.column("norm").to_numpy(zero_copy_only=False), batch.column("far").to_numpy(zero_copy_only=False)
        inner, outer = np.zeros(len(norm)), np.full(len(norm), np.inf)
        for i, (cell, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "low", "high")))):
            if cell == ANYWHERE:
                continue
            base, room = norm[i] ** 2 + pivots.most**2, pivots.room(norm[i])
            bounded = lambda s: float(max(-(10**300), min(10**300, int(s))))
            if low is not None:  # no row is farther than a score of `low` puts it
                outer[i] = far[i] + math.sqrt(max(0.0, base - 2 * bounded(low))) + room
            if high is not None:
                inner[i] = max(0.0, math.sqrt(max(0.0, base - 2 * bounded(high))) - far[i] - room)
        return {"size": batch.column("size"), "key": batch.column("key"), "cell": batch.column("cell"), "inner": inner, "outer": outer}

    return requests.select("size", "key", "cell", "norm", "far", "low", "high").mapInArrow(_batches(work, kind := "size int, key long, cell int, inner double, outer double"), kind)


def routed(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """Rows with `shells` (array of cell, inner, outer) -> the same rows with `cells`, those whose shell they meet."""

    def work(batch):
        v, large = _vectors(batch), batch.column("large").to_numpy(zero_copy_only=False)
        wanted = batch.column("shells").to_pylist()
        cells: list[list[int]] = [[s["cell"] for s in w] for w in wanted]  # of large rows all
        for at, matrix in _by_size(v, large):
            d = pivots.distances(matrix, False)
            room = pivots.room(float(np.sqrt((matrix**2).sum(axis=1)).max()))
            for i, own in zip(at.tolist(), d):
                cells[i] = [s["cell"] for s in wanted[i] if s["cell"] == ANYWHERE or s["inner"] - room <= own[s["cell"]] <= s["outer"] + room]
        return {f: batch.column(f) for f in (*_schema(_ROW).names, "key")} | {"cells": cells}

    return rows.mapInArrow(_batches(work, kind := f"{_ROW}, key long, cells array<int>"), kind)


def best_of_block(requests: pa.Table, rows: pa.Table, same: bool, k: int) -> list[tuple]:
    """Exact: each request's k best rows of the block -> (request's position, vec_id, row, score)."""
    renamed = requests.rename_columns([{"arow": "row", "anchor_id": "vec_id"}.get(c, c) for c in requests.column_names])
    q, c = Side(renamed), Side(rows)
    q_label, c_label = requests.column("label").to_numpy(), rows.column("label").to_numpy()
    low = [None if s is None else int(s) for s in requests.column("low").to_pylist()]
    high = [None if s is None else int(s) for s in requests.column("high").to_pylist()]
    bounded = lambda s: float(max(-(2**60), min(2**60, s)))  # noqa: E731  small scores are below 2**53
    cut = np.array([-np.inf if s is None else bounded(s) for s in low])
    top = np.array([np.inf if s is None else bounded(s) for s in high])
    out, step = [], max(1, CELLS // max(1, len(q.small)))
    at_q = q.small
    for at in range(0, len(c.small), step):
        which = c.small[at : at + step]
        if not len(at_q):
            break
        score = q.v[at_q] @ c.v[which].T
        fits = (q_label[at_q, None] == c_label[None, which]) == same
        fits &= (q.row[at_q, None] != c.row[None, which]) & (score <= top[at_q, None]) & (score >= cut[at_q, None])
        if len(which) >= k:  # the k-th best of the block is a limit for the next ones too
            held = np.where(fits, score, -np.inf)
            cut[at_q] = np.maximum(cut[at_q], np.partition(held, len(which) - k, axis=1)[:, len(which) - k])
            fits &= score >= cut[at_q, None]
        i, j = np.nonzero(fits)
        order = np.lexsort((c.row[which[j]], c.vec_id[which[j]], -score[i, j], i))
        i, j = i[order], j[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        i, j = i[keep], j[keep]
        out += zip(at_q[i].tolist(), c.vec_id[which[j]].tolist(), c.row[which[j]].tolist(), map(int, score[i, j].tolist()))
    pairs = [(a, b) for a in np.flatnonzero(q.large).tolist() for b in range(c.n)] + [(a, b) for a in q.small.tolist() for b in np.flatnonzero(c.large).tolist()]
    for a, b in pairs:
        if q.row[a] != c.row[b] and (q_label[a] == c_label[b]) == same:
            s = sum(x * y for x, y in zip(q.whole(a), c.whole(b)))
            if (low[a] is None or s >= low[a]) and (high[a] is None or s <= high[a]):
                out.append((a, int(c.vec_id[b]), int(c.row[b]), s))
    by_request: dict[int, list] = {}
    for a, vec_id, row, s in out:
        by_request.setdefault(a, []).append((-s, vec_id, row))
    return [(a, vec_id, row, -s) for a, found in by_request.items() for s, vec_id, row in sorted(found)[:k]]


def _entries(requests: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    kind = _schema(_FOUND)
    if not requests.num_rows or not rows.num_rows:
        return kind.empty_table()
    found = best_of_block(requests, rows, same, k)
    arow, slot = requests.column("arow").to_pylist(), requests.column("slot").to_pylist()
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    columns = list(zip(*((arow[a], slot[a], v, r, clip(s), _sortable(s)) for a, v, r, s in found))) or [[]] * 6
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, kind)], schema=kind)


def _limits(requests: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """The k-th best score of each request in a part of its own cell, as text; requests with fewer have none."""
    kind = _schema("arow long, slot int, limit string")
    if not requests.num_rows or not rows.num_rows:
        return kind.empty_table()
    scores: dict[int, list[int]] = {}
    for a, _, _, s in best_of_block(requests, rows, same, k):
        scores.setdefault(a, []).append(s)
    full = [(a, min(s)) for a, s in scores.items() if len(s) == k]
    arow, slot = requests.column("arow").to_pylist(), requests.column("slot").to_pylist()
    return pa.table([pa.array(x, f.type) for x, f in zip([[arow[a] for a, _ in full], [slot[a] for a, _ in full], [str(s) for _, s in full]], kind)], schema=kind)


def _higher(batch):
    """low becomes the higher of low and limit."""
    made = {f: batch.column(f) for f in _schema(_PLACED).names}
    made["low"] = [a if b is None else b if a is None else str(max(int(a), int(b))) for a, b in zip(batch.column("low").to_pylist(), batch.column("limit").to_pylist())]
    return made


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, for the other side of a cogroup."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def voronoi_join(requests: DataFrame, rows: DataFrame, pivots: Pivots, same: bool, k: int, block: int) -> DataFrame:
    """Placed requests and rows (written) -> arow, slot, vec_id, row, score, beyond, rank: each request's k best.

    block: rows of a block's side, about.
    """
    label = F.col("label") if same else F.lit(0).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = ["size", "key", "cell"]
    # 1: lower limits from a part of the own cell, dealt so that no part grows beyond a block or two
    asked = requests.withColumn("key", label)
    at_home = materialise(home_cells(rows, pivots).where(F.col("cell") != ANYWHERE).withColumn("key", label), "home")
    parts = asked.where(F.col("cell") != ANYWHERE).select(*own).union(at_home.select(*own)).groupBy(*own).agg((F.floor(F.count("*") / block) + 1).alias("parts"))
    parts = materialise(parts, "parts")
    left = asked.join(parts, own).withColumn("part", F.pmod(F.xxhash64("arow", "slot"), "parts"))
    right = at_home.join(_anew(parts), own).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    limits = left.groupBy(*own, "part").cogroup(right.groupBy(*own, "part")).applyInArrow(lambda a, b: _limits(a, b, same, k), "arow long, slot int, limit string")
    limited = requests.join(limits, ["arow", "slot"], "left").mapInArrow(_batches(_higher, _PLACED), _PLACED)
    asked = materialise(limited.withColumn("key", label), "asked")
    discard(at_home)
    # 2: shells of cells, and the rows that meet them
    shell = shells(asked, pivots).groupBy(*own).agg(F.min("inner").alias("inner"), F.max("outer").alias("outer"))
    shell = materialise(shell.groupBy("size", "key").agg(F.collect_list(F.struct("cell", "inner", "outer")).alias("shells")), "shells")
    met = materialise(routed(rows.withColumn("key", label).join(shell, ["size", "key"]), pivots).where(F.size("cells") > 0), "met")
    copies = met.withColumn("cell", F.explode("cells")).drop("cells")
    # 3: blocks
    counted = lambda df, name: df.groupBy(*own).agg((F.floor(F.count("*") / block) + 1).alias(name))
    blocks = materialise(counted(asked, "ab").join(counted(copies.select(*own), "rb"), own), "blocks")
    left = asked.join(blocks, own).withColumn("a", F.pmod(F.xxhash64("arow", "slot"), "ab")).withColumn("b", every(F.col("rb")))
    right = copies.join(_anew(blocks), own).withColumn("b", F.pmod(F.xxhash64("row"), "rb")).withColumn("a", every(F.col("ab")))
    keys = [*own, "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _entries(a, b, same, k), _FOUND)
    best = Window.partitionBy("arow", "slot").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _true(score: int, beyond: str | None) -> int:
    if beyond is None:
        return score
    return int(beyond) if score > 0 else -int(beyond.translate(str.maketrans("0123456789", "9876543210")))


def _intervals(low: int, high: int):
    """Positives with their anchors' vectors -> requests for scores s with low * positive <= 100 * s <= high * positive."""

    def work(batch):
        made = {f: batch.column(f) for f in _schema(_REQUEST).names if f not in ("low", "high")}
        true = [_true(s, b) for s, b in zip(batch.column("score").to_pylist(), batch.column("beyond").to_pylist())]
        return made | {"low": [str(-(-low * p // 100)) for p in true], "high": [str(high * p // 100) for p in true]}

    return work


def mine(rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of taking_part(), written -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    facts = rows.agg(F.max(F.when(~F.col("large"), F.col("norm"))).alias("most"), F.max("size").alias("size")).first()
    chosen = rows.where(~F.col("large")).orderBy(F.xxhash64("row"), "row").limit(pivots).select("size", "x").collect()
    cells = Pivots(chosen, float(facts["most"] or 0))
    block = max(1, block_bytes // (8 * int(facts["size"] or 1)))
    anchors = rows.where(is_anchor).select(F.col("row").alias("arow"), F.col("vec_id").alias("anchor_id"), "label", "size", "x", "norm", "large")
    kind = [part.split()[0] for part in _REQUEST.split(", ")]
    free = F.lit(None).cast("string")
    first = materialise(placed(anchors.withColumns({"slot": F.lit(0), "low": free, "high": free}).select(*kind), cells), "anchors")
    best = voronoi_join(first, rows, cells, True, positives, block)
    best = materialise(best.select("arow", F.col("rank").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), "score", "beyond"), "positives")
    wanted = anchors.join(best, "arow").where("score >= 0").mapInArrow(_batches(_intervals(low, high), _REQUEST), _REQUEST)
    wanted = materialise(placed(wanted.where("low is not null"), cells), "requests")
    found = voronoi_join(wanted, rows, cells, False, negatives, block).select("arow", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    named = best.select("arow", "slot", "positive_id", F.col("score").alias("positive_score")).join(anchors.select("arow", "anchor_id"), "arow")
    return found.join(named, ["arow", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has its label moved to the next of ten; every fiftieth is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = materialise(taking_part(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("label", label)), "rows")
    return mine(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
with v as materialized (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
    from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
scored as materialized (select a.r as ar, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
    from v a join v b on a.vec_id % 50 = 0 and a.r <> b.r and len(a.x) = len(b.x)),
positives as (select ar, anchor_id, r, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by ar order by score desc, vec_id, r) <= 5)
select p.anchor_id, p.positive_id, (row_number() over best)::int as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.ar = p.ar and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
window best as (partition by p.ar, p.r order by n.score desc, n.vec_id, n.r) qualify row_number() over best <= 3
"""
