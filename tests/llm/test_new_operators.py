"""Operators 11 to 13 against plain versions."""

import hashlib
import os
import random
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from abacora.llm import annulus, hard_negatives, minhash, registry  # noqa: E402


def found(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def linked(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def plain_groups(docs, percent=80, size=4):
    """(doc_id, text) of each row -> doc_id, n_shingles, component_id, kept."""
    sets = [brute.shingles(t, size) for _, t in docs]
    root = brute.components(range(len(docs)), lambda i, j: linked(sets[i], sets[j], percent))
    low = {}
    for i, r in root.items():
        d = docs[i][0]
        if d is not None:
            low[r] = min(low.get(r, d), d)
    out = []
    for i, (d, _) in enumerate(docs):
        c = low.get(root[i]) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


OP11 = ("doc_id", "n_shingles", "component_id", "kept")


def test_op11(spark, folder, corpus):
    assert found(registry.QUERIES["op11_minhash"](spark, folder), *OP11) == plain_groups([r[:2] for r in corpus])


@pytest.fixture(scope="module")
def planted():
    """Chains and stars of texts on both sides of 0.8, copies of many sizes, and texts of few words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, i = [], 0
    for n in (4, 5, 9, 30, 120):
        base = [word() for _ in range(n)]
        for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.08):
            for _ in range(4):
                docs.append((i, " ".join(w if rng.random() >= share else word() for w in base)))
                i += 1
        step = list(base)
        for _ in range(8):  # a chain: each is near the one before
            step[rng.randrange(n)] = word()
            docs.append((i, " ".join(step)))
            i += 1
    docs += [(900 + k, t) for k, t in enumerate(["a b c", "A  b\nc", "a b d", "one", "ONE", "É b c", "é b c", "\x85", None, "", " \t"])]
    docs += [(None, docs[0][1]), (None, "nobody else holds this text"), (5, docs[5][1]), (5, docs[5][1])]
    return docs


@pytest.mark.parametrize("parts", [(minhash.PART_SKETCHES, minhash.PART_TEXTS), (600, 900)])
def test_op11_planted_with_whole_and_cut_buckets(spark, planted, parts):
    frame = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    assert found(minhash.groups(frame, 80, 4, *parts), *OP11) == plain_groups(planted)


def test_op11_one_large_group_costs_no_square(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = [(i, " ".join([*base, f"x{i}"])) for i in range(300)]
    got = minhash.groups(spark.createDataFrame(docs, "doc_id long, text string"), 80, 4, 20 * minhash.SKETCH_BYTES, 20_000).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_op11_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    for similarity in (0.3, 0.8):
        seen = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(2000 * similarity), dtype=np.uint64)
            own = [rng.integers(0, 2**63, (2000 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
            a, b = (np.frombuffer(minhash.packed(minhash.minima(np.concatenate([both, o]))), np.uint64).reshape(minhash.BITS, -1) for o in own)
            agree = minhash.SIZE - int(np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=0)).sum())
            chance = 2.0**-minhash.BITS
            seen.append((agree / minhash.SIZE - chance) / (1 - chance))
        assert abs(np.mean(seen) - similarity) < 0.02


def plain_clusters(vectors, k=16, rounds=3, scale=64, size=64):
    kept = [(i, annulus.whole(v, scale), v) for i, v in vectors if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[2]))
    order += sorted((x for x in kept if x[0] is None), key=lambda x: x[2])
    at = [x[1] for x in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v, _ in kept]
        for n in set(own):
            members = [v for o, (_, v, _) in zip(own, kept) if o == n]
            at[n] = [sum(c) // len(members) for c in zip(*members)]
    most = 2**63 - 1
    got = [(i, *near(v)[::-1]) for i, v, _ in kept]
    total = {}
    for _, n, d in got:
        total[n] = total.get(n, 0) + min(d, most)
    digest = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(at)}
    return sorted(((i, n, min(d, most), min(total[n], most), min(sum(total.values()), most), digest[n]) for i, n, d in got), key=str)


OP12 = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors_of(rng, n, size, spread):
    return [(i, [float(np.float32(rng.uniform(-1, 1) * spread(rng))) for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("spread", [lambda rng: 1, lambda rng: 0.02, lambda rng: rng.choice([0.1, 1, 30])])
def test_op12(spark, tmp_path, spread):
    """Plain vectors, vectors so small that most distances tie, and vectors of varied lengths, with odd rows beside them."""
    rng = random.Random(12)
    vectors = vectors_of(rng, 150, 64, spread)
    vectors += [(7, vectors[7][1]), (7, vectors[8][1]), (500, None), (501, [1.0, None] * 32), (502, [float("nan")] * 64), (503, [float("-inf")] * 64), (504, [1.0] * 63), (None, vectors[3][1]), (505, [])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, cluster int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["op12_annulus"](spark, str(tmp_path))
    assert found(got, *OP12) == plain_clusters(vectors)


def test_op12_large_components_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    vectors = [(1, [1e30, 0.5]), (2, [-1e30, 2.0]), (3, [1e30, 0.25]), (4, [3.0, 4.0]), (5, [3.0, 4.5]), (6, [2.0**40, 1.0]), (7, [2.0**40 + 1, 1.0])]
    got = annulus.cluster(spark.createDataFrame(vectors, kind), k=4, scale=64, dimensions=2)
    assert found(got, *OP12) == plain_clusters(vectors, 4, 3, 64, 2)
    assert annulus.cluster(spark.createDataFrame(vectors[:0], kind), dimensions=2).collect() == []
    lone = [(None, [1.0, 2.0]), (None, [0.0, 2.0])]
    assert found(annulus.cluster(spark.createDataFrame(lone, kind), k=3, dimensions=2), *OP12) == plain_clusters(lone, 3, 3, 64, 2)


def test_op12_annulus_leaves_far_norms_out():
    rng = np.random.default_rng(4)
    at = [annulus.whole((rng.normal(size=8) * 2.0**e).tolist()) for e in range(12)]
    raw = rng.normal(size=(500, 8)) * 2.0 ** rng.integers(0, 12, (500, 1))
    number, best, pairs = annulus.Centroids(at).nearest(raw, 64)
    for x, n, d in zip(raw, number, best):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(annulus.whole(x.tolist()), c)), i) for i, c in enumerate(at))
    assert pairs < 0.6 * 500 * 12


def plain_negatives(rows, scale=256):
    """(vec_id, vector, label) -> rows of operator 13."""
    fine = [(n, i, annulus.whole(v, scale), (y + 1) % 10 if i % 7 == 0 else y) for n, (i, v, y) in enumerate(rows) if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    clip, out = lambda s: min(max(s, -(2**63)), 2**63 - 1), []
    for n, i, v, y in fine:
        if i % 50:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m, z) for m, j, w, z in fine if m != n and len(w) == len(v)]
        for s, j, _, z in sorted(x for x in score if x[3] == y)[:5]:
            others = sorted(x for x in score if x[3] != y and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, r, o[1], clip(-s), clip(-o[0])) for r, o in enumerate(others, 1)]
    return sorted(out, key=str)


OP13 = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(13)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        c, y = rng.choice(centers), rng.randrange(3) if i % 3 else 1  # one label holds a good third
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.4))) for x in c], y))
    rows += [(500 + i, rows[50][1], i % 2) for i in range(60)]  # one vector, many times
    rows += [(50, rows[50][1], 1), (50, rows[51][1], None), (600, None, 1), (601, [1.0, None] * 3, 1), (602, [float("nan")] * 6, 1), (650, [float("inf")] * 6, 1), (None, rows[3][1], 1)]
    rows += [(700, [0.5] * 4, 1), (701, [0.5] * 4, 1), (702, [0.4] * 4, 2), (750, [], 1), (751, [0.0] * 6, 9), (800, [0.0] * 6, 9)]
    return rows


def mined(spark, rows, kind="float", **how):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    frame = frame.selectExpr("vec_id", "embedding", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label")
    from abacora.llm.common import materialise

    taking = materialise(hard_negatives.taking_part(frame), "rows")
    return found(hard_negatives.mine(taking, taking["vec_id"] % 50 == 0, **how), *OP13)


@pytest.mark.parametrize("how", [{}, {"pivots": 5, "block_bytes": 1024}])
def test_op13(spark, labelled, how):
    assert mined(spark, labelled, **how) == plain_negatives(labelled)


def test_op13_large_components(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [6e29, 1.0], 2), (3, [9e29, 1.0], 2), (4, [1.0, 1.0], 1), (50, [2.0, 1.0], 1), (51, [1.9, 1.0], 2), (52, [1e30, 0.0], 2), (100, [-1e30, 0.0], 1)]
    assert mined(spark, rows, "double") == plain_negatives(rows)


def test_op13_shells_copy_near_rows_only(spark):
    """On well-parted clusters, rows go to few of the cells."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(8, 16)) * 6
    rows = [(i, (centers[i % 8] + rng.normal(size=16) * 0.1).tolist(), i % 3) for i in range(800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    from abacora.llm.common import materialise

    taking = materialise(hard_negatives.taking_part(frame), "rows")
    pivots = hard_negatives.Pivots(taking.orderBy("row").limit(16).collect(), float(taking.selectExpr("max(norm)").first()[0]))
    low = spark.createDataFrame([(i, 0, i, 0, 16, rows[i][1], float(np.linalg.norm(np.floor(np.array(rows[i][1]) * 256))), False, str(int(0.98 * (np.floor(np.array(rows[i][1]) * 256) ** 2).sum())), None) for i in range(0, 800, 50)], hard_negatives._REQUEST)
    shell = hard_negatives.shells(hard_negatives.placed(low, pivots).selectExpr("*", "0L as key"), pivots)
    cells = shell.groupBy("size", "key", "cell").agg({"inner": "min", "outer": "max"}).toDF("size", "key", "cell", "a", "b")
    if cells.columns != ["size", "key", "cell", "a", "b"]:
        raise AssertionError
    one = cells.selectExpr("size", "key", "struct(cell, least(a, b) as inner, greatest(a, b) as outer) as s").groupBy("size", "key").agg({"s": "collect_list"}).toDF("size", "key", "shells")
    met = hard_negatives.routed(taking.selectExpr("*", "0L as key").join(one, ["size", "key"]), pivots)
    copies = sum(len(r["cells"]) for r in met.select("cells").collect())
    assert 0 < copies < 0.7 * 800 * cells.count()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, spark, sf_dir):
    sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
    from oracle import connect, rows

    con = connect(sf_dir)
    assert isinstance(con, duckdb.DuckDBPyConnection)
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())
