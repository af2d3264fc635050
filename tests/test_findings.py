"""Cases that a review found, each failing before its change."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from oracle import rows  # noqa: E402

from abacora.plans.catalog import ORACLES, QUERIES  # noqa: E402


def both(spark, name, folder, *tables):
    """A query's rows and its SQL's, on the named tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return rows(QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(ORACLES[name]).df())


@pytest.fixture
def folder(tmp_path, sf_dir):
    """A folder with the given SQL's rows in place of some tables."""

    def made(**tables):
        con = duckdb.connect()
        for name in os.listdir(sf_dir):
            con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
        for name, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
        return tmp_path

    return made


def test_trend_rounds_halves_to_even(spark, folder):
    """Orders of 16 lines of which 1, 3, ... 15 are right score 6.25, 18.75 and so on."""
    orders = "select o_orderkey, 1 as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey < 16"
    lines = "select o.i as l_orderkey, (select min(p_partkey) from part) as l_partkey, l.* exclude (l_orderkey, l_partkey, l_returnflag), case when l.n < o.i then 'N' else 'R' end as l_returnflag from range(16) o(i), (select *, row_number() over () - 1 as n from lineitem limit 16) l"
    made = folder(part="select * from part", orders=orders, lineitem=lines)
    got, want = both(spark, "agg_score_trend", made, "part", "orders", "lineitem")
    assert got == want and len(got[1]) == 1 and "62" in got[1][0][0].split(",")


def test_all_trusted_documents_train(spark):
    """Operator 4 learns from every document labelled good, however many they are."""
    from abacora.llm import quality_classifier

    labels = spark.range(60_000).selectExpr("id % 30000 as doc_id", "cast(id % 30000 < 25000 as int) as quality", "cast(0 as int) as toxic")
    assert quality_classifier.trusted_ids(labels).count() == 25_000
    found = spark.range(25_000).selectExpr("'en' as lang", "100L as n_chars", "id / 25000 as log_ppl", "true as trusted")
    bound = quality_classifier.limits(found).first()
    assert (bound["middle"], round(bound["reach"], 9)) == (12499 / 25_000, round((24974 - 12499) / 2500, 9))


def test_links_of_sets_of_all_kinds(spark):
    """Links counted by groups are those of all pairs: copies, sets with tokens of their own, chains, empty sets, one set in two concepts."""
    import random

    from abacora.operators.pairs import set_links

    rng = random.Random(5)
    sets = [rng.sample("abcdefgh", rng.randrange(0, 7)) + [f"own{i}"] * (i % 2) for i in range(150)] + [["x", "y", "z", f"n{i}"] for i in range(20)] + [[]] * 2 + [["p", "q"]] * 3
    data = [("one" if i % 3 else "two", i, s) for i, s in enumerate(sets)]
    linked = {i: {j: len({*s} & {*t}) / len({*s} | {*t}) for d, j, t in data if c == d and i != j and s and t and len({*s} & {*t}) / len({*s} | {*t}) >= 0.6} for c, i, s in data}

    def low(i):
        seen, todo = {i}, [i]
        while todo:
            new = set(linked[todo.pop()]) - seen
            seen |= new
            todo += new
        return min(seen)

    got = {r["id"]: (r["class_id"], r["n_links"], r["closest"]) for r in set_links(spark.createDataFrame(data, "concept string, id long, tokens array<string>"), 0.6).collect()}
    assert got == {i: (low(i), len(near), max(near.values(), default=None)) for i, near in linked.items()}


def test_term_index_is_built_without_shuffling_postings(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from abacora.functions.text import terms
    from abacora.operators.lexical_index import LexicalIndex

    def shuffled():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size, before = docs.selectExpr("sum(octet_length(text))").first()[0], shuffled()
    index = LexicalIndex(spark, str(tmp_path / "index"))
    index.rebuild(docs, "now", 0.0)
    assert shuffled() - before < 3 * size  # mostly terms' frequencies, which stand out where texts are few
    assert {(r["doc_id"], r["dl"], tuple(sorted(r["terms"]))) for r in index.documents().collect()} == {(r["doc_id"], len(r["t"]), tuple(sorted({*r["t"]}))) for r in docs.select("doc_id", terms(F.col("text")).alias("t")).collect()}


def test_similarity_is_whole_where_it_reaches_the_threshold():
    import random

    from abacora.functions.similarity import similarity, similarity_from

    rng = random.Random(7)
    words = ["how", "many", "red", "rods", "rod", "in", "box", "12", "21", "a", "a", "is"]
    stems = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 8))) for _ in range(40)] + [f"how many {c} rods are in box {i}" for c in ("red", "old") for i in range(95, 125)]
    full = {(x, y): similarity(x, y) for x in stems for y in stems}
    near = {pair for pair, s in full.items() if s >= 0.84}
    assert {pair for pair in full if similarity_from(*pair, 0.84) >= 0.84} == near and len({pair for pair in near if len({*pair}) > 1}) > 200
    assert all(similarity_from(*pair, 0.84) == full[pair] for pair in near)


def _stem_rows():
    import random

    rng = random.Random(11)
    words = ["how", "many", "red", "rods", "rod", "in", "box", "12", "2.5", "A = {1, 2}", "A = {2, 3}", "∪", "∩", "a", "a", "is"]
    stems = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 8))) for _ in range(120)] + [f"How many {c} rods are in box {i}?" for c in ("red", "old") for i in range(95, 125)]
    stems += ["Define a red rod.", "define A red rod"] * 6 + [None, "  ", "?"] * 2
    for n in (40, 64, 65, 90, 199, 200, 230, 400):  # about the sizes that are aligned in different ways
        long = "".join(rng.choice("abcdefgh ") for _ in range(n - 2))
        stems += [f"x{long}y", f"x{long}yz", f"q{long}y", f"x{long[: n // 2]}{'0' * (n // 3)}{long[n // 2 :]}y"]
    rng.shuffle(stems)
    return [(rng.choice(["m", "m", "m", "n", None]), i, s) for i, s in enumerate(stems)]


@pytest.mark.parametrize("block", [4096, 40])
def test_similar_pairs_are_those_of_every_two_stems(spark, block):
    """values, orientation and data rule as stem by stem, whether a concept is one block or many."""
    from abacora.functions.similarity import similarity, too_similar
    from abacora.operators.pairs import similar_pairs

    rows = _stem_rows()
    frame = spark.createDataFrame(rows, "concept string, id long, text string")
    want = [(i, j, round(similarity(s, t), 6), too_similar(s, t)) for c, i, s in rows for d, j, t in rows if c is not None and c == d and i < j and round(similarity(s or "", t or ""), 6) >= 0.84]
    assert sorted(map(tuple, similar_pairs(frame, block=block).collect())) == want
    text = {i: s for _, i, s in rows}
    assert 30 < sum(x[3] for x in want) < len(want) and {len(text[i]) // 100 for i, *_ in want} >= {0, 1, 2}
    named = frame.withColumn("id", F.format_string("k%03d", "id"))
    assert sorted(map(tuple, similar_pairs(named, block=block).collect())) == [(f"k{i:03}", f"k{j:03}", s, x) for i, j, s, x in want]


def test_matches_are_those_of_sequence_matcher():
    """runs that tie, repeat and overlap."""
    import random
    from difflib import SequenceMatcher

    import numpy as np

    from abacora.functions.alignment import matches

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    codes, sizes = np.zeros((len(texts), 40), dtype=np.uint8), np.array([len(x) for x in texts])
    for row, x in zip(codes, texts):
        row[: len(x)] = [ord(c) for c in x]
    u, v = (x.ravel() for x in np.mgrid[: len(texts), : len(texts)])
    assert matches(codes, codes, sizes, sizes, u, v).tolist() == [sum(m.size for m in SequenceMatcher(None, texts[i], texts[j]).get_matching_blocks()) for i, j in zip(u, v)]


def test_near_dup_stems_shuffles_stems_not_pairs(spark, tmp_path):
    """pairs that cannot be similar are neither listed nor shuffled, of which a concept has the square of its stems."""
    def shuffled():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    names = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("hot", "cold", "old", "blue"))), (1 + F.col("id") % 4).cast("int")), F.element_at(F.array(*map(F.lit, ("bolt", "gear", "ring"))), (1 + F.col("id") % 3).cast("int")))
    parts = spark.range(0, 1500, 1, 4).select(F.col("id").alias("p_partkey"), names.alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit(13).alias("p_size"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    before = shuffled()
    found = QUERIES["near_dup_stems"](spark, str(tmp_path)).count()
    assert found > 100_000 and shuffled() - before < 1500 * 100
