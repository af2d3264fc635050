import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid string, key int, copy string"


def row(doc_id, text, lang="en"):
    return doc_id, text, lang, "src0", None if text is None else len(text), "mine", 7, "x"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    pool = ["a", "of", "the", "éé", "dd\x85x", "longerword", "and,", "x#y", "Abc", "日本"]
    return lambda n: " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(words):
    """Odd rows: nulls, empties, copies, near copies, shared passages, a very long text, repeated rows, equal ids."""
    base, passage = words(400), words(90)
    tokens = base.split(" ")
    near = " ".join(tokens[:200] + ["changed"] + tokens[201:])
    rows = [row(None, base), row(0, None), row(1, ""), row(2, " \n\t "), row(3, base), row(4, base), row(5, near), row(5, words(30)), row(6, "a " * 60), row(7, words(12)), row(8, words(9000))]
    rows += [row(9, base, None), row(9, base, None), row(10, "'s don't  we'll\n\n x" * 20, "xx"), row(11, words(12) + "\n" + words(12))]
    rows += [row(20 + i, words(i % 7) + " " + passage + " " + words(3 + i % 5), "fr") for i in range(12)]
    rows += [row(40 + i, words(60)) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    """The corpus as an input folder, with small tables beside it, all with extra columns of clashing names."""
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(corpus, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0, "mine") for r in corpus if r[0] is None or r[0] >= 20] + [(3, 0, None, "mine"), (4, None, 1, "mine")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, rid string").write.parquet(f"{path}/labels.parquet")
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://b.net/es/1", "http://b.net/fr/2", "http://b.net/de/2", "http://com", "https://x.org/p?q", "http://net/es/", "x://y://z.com/a"]
    pages = [(i, u, "<html>", "mine") for i, u in enumerate(urls * 3)] + [(None, "http://q.com/a", None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    vectors += [(200 + i, vectors[50][1]) for i in range(9)] + [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (350, [float("inf")] * 6), (None, vectors[0][1]), (400, [0.5] * 4)]
    spark.createDataFrame([(i, v, 0, (i or 0) % 3) for i, v in vectors], "vec_id long, embedding array<float>, score int, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="session")
def empty_folder(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path
