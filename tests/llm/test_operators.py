"""Operators against plain versions, on a corpus of odd rows and on empty tables."""

import math
import os
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from abacora.llm import byte_bpe, common, near_copies, packing, quality_classifier, quality_rules, registry, simhash, suffix_dedup, topk_search, url_filter, window_index  # noqa: E402


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(name, spark, empty_folder):
    assert registry.QUERIES[name](spark, empty_folder).count() == 0


def test_op1(spark, folder, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = registry.QUERIES["op1_packing"](spark, folder).collect()
    want = defaultdict(list)
    for doc, text, *_ in corpus:
        want[doc].append(np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        expected = sorted((at // 4, len(raw[at : at + 4096]) // 4, zlib.crc32(raw[at : at + 4096]), len(raw) // 4) for raw in texts for at in range(0, len(raw), 4096))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc]) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_packing_is_tight_and_whole():
    rng = np.random.default_rng(1)
    lengths = np.minimum(1024, rng.geometric(0.003, 20_000))
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    patterns = packing.shortest_pack_first(histogram, 1024)
    placed = defaultdict(int)
    for n, p in patterns:
        assert sum(p) <= 1024 and list(p) == sorted(p, reverse=True)
        for x in p:
            placed[x] += n
    assert dict(placed) == histogram
    assert sum(n for n, _ in patterns) * 1024 < 1.02 * lengths.sum()


def test_op1_special_strings_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = packing.SliceIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), limit=3)
    for text in ("a<|endoftext|>b", "x  y", " x", "x ", "x\n y", "don't 's", "  ", "é日本 ½", "a b c d e a b"):
        assert ids.document(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(ids) <= 3


def test_op2(spark, folder, corpus):
    got = rows(registry.QUERIES["op2_quality_rules"](spark, folder), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for doc, text, *_ in corpus:
        c = brute.base_counts(text)
        want.append((doc, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want, key=str)
    assert not [r for r in registry.QUERIES["op2_quality_rules"](spark, folder).where("base_failed and kept").collect()]


def test_op2_perplexity_and_verdict_against_plain_version(spark, folder, corpus):
    got = registry.QUERIES["op2_quality_rules"](spark, folder).collect()
    by_lang = defaultdict(list)
    for doc, text, lang, *_ in corpus:
        by_lang[lang or ""].append((doc, text or ""))
    want = []
    for rows_ in by_lang.values():
        price = brute.kneser_ney([t for _, t in rows_ if t])
        judged = []
        for doc, text in rows_:
            c = brute.base_counts(text)
            judged.append((doc, len(text), price(text) if text else None, c[0] < 10 or 100 * c[4] > 20 * c[0]))
        fine = [x for _, _, x, failed in judged if x is not None and not failed]
        if fine:
            middle = brute.quantile(fine, 0.5)
            width = quality_rules.WIDTH * (middle - brute.quantile(fine, 0.05))
        for doc, n, x, failed in judged:
            kept = not failed and (not fine or (x is not None and abs(x - middle) <= width + quality_rules.SHORT / math.sqrt(n) + 1e-9))
            want.append((doc, None if x is None else round(x, 4), kept))
    assert sorted(((r["doc_id"], r["perplexity"] and round(math.log(r["perplexity"]), 4), r["kept"]) for r in got), key=str) == sorted(want, key=str)


def test_op4_perplexity_and_verdict_against_plain_version(spark, folder, corpus):
    got = registry.QUERIES["op4_quality_classifier"](spark, folder).collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] != 1 and r["doc_id"] is not None}
    texts = defaultdict(list)
    for doc, text, lang, *_ in corpus:
        if doc in good and text:
            texts[lang or ""].append(text)
    price = {lang: brute.kneser_ney(t) for lang, t in texts.items()}
    want = []
    for doc, text, lang, *_ in corpus:
        lang = lang or ""
        x = price[lang](text) if lang in price and text else None
        kept = True
        if x is not None:
            own = [(price[lang](t), len(t)) for t in texts[lang]]
            middle = brute.quantile([p for p, _ in own], 0.5)
            kept = (x - middle) * math.sqrt(len(text)) <= brute.quantile([(p - middle) * math.sqrt(n) for p, n in own], quality_classifier.QUANTILE) + 1e-4
        want.append((doc, None if x is None else round(x, 4), kept))
    assert sorted(((r["doc_id"], r["perplexity"] and round(math.log(r["perplexity"]), 4), r["kept"]) for r in got), key=str) == sorted(want, key=str)
    assert {k for _, _, k in want} == {True, False}


def test_op2_rejects_on_both_sides_of_the_band(spark):
    """Of texts of the same words, one of a single letter lies below the band and one of any letters above it."""
    rng = random.Random(12)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    known = [word("etaoinshrdlu", 2, 9) for _ in range(60)]
    texts = {i: " ".join(rng.choice(known) for _ in range(200)) for i in range(60)}
    texts[100] = " ".join(word("e", 2, 14) for _ in range(200))
    texts[101] = " ".join(word("etaoinshrdlu", 2, 9) for _ in range(200))
    judged = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in judged.values())
    assert judged[100]["log_ppl"] < min(judged[i]["log_ppl"] for i in range(60)) and judged[101]["log_ppl"] > max(judged[i]["log_ppl"] for i in range(60))
    assert not judged[100]["kept"] and not judged[101]["kept"]
    assert sum(judged[i]["kept"] for i in range(60)) >= 57


def test_op2_op4_reject_junk_and_keep_clean(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for name, junk in (("op2_quality_rules", 0.6), ("op4_quality_classifier", 0.6)):
        kept = {r["doc_id"] for r in registry.QUERIES[name](spark, folder).where("kept").collect()}
        good = [d for d, r in labels.items() if r["quality"] == 1 and len(texts[d].split()) >= 10]
        bad = [d for d, r in labels.items() if r["quality"] == 0]
        assert sum(d in kept for d in good) >= 0.98 * len(good)
        assert sum(d not in kept for d in bad) >= junk * len(bad)


def test_op2_rejects_three_quarters_of_labelled_junk(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in registry.QUERIES["op2_quality_rules"](spark, folder).where("n_words >= 10").collect() if r["doc_id"] in labels]
    clean, junk = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    print("kept: clean", sum(clean), len(clean), "junk", sum(junk), len(junk))
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(junk) <= 0.25 * len(junk)


def test_op4_model_against_plain_sums(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "thé cät"]
    m = quality_classifier.model(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    p = {r["g"]: r["p"] for r in m["p3"].collect()}
    share = {r["ctx"]: r["share"] for r in m["share3"].collect()}
    by_context = defaultdict(float)
    for g, x in p.items():
        assert 0 < x < 1
        by_context[g >> quality_classifier.POINT] += x
    assert set(by_context) == set(share)
    assert all(total < 1 + 1e-9 for total in by_context.values())  # the rest is left for unseen symbols
    needed = spark.createDataFrame([("en", int(g)) for g in quality_classifier.grams("the xyz")], "lang string, g long")
    prices = [r["logp"] for r in quality_classifier.priced(needed, m).collect()]
    assert len(prices) == 7 and all(x < 0 for x in prices)


def test_op4_without_labels_keeps_all(spark, folder, empty_folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = spark.read.parquet(f"{empty_folder}/labels.parquet")
    assert quality_classifier.keep_good(docs, none).count() == docs.count()
    assert quality_classifier.keep_good(docs, none).columns == docs.columns


def test_op3_rules(spark, folder):
    got = {r["page_id"]: r for r in registry.QUERIES["op3_url_filter"](spark, folder).collect()}
    parts = {0: ("", ""), 1: ("", ""), 2: ("", ""), 3: ("a.example.com", "/en/x"), 4: ("www.example.com", "/en/"), 8: ("com", ""), 9: ("x.org", "/p"), 10: ("net", "/es/"), 11: ("y:", "//z.com/a")}
    for page, (host, path) in parts.items():
        assert (got[page]["host"], got[page]["path"]) == (host, path)
    rules = {3: ("example.com/en/", "block"), 4: ("www.example.com/en/", "allow"), 5: ("net/es/", "block"), 6: ("net/fr/", "block"), 10: ("net/es/", "block")}
    for page, (rule, verdict) in rules.items():
        assert (got[page]["rule"], got[page]["verdict"]) == (rule, verdict)
    assert all(got[p]["rule"] is None and got[p]["verdict"] in ("allow", "block") for p in (0, 1, 2, 7, 8, 9, 11))


def test_op3_scores_and_verdicts_against_plain_version(spark):
    rng = random.Random(21)
    pages = []
    for i in range(400):
        host, path = rng.choice([("a.com", "p"), ("shop.com", "item/é"), ("b.net", "es/x"), ("c.net", "fr/y"), ("d.org", "es/q"), ("e.org", "item"), ("f.io", "")])
        tail = rng.choice(["", f"?id={rng.randrange(99)}", "#top", f"?sex={rng.randrange(9)}&ad=1"])
        pages.append((i, f"http{rng.choice(['', 's'])}://{host}/{path}{rng.randrange(50)}{tail}"))
    pages += [(900, None), (901, ""), (902, "no scheme here")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(frame).collect()}
    held = {r["page_id"] for r in frame.where(url_filter.F.pmod(url_filter.F.xxhash64("url"), url_filter.F.lit(url_filter.FOLDS)) == 0).collect()}
    symbols = url_filter.symbol_table()
    learn = lambda says: brute.witten_bell([u for i, u in pages if got[i]["rule"] and got[i]["verdict"] == says and i not in held], lambda c: int(symbols[ord(c)]), url_filter.SYMBOLS, url_filter.ORDER)
    allow, block = learn("allow"), learn("block")
    score = {i: (sum(allow(u)) - sum(block(u))) / len(u) if u else 0.0 for i, u in pages}
    for i, u in pages:
        assert abs(got[i]["score"] - score[i]) < 1e-4, u
    labelled = [(score[i], got[i]["verdict"]) for i in held if got[i]["rule"]]
    sides = [[s for s, v in labelled if v == x] for x in ("block", "allow")]
    right = lambda cut: sum(s < cut for s in sides[0]) / len(sides[0]) + sum(s >= cut for s in sides[1]) / len(sides[1])
    free = [got[i] for i, _ in pages if not got[i]["rule"]]
    blocked, allowed = [r["score"] for r in free if r["verdict"] == "block"], [r["score"] for r in free if r["verdict"] == "allow"]
    assert blocked and allowed and max(blocked) < min(allowed)  # one threshold, and no better one for the held-out urls
    grid = [-4 + 8 * k / url_filter.BINS for k in range(url_filter.BINS + 1)]
    assert right((max(blocked) + min(allowed)) / 2) >= max(map(right, grid)) - 0.1
    assert len({round(got[i]["score"], 6) for i, u in pages if u and "f.io" in u}) > 1  # the query string counts


def test_op3_model_separates_held_out_urls(spark):
    rng = np.random.default_rng(2)
    make = lambda host, i: (i, f"http://{''.join(rng.choice(list('abc'), 5))}.{host}/{rng.integers(999)}")
    pages = [make("good.com", i) for i in range(300)] + [(1000 + i, f"http://x{rng.integers(99)}.net/es/{rng.integers(9999)}") for i in range(300)]
    pages += [(2000 + i, f"http://x{rng.integers(99)}.org/es/{rng.integers(9999)}") for i in range(50)] + [(3000 + i, f"http://{''.join(rng.choice(list('abc'), 5))}.good.org/{rng.integers(999)}") for i in range(50)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string")).where("rule is null").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] < 3000) for r in got)
    assert len(got) == 100 and right >= 90


def plain_top(vectors, k=5):
    """(vec_id, vector) rows -> query_id, rank, vec_id, score of every row whose id is divisible by 50."""
    fine = [(i, [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(fine):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(fine) if other != at and len(w) == len(v))[:k]
            want += [(q, n + 1, i, min(max(-x, -(2**63)), 2**63 - 1)) for n, (x, i) in enumerate(s)]
    return sorted(want, key=str)


def searched(frame, **options):
    made = topk_search.materialise(topk_search.taking_part(frame), "vectors")
    return rows(topk_search.top_k(made, topk_search.F.col("vec_id") % 50 == 0, **options), "query_id", "rank", "vec_id", "score")


def test_op5(spark, folder):
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = plain_top([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert rows(registry.QUERIES["op5_topk_search"](spark, folder), "query_id", "rank", "vec_id", "score") == want
    assert searched(frame.select("vec_id", "embedding"), block_bytes=300, probe=20) == want


@pytest.mark.parametrize("kind, scale", [("float", 1.0), ("double", 1.0), ("double", 4e13), ("double", 1e200), ("double", 1e307)])
def test_op5_repeated_ids_and_large_values(spark, kind, scale):
    rng = random.Random(6)
    vectors = [(i % 130, [float(rng.randrange(-6, 7)) * (scale if rng.random() < 0.02 else 1.0) for _ in range(5)]) for i in range(200)]
    vectors += [(50, [scale] * 5), (50, [scale] * 5), (7, [0.1, -0.1, 0.3, -scale, scale])]
    frame = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")
    want = plain_top(vectors) if kind == "double" else plain_top([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert searched(frame) == want
    assert searched(frame, block_bytes=900, probe=10) == want


def test_op5_resolves_few_entries():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    make = lambda n, at: topk_search.Side(pa.table({"row": np.arange(at, at + n), "vec_id": np.arange(at, at + n), "x": list(rng.normal(size=(n, 64)))}))
    queries, rows_, sample = make(40, 0), make(20_000, 100), make(2048, 50_000)
    cut = np.array([b[-1] for b in topk_search.probed(queries, sample, 5, 4)])
    found, count = topk_search.resolved(queries, rows_, cut, 5, 4)
    whole = queries.v @ rows_.v.T
    for i in range(queries.n):
        best = sorted((s for a, _, s in found if a == i), reverse=True)[:5]
        assert best == [int(x) for x in np.sort(whole[i])[::-1][:5] if x >= cut[i]][: len(best)]
    assert 0 < count < 0.5 * queries.n * rows_.n  # the others were never summed


@pytest.mark.parametrize("crowd, batches, fan_in", [(4096, 3, 2), (1, 5, 1), (4096, 1, 2)])
def test_op6(spark, folder, corpus, monkeypatch, crowd, batches, fan_in):
    real, made = window_index.remove_windows, window_index.FingerprintIndex(spark, fan_in)
    monkeypatch.setattr(window_index, "remove_windows", lambda d: real(d, batches=batches, index=made, crowd=crowd))
    got = rows(window_index.op6_window_index(spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows([(r[0], r[1]) for r in corpus]), key=str)
    assert any(r[2] for r in got)
    assert len(made.runs) <= max(2, fan_in) and bool(made.compactions) == (batches > fan_in)
    made.drop()


def test_op6_compacts_in_its_query(spark, folder, monkeypatch):
    seen, compact = [], window_index.FingerprintIndex.compact
    monkeypatch.setattr(window_index.FingerprintIndex, "compact", lambda self: (seen.append(len(self.runs)), compact(self)))
    window_index.op6_window_index(spark, folder)
    assert seen and not spark.sql("show tables").where("tableName like 'run%'").count()


def test_op6_leaves_no_runs_behind(spark, folder, monkeypatch):
    """The index lies in the shared folder while the query needs it, and is gone afterwards, also where a batch fails."""
    runs = lambda: {p for p in Path(common.shared_folder(spark).removeprefix("file:").replace("//", "/")).iterdir() if p.name.startswith("run_")}
    before, add, seen = runs(), window_index.FingerprintIndex.add, []

    def fails(self, batch):
        found = add(self, batch)
        seen.append(len(runs() - before))
        if len(seen) == 5:
            raise RuntimeError("lost")
        return found

    monkeypatch.setattr(window_index.FingerprintIndex, "add", fails)
    window_index.op6_window_index(spark, folder)
    assert seen == [1, 2, 2] and runs() == before
    with pytest.raises(RuntimeError, match="lost"):
        window_index.op6_window_index(spark, folder)
    assert seen[-1] == 2 and runs() == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_op6_words_that_polynomial_hashes_confuse(spark, tmp_path):
    """Two words of 1,024 letters in Thue-Morse order share every polynomial hash modulo 2**64."""
    order = ["ab"[bin(i).count("1") % 2] for i in range(1024)]
    one, two = "".join(order), "".join("ab"["ab".index(c) ^ 1] for c in order)
    same = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{same} {two}"), (4, f"x {same} {one} y")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(window_index.op6_window_index(spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows(docs), key=str) and [r[2] for r in got] == [0, 0, 13, 13]


def test_op6_a_document_that_repeats_itself(spark, tmp_path):
    """One context very often in one document, and an edge of it in another: nothing is removed from the first."""
    phrase = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"{phrase} " * 500), (2, f"a {phrase} b"), (3, " ".join(phrase.split()[3:17]) + " c"), (4, f"{phrase} " * 50)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(window_index.op6_window_index(spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows(docs), key=str)


def test_op6_random_overlaps(spark, tmp_path):
    rng = random.Random(12)
    pool = [f"{c}{i}" for i in range(7) for c in ("a", "longer", "é")]
    pieces = [[rng.choice(pool) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    docs = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pieces)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(3, 60)] + [rng.choice(pool)] * rng.randrange(3)
        docs.append((rng.randrange(60), " ".join(w)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(window_index.op6_window_index(spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows(docs), key=str)


def test_op6_separators_do_not_count(spark, tmp_path):
    rng = random.Random(11)
    pool = ["a", "of", "the", "word", "éé", "longerword", "and,", "end.", "Abc", "日本"]
    docs = []
    for i in range(30):
        w = [rng.choice(pool) + str(rng.randrange(100)) for _ in range(40)]
        docs += [(3 * i, " ".join(w)), (3 * i + 1, "\r\n      ".join(" ".join(w[j : j + 5]) for j in range(0, 40, 5))), (3 * i + 2, "".join(x + rng.choice([" ", "  ", "\t \t"]) for x in w))]
    for a, b, c in zip(docs[::3], docs[1::3], docs[2::3]):
        keys = [sorted(set(window_index.Runs([t]).key.tolist())) for _, t in (a, b, c)]
        assert keys[0] == keys[1] == keys[2]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(window_index.op6_window_index(spark, str(tmp_path)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.windows(docs), key=str)


def test_op7(spark, folder, corpus):
    got = registry.QUERIES["op7_simhash"](spark, folder).collect()
    want = {}
    for doc, text, *_ in corpus:
        want.setdefault(brute.fingerprint(text), []).append(doc)
    root = brute.components(want, lambda a, b: bin(a ^ b).count("1") <= 2)
    low = defaultdict(lambda: None)
    for fp, docs in want.items():
        ids = [d for d in docs if d is not None]
        if ids:
            low[root[fp]] = min([*ids, *([low[root[fp]]] if low[root[fp]] is not None else [])])
    expected = sorted(((d, f"{fp:016x}", low[root[fp]]) for fp, docs in want.items() for d in docs), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == expected


@pytest.mark.parametrize("bucket", [4096, 10])
def test_op7_links_connect_like_all_pairs(spark, bucket):
    rng = np.random.default_rng(1)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = np.unique(np.concatenate([b ^ one(120) ^ one(120) for b in rng.integers(0, 2**64, 4, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    near = {(r["a"], r["b"]) for r in simhash.links(frame, 2, bucket).collect()}
    near |= {(b, a) for a, b in near}
    nodes = [int(x) for x in fps.view(np.int64)]
    close = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    assert all(close(a, b) for a, b in near)
    groups = lambda linked: {frozenset(n for n in nodes if r[n] == x) for r in [brute.components(nodes, linked)] for x in set(r.values())}
    assert groups(lambda a, b: (a, b) in near) == groups(close)


def test_bit_planes_count_exactly():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**64, (2, 300), dtype=np.uint64)
    b[:200] = a[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    p, q = simhash.bit_planes(a), simhash.bit_planes(b)
    for radius in (0, 1, 2, 5, 24):
        over = simhash._lanes(simhash.far(lambda i: p[i] ^ q[i], (p.shape[1],), radius), 300)
        assert over.tolist() == [bin(int(x) ^ int(y)).count("1") > radius for x, y in zip(a, b)]


def test_near_copies_keep_one(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and {r["rid"] for r in kept.collect()} == {"mine"}
    sets = {}
    for doc, text, *_ in corpus:
        sets.setdefault(brute.shingles(text), []).append(doc)
    root = brute.components(sets, lambda a, b: bool(a | b) and len(a & b) >= 0.8 * len(a | b))
    groups = defaultdict(list)
    for s, docs_of in sets.items():
        groups[root[s]] += docs_of
    want = sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def test_large_buckets_are_dealt_in_parts(spark, words):
    base = words(300).split(" ")
    texts = [" ".join([*base[: 10 + i], f"new{i}", *base[11 + i :]]) for i in range(60)]
    nodes = near_copies.sketches(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "rid long, doc_id long, text string"))
    found = near_copies.links(nodes.select("node", "fp", "bands", "short"), bucket=8).collect()
    ids = {r["node"] for r in nodes.collect()}
    pairs = {(r["a"], r["b"]) for r in found} | {(r["b"], r["a"]) for r in found}
    assert len(set(brute.components(ids, lambda a, b: (a, b) in pairs).values())) == 1
    roots = near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bucket=8).collect()
    assert len({r["root"] for r in roots}) == 1


@pytest.mark.parametrize("bucket, held", [(4096, near_copies.BUCKET_BYTES), (6, near_copies.BUCKET_BYTES), (4096, 4000)])
def test_near_copies_link_from_the_stated_similarity_on(spark, monkeypatch, bucket, held):
    monkeypatch.setattr(near_copies, "BUCKET_BYTES", held)
    """Planted pairs on both sides of 0.8: none above it is lost, none below it is linked."""
    rng = random.Random(8)
    texts, above, pairs = [], 0, 0
    for i in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        near = list(base)
        for _ in range(max(1, int(len(base) * rng.choice([0.005, 0.01, 0.02, 0.025, 0.03, 0.05])))):
            near[rng.randrange(len(near))] = f"n{rng.randrange(5000)}"
        texts += [" ".join(base), " ".join(near)]
    got = {r["doc_id"]: r["root"] for r in near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bucket=bucket).collect()}
    for i in range(0, len(texts), 2):
        a, b = brute.shingles(texts[i]), brute.shingles(texts[i + 1])
        close = len(a & b) >= 0.8 * len(a | b)
        above += close
        pairs += close and got[i] == got[i + 1]
        assert close or got[i] != got[i + 1]
    assert 20 < above < 140 and pairs >= 0.99 * above


@pytest.mark.parametrize("crowd", [8192, 1])
def test_op9(spark, folder, corpus, monkeypatch, crowd):
    real = suffix_dedup.cleaned
    monkeypatch.setattr(suffix_dedup, "cleaned", lambda d: real(d, crowd=crowd))
    got = rows(suffix_dedup.op9_suffix_dedup(spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = []
    for (doc, text, *_), gone in zip(corpus, brute.byte_repeats([r[1] for r in corpus])):
        data = (text or "").encode()
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((doc, len(data), sum(gone), spans, brute.sha(bytes(b for b, g in zip(data, gone) if not g))))
    assert got == sorted(want, key=str)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("crowd", [8192, 2])
def test_op9_words_that_polynomial_hashes_confuse_and_edges(spark, tmp_path, crowd):
    """Thue-Morse texts share polynomial hashes; edges of one passage differ by single bytes; one text holds a passage often."""
    order = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    one, two = "".join(order), "".join("ab"["ab".index(c) ^ 1] for c in order)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(520)
    texts = [f"{noise(300)}{one}{noise(300)}", f"{noise(300)}{two}{noise(9)}", one[:700], passage * 4]
    texts += [noise(rng.randrange(50)) + passage[rng.randrange(90) : 430 + rng.randrange(90)] + noise(rng.randrange(50)) for _ in range(25)]
    texts += [noise(400), noise(399), passage[:400], passage[:399], "x" * 1000, "x" * 399]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = suffix_dedup.cleaned(spark.read.parquet(f"{tmp_path}/documents.parquet"), crowd=crowd).collect()
    got = {r["doc_id"]: suffix_dedup._spans(r["spans"]).tolist() for r in found}
    for (doc, _), gone in zip(docs, brute.byte_repeats(texts)):
        flat = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(gone, np.uint8), 0].astype(int)))
        assert got[doc] == flat.reshape(-1, 2).tolist(), doc


def test_op9_in_the_pipeline_keeps_columns(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cut = suffix_dedup.cut_repeats(docs, 256)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    want = []
    for (doc, text, *_), gone in zip(corpus, brute.byte_repeats([r[1] for r in corpus], 256)):
        want.append((doc, bytes(b for b, g in zip((text or "").encode(), gone) if not g).decode(errors="ignore") if text is not None else None))
    assert rows(cut, "doc_id", "text") == sorted(want, key=str)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(7)
    for _ in range(200):
        s = rng.integers(1, 4, rng.integers(1, 50))
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_op8_op10(spark, folder, corpus):
    import base64

    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = sorted(((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, *_ in corpus), key=str)
    assert rows(registry.QUERIES["op8_token_counts"](spark, folder), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t, *_ in corpus:
        ids = coder.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())))
    assert rows(registry.QUERIES["op10_byte_bpe"](spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_op10_round_trip_by_offsets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    coded, coder = byte_bpe.encode_documents(docs).persist(), byte_bpe.PairMerger(P.path("byte_bpe_50k.tiktoken"))
    for r, text in zip(coded.collect(), (x["text"] for x in docs.collect())):
        text = text or ""
        assert len(r["offsets"]) == len(r["id_offsets"]) and list(r["offsets"]) == sorted(set(r["offsets"]))
        bounds = [*r["offsets"], len(text)]
        whole, begins = coder.decode(bytes(r["ids"]), r["id_offsets"])
        begins = [*begins.tolist(), len(whole)]
        assert [whole[i:j] for i, j in zip(begins, begins[1:])] == [text[a:b].encode() for a, b in zip(bounds, bounds[1:])]
    got = sorted((str(r["doc_id"]), bytes(r["text_bytes"])) for r in byte_bpe.decode_documents(coded).collect())
    assert got == sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in docs.collect())


def test_op10_every_code_point_before_a_quote_and_doubled():
    """Every code point as c's and as cc, where its class decides what the quote and the second one belong to."""
    import base64

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.PairMerger(P.path("byte_bpe_50k.tiktoken"))
    for low in range(0, 0x110000, 0x3000):
        text = "".join(f"{c}'s b{c}{c} a1{c}b'{c}\n" for c in map(chr, range(low, min(low + 0x3000, 0x110000))) if not 0xD800 <= ord(c) < 0xE000)
        assert np.frombuffer(b"".join(own.encode(text)[0]), "<u4").tolist() == library.encode_ordinary(text), hex(low)
    assert own.encode("\u1c8a's")[0] and len(library.encode_ordinary("\u1c8a's")) == len(b"".join(own.encode("\u1c8a's")[0])) // 4


@pytest.mark.parametrize("crowd", [8192, 1])
@pytest.mark.parametrize("ids", [(1, 1), (None, None), (1, 1, 1), (1, 1, 2)])
def test_op9_rows_that_are_repeated_alone(spark, ids, crowd):
    """Equal rows are different places: the whole text goes from each of them, if no other row holds it too."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(700))
    docs = spark.createDataFrame([*((i, text) for i in ids), (7, other)], "doc_id long, text string")
    found = suffix_dedup.cleaned(docs, crowd=crowd).collect()
    got = sorted((str(r["doc_id"]), suffix_dedup._spans(r["spans"]).tolist()) for r in found)
    assert got == sorted([*((str(i), [[0, 1000]]) for i in ids), ("7", [])])


def test_caches_keep_no_long_slices():
    from abacora.llm import token_counts

    ids = packing.SliceIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    counter = token_counts.MergeCounter(P.path("piece_bpe_32k.model"))
    text = "a " + "xyz" * 5000 + " b " + "é" * 199
    assert ids.document(text) == ids.document(text) and counter.count(text) == counter.count(text)
    assert ids and counter and max(map(len, [*ids, *counter])) < 200
