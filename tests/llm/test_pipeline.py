"""The pipeline: columns, stages that take effect, and the guard around it."""

import os
import sys

import corpus_pipeline as C
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from abacora.llm import quality_classifier, quality_rules, registry
from abacora.llm.common import materialise

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402


def test_stages(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns
        after = docs.count()
        assert after <= before
        before = after
    ids = [r["doc_id"] for r in docs.collect()]
    assert 0 not in ids and 1 not in ids and 2 not in ids  # no words
    assert sum(i in (3, 4, 5, 9) for i in ids) <= 2  # copies
    packed = C.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(ids)


def test_stages_against_plain_versions(spark, folder, corpus):
    """Each stage on what its predecessor kept, against brute force; the two models are held elsewhere, so their own operators'
    verdicts decide here which rows must stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text_of = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)
    stages = dict(C.STAGES)
    quality = {(r["doc_id"], r["rid"]) for r in quality_rules.quality(docs.select("doc_id", "text", "lang")).where("kept").collect()}
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "lang", "text"))
    want = sorted(((r["doc_id"], r["text"]) for r in keyed.collect() if (r["doc_id"], r["_k"]) in quality), key=str)
    good = materialise(stages["quality_rules"](spark, docs, folder), "good")
    assert text_of(good) == want
    trusted = materialise(stages["quality_classifier"](spark, good, folder), "trusted")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bad = {(r["doc_id"], r["rid"]) for r in quality_classifier.verdicts(good.select("doc_id", "text", "lang"), labels).where("not kept").collect()}
    assert text_of(trusted) == sorted(((r["doc_id"], r["text"]) for r in good.withColumn("_k", F.xxhash64("doc_id", "lang", "text")).collect() if (r["doc_id"], r["_k"]) not in bad), key=str)
    once = materialise(stages["simhash_near_dedup"](spark, trusted, folder), "once")
    sets = {}
    for doc, text in text_of(trusted):
        sets.setdefault(brute.shingles(text), []).append((doc, text))
    root = brute.components(sets, lambda a, b: bool(a | b) and len(a & b) >= 0.8 * len(a | b))
    groups = {}
    for s, members in sets.items():
        groups.setdefault(root[s], []).extend(members)
    assert sorted((min((d for d, _ in g if d is not None), default=None) for g in groups.values()), key=str) == sorted((d for d, _ in text_of(once)), key=str)
    cut = materialise(stages["suffix_array_dedup"](spark, once, folder), "cut")
    rows = text_of(once)
    gone = brute.byte_repeats([t for _, t in rows], C.PASSAGE)
    assert text_of(cut) == sorted(((d, bytes(b for b, g in zip(t.encode(), x) if not g).decode(errors="ignore")) for (d, t), x in zip(rows, gone)), key=str)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lengths = {}
    for r in stages["packing"](spark, cut, folder).collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    totals = {}
    for d, t in text_of(cut):
        totals[d] = totals.get(d, 0) + len(library.encode(t, add_special_tokens=False).ids) + 1
    assert lengths == totals
    ids = lambda frame: sorted(((r["doc_id"], r["length"], r["start"]) for r in frame.collect()), key=str)
    assert ids(C.run(spark, folder)) == ids(stages["packing"](spark, cut, folder))


def test_run_on_empty_tables(spark, empty_folder):
    assert C.run(spark, empty_folder).count() == 0


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert "pipeline" in names and set(registry.QUERIES) <= set(names)
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
