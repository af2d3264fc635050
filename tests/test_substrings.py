"""Many substrings at once, against plain search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from abacora.functions.automaton import Automaton, laid_out
from abacora.operators import retrieval, substrings


def plain(texts, patterns):
    return {(i, p, t.encode().find(s.encode())) for i, t in texts if t is not None for p, s in patterns if s and s in t}


@pytest.mark.parametrize("prefix", [2, 5, 24])
def test_automaton_finds_every_place(prefix):
    rng = random.Random(prefix)
    for letters in ("ab", "abcdé "):
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))
        patterns = sorted({word(rng.randrange(1, 9)) for _ in range(40)} | {word(60) for _ in range(3)})
        texts = [word(rng.randrange(0, 300)) for _ in range(30)] + [word(3000), "", patterns[0], "x" + patterns[-1]]
        got = Automaton([p.encode() for p in patterns], prefix).find(*laid_out(pa.array(texts)))
        want = set()
        for i, t in enumerate(texts):
            data = t.encode()
            for k, p in enumerate(patterns):
                p, at = p.encode(), data.find(p.encode())
                while at >= 0:
                    want.add((i, k, at))
                    at = data.find(p, at + 1)
        assert set(zip(*(x.tolist() for x in got))) == want and len(got[0]) == len(want)


def test_automaton_of_many_bytes_and_of_none():
    every = ["".join(chr(c) for c in range(a, a + 40)) for a in range(32, 2000, 7)]
    texts = pa.array(["zz" + p + "zz" for p in every] + [""]).slice(3)
    got = Automaton([p.encode() for p in every]).find(*laid_out(texts))
    assert {(i + 3, i + 3, 2) for i in range(len(every) - 3)} <= set(zip(got[0] + 3, got[1], got[2]))
    assert all(len(x) == 0 for x in Automaton([]).find(np.frombuffer(b"abc", np.uint8), np.array([0, 3])))


@pytest.mark.parametrize("states", [substrings.STATES, 16])
def test_contained(spark, states):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    texts = [(i, word(rng.randrange(200))) for i in range(60)] + [(60, None), (61, ""), (None, "abc"), (3, "abcabc")]
    patterns = [(i, word(rng.randrange(1, 7))) for i in range(50)] + [(50, ""), (51, None), (52, texts[5][1]), (7, "cab")]
    a, b = spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame(patterns, "p long, s string")
    fine = [(i, t) for i, t in texts if i is not None]
    got = {tuple(r) for r in substrings.contained(a.where("id is not null"), b, states, 2).collect()}
    assert got == plain(fine, patterns)
    assert substrings.contained(a, b.where("p = 50")).count() == 0
    assert substrings.contained(a.where("false"), b).count() == 0


def test_copied_questions_by_both_ways(spark, monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "x", "y2"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(i, text(80)) for i in range(40)]
    questions = [(i, chunks[i % 40][1][i : i + 30 + i]) for i in range(40)] + [(100 + i, text(9)) for i in range(20)] + [(200, "alphabetagammadelta" * 3)]
    chunks.append((40, "q " + "alphabetagammadelta" * 4))
    q, c = spark.createDataFrame(questions, "item_id long, text string"), spark.createDataFrame(chunks, "doc_id long, text string")
    few = {r["item_id"] for r in retrieval.copied_questions(q, c).collect()}
    assert 200 in few and few == {i for i, s in questions if len(s.strip()) >= 40 and any(s.strip() in t for _, t in chunks)}
    monkeypatch.setattr(retrieval, "FEW_QUESTIONS", 3)
    assert {r["item_id"] for r in retrieval.copied_questions(q, c).collect()} == few


def test_no_join_of_texts_and_patterns(spark, sf_dir):
    from abacora.plans.catalog import QUERIES

    for name in ("contamination_semi_join", "evidence_first_unit"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan
