import random

import pytest
from pyspark.sql import functions as F

from abacora.operators import adaptive as D
from abacora.operators.chunking import chunk_pack, pack_tokens, packed


def test_chunks_lose_no_token_and_keep_limits():
    rng = random.Random(1)
    for _ in range(60):
        units, n = [], 0
        for _ in range(rng.randint(1, 14)):
            size = rng.randint(1, 900)
            units.append([f"t{n + i}" for i in range(size)])
            n += size
        chunks = pack_tokens(units, whole=True)
        assert {t for c in chunks for t in c} == {t for u in units for t in u}
        assert all(len(c) <= 450 for c in chunks)
        if n >= 360:
            assert all(len(c) >= 300 for c in chunks[-1:])
        for c in chunks:  # order is kept inside a chunk
            assert [int(t[1:]) for t in c] == sorted(int(t[1:]) for t in c)


def test_chunks_by_the_rules():
    unit = lambda a, n: [f"{a}{i}" for i in range(n)]
    # two pages of 410 tokens: the second begins with the first one's last 60 and is cut off at 450
    a, b = unit("a", 410), unit("b", 410)
    assert pack_tokens([a, b]) == [a, (a[-60:] + b)[:450]]
    # a chunk ends at its target; a short last chunk is filled up from the one before it
    x = [unit("x", 200), unit("y", 170), unit("z", 50)]
    first = x[0] + x[1]
    assert pack_tokens(x) == [first, (first + first[-60:] + x[2])[-316:]]
    # a unit beyond the limit is cut into windows of the target that overlap
    long = unit("l", 900)
    assert [c[0] for c in pack_tokens([long])][0] == "l0" and all(300 <= len(c) <= 450 for c in pack_tokens([long]))
    # a short first chunk is filled up from the one behind it; a short source stays as it is
    s, t = unit("s", 100), unit("t", 400)
    assert pack_tokens([s, t]) == [(s + s[-60:] + t)[:316], (s[-60:] + t)[:450]]
    assert pack_tokens([s]) == [s] and pack_tokens([]) == []


def _catalogue(seen, accuracy):
    return [{"topic_id": f"g{g}_{i:02d}", "grade": g, "families": [str(i % 5)], "periods": 1 + i % 9, "seen": seen(g, i), "accuracy": accuracy, "last_attempt": 0} for g, n in ((10, 31), (11, 25)) for i in range(n)]


def test_selection_quotas_and_rotation():
    first = D.select_topics(_catalogue(lambda g, i: False, 0.0), "s")
    assert len(first) == 25 and len({r["topic_id"] for r in first}) == 25
    assert sorted(sum(r["grade"] == g for r in first) for g in (10, 11)) == [12, 13]
    ids = {r["topic_id"] for r in first}
    second = D.select_topics([{**r, "seen": r["topic_id"] in ids, "accuracy": 1.0} for r in _catalogue(lambda g, i: False, 0.0)], "t", odd=1)
    assert not ids & {r["topic_id"] for r in second}


def test_weak_topics_are_reviewed():
    first = {r["topic_id"] for r in D.select_topics(_catalogue(lambda g, i: False, 0.0), "s")}
    again = D.select_topics([{**r, "seen": r["topic_id"] in first, "accuracy": 0.0} for r in _catalogue(lambda g, i: False, 0.0)], "u")
    assert sum(r["topic_id"] in first for r in again) == 8


def test_budget_and_passages(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["aaaa", "bbbbbbbb", "cc"],)], "p array<string>")
    assert df.select(D.budget_fill(F.col("p"), F.lit(2), 9)).first()[0] == "cc\n\naaaa"
    long = " ".join(f"w{i}" for i in range(90)) + ". Too short. One two three four five six seven eight."
    got = spark.createDataFrame([(long,)], "t string").select(D.evidence_passages(F.col("t"))).first()[0]
    assert [len(p.split()) for p in got] == [40, 40, 34, 8]


def test_salvage():
    assert D.salvage('```json\n[{"a": 1,},]\n```') == [{"a": 1}]
    assert D.salvage('Sure! {"x": "\\frac{1}{2}"} done') is not None
    assert D.salvage("nothing") is None
    assert D.salvage(r'{"q": "\\alpha \sqrt2 \underline x \u00e9", "ok": true}') == {"q": r"\alpha \sqrt2 \underline x é", "ok": True}


def test_first_of_similar_stems(spark):
    from abacora.functions import similarity as M
    from abacora.operators import pairs

    rng = random.Random(3)
    words = ["sum", "angle", "area", "of", "the", "a", "triangle", "square", "find", "with", "sides", "5 cm", "6 cm", "x"]
    stems = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(60)] + ["", "Find the area.", "find the AREA.", "Find the areas."] * 2
    rows = [(rng.choice("ab"), i, s) for i, s in enumerate(stems)]
    frame = spark.createDataFrame(rows, "concept string, id long, text string")
    got = sorted(r["id"] for r in pairs.keep_first_stems(frame).collect())
    assert got == M.keep_first([(c, s) for c, _, s in rows])
    close = {(r["a"], r["b"]) for r in pairs.similar_pairs(frame).collect()}
    want = {(i, j) for c, i, s in rows for d, j, t in rows if c == d and i < j and round(M.similarity(s, t), 6) >= 0.84}
    assert close == want and want


def test_solvers_settle_every_kind(spark, sf_dir):
    from abacora.functions.solvers import SOLVERS
    from abacora.plans.catalog import QUERIES

    solved = [r["solved"] for r in QUERIES["closed_form_solvers"](spark, sf_dir).collect()]
    assert {s.split(":")[0] for s in solved if s} == {name for name, _ in SOLVERS}
    assert sum(s is not None and len(s.split(":")[1]) == 1 for s in solved) >= 0.9 * len(solved)
    errors = [r["errors"] for r in QUERIES["explanation_errors"](spark, sf_dir).collect()]
    assert any(e == "" for e in errors) and len(set(errors)) > 5
    texts = {r["text"] for r in QUERIES["explanation_remap"](spark, sf_dir).collect()}
    assert "Options D/C fail; the option C is correct, so the correct answer is C." in texts


def test_functions_in_sql(spark):
    from abacora.functions import surface

    names = surface.register(spark)
    assert len(names) == len(set(names)) > 20
    row = spark.sql("SELECT normal_text('A  b!'), topic_slug('  Sets & logic '), safe_image_url('/static/quiz_images/' || md5('x') || '.png'), answer_match('1/2', array('0.5', '2')), option_text('(b) 5'), stable_seed('x') >= 0, first_code('a 1.2 b')").first()
    assert tuple(row) == ("a b", "sets_logic", True, 1, "5", True, "1.2")
    assert spark.sql("SELECT is_too_similar('Define a set.', 'define a SET.')").first()[0]


def test_packing_holds_a_few_chunks_of_a_source_of_any_length():
    """Units are taken one by one: after each chunk only what it needed has been read."""
    taken = 0

    def units():
        nonlocal taken
        for i in range(100_000):
            taken += 1
            yield [f"t{i}"] * 50

    chunks = packed(units())
    for n in range(20):
        assert len(next(chunks)) >= 300
        assert taken <= 10 * (n + 4)


def test_chunk_pack_over_frames_equals_packing_of_each_source(spark):
    rng = random.Random(3)
    sources = {s: [" ".join(f"{s}{i}" for _ in range(rng.randrange(0, 700))) for i in range(rng.randrange(1, 60))] for s in "abcdefgh"}
    rows = [(s, i, t) for s, texts in sources.items() for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = chunk_pack(spark.createDataFrame(rows, "source string, ord long, text string").repartition(5), "c").collect()
    want = {(s, i): " ".join(c) for s, texts in sources.items() for i, c in enumerate(pack_tokens([t.split() for t in texts]))}
    assert {(r["source"], r["index"]): r["text"] for r in got} == want and len(got) == len(want)
    assert all(r["token_count"] == len(r["text"].split()) for r in got)


@pytest.mark.parametrize("limits", [{}, {"low": 9, "target": 12, "high": 16, "overlap": 3}, {"low": 9, "target": 12, "high": 16, "overlap": 3, "whole": True}, {"low": 30, "target": 31, "high": 40, "overlap": 1}])
def test_packing_spread_over_tasks_equals_packing_of_each_source(spark, limits):
    """Every source is long here; blocks and ranges of chunks are small, so that most chunks begin in another task's block."""
    rng = random.Random(31)
    reach = limits.get("high", 450) * 5 // 4
    lengths = {"mixed": (0, reach), "short": (0, 3), "half": (reach // 3, reach // 2), "large": (reach, 3 * reach), None: (1, reach)}
    sources = {s: [" ".join(f"{i}.{j}" for j in range(rng.randint(*n))) for i in range(180)] for s, n in lengths.items()} | {"one": ["a b c"], "none": ["", " "], "tiny": ["x"] * 7}
    rows = [(s, i, t) for s, texts in sources.items() for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = chunk_pack(spark.createDataFrame(rows, "source string, ord long, text string").repartition(5), "c", long=-1, block=7, together=5, **limits).collect()
    want = {(s, i): " ".join(c) for s, texts in sources.items() for i, c in enumerate(pack_tokens([t.split() for t in texts], **limits))}
    assert len(got) == len(want) and {(r["source"], r["index"]): r["text"] for r in got} == want


def test_long_sources_go_another_way_with_the_same_chunks(spark):
    rows = [(s, i, " ".join(f"{s}{i}.{j}" for j in range(97))) for s, n in (("a", 400), ("b", 5), (None, 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, ord long, text string")
    near, far = (sorted(map(tuple, chunk_pack(frame, "c", long=n).collect()), key=str) for n in (1 << 30, 20_000))
    assert near == far and len(near) > 100


def test_pseudonyms_are_keyed_digests(spark):
    import hashlib
    import hmac

    for key in (b"short", b"k" * 64, b"longer than a block" * 9):
        ref = D.pseudonym(key, "user")
        got = {r["v"]: r["r"] for r in spark.createDataFrame([("",), ("Zoë",), ("x" * 300,), (None,)], "v string").select("v", ref(F.col("v")).alias("r")).collect()}
        assert got.pop(None) is None
        assert got == {v: hmac.new(key, f"user:{v}".encode(), hashlib.sha256).hexdigest()[:16] for v in got}
