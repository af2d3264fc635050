from collections import Counter
from fractions import Fraction

import pytest

from abacora.functions import answers as A
from abacora.functions import similarity as M


@pytest.mark.parametrize("options", [["1/2", "0.5", "3/4", "1"], ["50%", "0.5", "25%", "0.1"]])
def test_two_equal_options_have_no_letter(options):
    assert A.letter_of(options[0], options) is None


def test_equal_sets_have_no_letter():
    assert A.letter_of("{1,2}", ["{1,2}", "{2,1}", "{3}", "{4}"]) is None
    assert A.letter_of("0.25", ["1/4", "1/2", "3/4", "1"]) == "A"


def test_units_are_told_apart():
    assert not A.same("5 cm", "5 m")
    assert A.same("A) 5.0cm", "5 cm") and not A.same("", "")


def test_keys():
    assert A.key_of("\\frac{1}{2}") == A.key_of("$0.5$") == A.key_of("(b) 50 %") == "1/2|"
    assert A.key_of("{2, 1}") == A.key_of("{1.0,2}") == "{1,2}" and A.key_of("∅") == A.key_of("{ }")
    assert A.key_of("1/0") == "1/0" and A.key_of("{1/0}") == "{1/0}" and A.key_of("{5 cm}") == "{5cm}" and A.key_of(None) is None
    assert A.key_of("-1/2") == "-1/2|" and A.key_of("two") == "two"


@pytest.mark.parametrize(
    "stem, value",
    [
        ("Calculate 0.1 + 0.2?", Fraction(3, 10)), ("Evaluate (2 + 3)^2?", 25), ("What is -2^2", -4), ("compute 2^3^2", 512), ("Calculate 7 - 3 - 2.", 2), ("Calculate 8 ÷ 4 × 3", 6),
        ("Calculate 1/0", None), ("Calculate 2^13", None), ("Define a set", None), ("Calculate (1 + 2", None), ("Calculate 9999999^2", None), ("Calculate " + "+".join(["1"] * 30), None), ("Calculate " + "+".join(["1"] * 21), 21),
    ],
)
def test_arithmetic(stem, value):
    assert A.arithmetic(stem) == value


def test_sets():
    stem = "A = {1,2}, B = {2,3}. Find A ∩ B?"
    assert A.set_question(stem) == frozenset({"2"})
    assert A.set_question("A = {1,2}, B = {2,3}, C = {2}. Find A ∪ B ∩ C?") == frozenset({"1", "2"})
    assert A.set_question("A = {1,2,3}, B = {2}, C = {3}. Determine A \\ B \\ C.") == frozenset({"1"})
    assert A.set_question("Find A ∪ D?") is None


def test_letters_are_remapped():
    to = {"A": "D", "B": "C", "C": "B", "D": "A"}
    assert A.remap_letters("Options A, B, and D are distractors.", to) == "Options D, C, and A are distractors."
    assert A.remap_letters("The correct answer is B.", to) == "The correct answer is C."
    assert A.remap_letters("Options (A)/B fail, the third option holds; D would be correct, a B is not.", to) == "Options (D)/C fail, the option B holds; A would be correct, a B is not."
    assert A.claimed_letters("Option A correctly says so") == {"A"} and A.claimed_letters("the second option is correct") == {"B"}
    assert A.claimed_letters("Options A and B are wrong") == set()


def test_similarity():
    assert M.too_similar("Find the sum of 2 and 3.", "Find the sum of 2 and 3.")
    assert not M.too_similar("A bag has 3 red and 7 blue balls", "A bag has 4 red and 6 blue balls")
    assert not M.too_similar("Find A ∩ B for the two given sets", "Find A ∪ B for the two given sets")
    assert M.too_similar("A box is 5 cm by 3 cm. What is its area?", "A box is 5.0 cm by 3.0 cm. What is its area?")
    assert M.too_similar("Question 1: Define the empty set.", "Question 2: Define the empty set.")


def test_fold_keeps_first():
    stems = [("a", "Define a set."), ("b", "define a SET."), ("a", ""), ("a", ""), ("b", "State the rule of signs")]
    assert M.keep_first(stems) == [0, 2, 3, 4]


def test_positions_are_balanced(spark, sf_dir):
    from abacora.plans.catalog import QUERIES

    rows = QUERIES["batch_slices"](spark, sf_dir).collect()
    by_topic = {}
    for r in rows:
        by_topic.setdefault(r["topic_id"], Counter())[r["position"]] += 1
    assert all(max(c.values()) - min(c[p] for p in range(4) if c[p] or sum(c.values()) >= 4) <= 1 for c in by_topic.values())
