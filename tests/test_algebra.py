"""Answers compared as formulas."""

import random
from fractions import Fraction

import pytest

from rillflow.functions import algebra
from rillflow.functions import mathtext as mt

SAME = (
    ("x^2-1", "(x-1)(x+1)"), ("0.5", "1/2"), ("\\frac{\\sqrt{2}}{2}", "1/\\sqrt{2}"), ("(1, 2]", "(1,2]"), ("[1,0.5]", "[1,1/2]"), ("7 3/4", "31/4"), ("7\\frac{3}{4}", "7 3/4"), ("1,234", "1234"), ("12 meters", "12"),
    ("5 million", "5*10^6"), ("$5$", "5.0"), ("YES", "yes"), ("\\text{Yes}", "yes"), ("(x+y)^2", "x^2+2xy+y^2"), ("30^\\circ", "30"), ("3(x+1)", "3x+3"), ("-  5", "-5"), ("{7}", "7"), ("3 and 4", "3 , 4"),
    ("x+y+z", "z+y+x"), ("\\frac12", "0.5"), ("\\dfrac{1}{2}", "\\frac{1}{2}"), ("\\sqrt{12}", "2\\sqrt3"), ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}"), ("\\frac{1}{1+\\sqrt2}", "\\sqrt{2}-1"), ("\\sqrt[3]{16}", "2\\sqrt[3]{2}"),
    ("2\\pi r", "2*r*pi"), ("\\frac{x^2-1}{x-1}", "x+1"), ("x = 5", "5"), ("\\frac{a}{b}+\\frac{b}{a}", "\\frac{a^2+b^2}{ab}"), ("2^{n+1}", "2*2^n"), ("4^n", "2^{2n}"), ("x^{n+2}", "x^2 x^n"), ("\\sin(x+x)", "\\sin 2x"),
    ("\\sin^2 x", "(\\sin x)^2"), ("3 \\pm \\sqrt{8}", "3\\pm2\\sqrt{2}"), ("(-\\infty, 2) \\cup (3, \\infty)", "(-\\infty,2)\\cup(3,\\infty)"), ("\\{1, 2\\}", "\\{2,1\\}"), ("x < 5", "5 > x"), ("y+1 = 2x", "2x=1+y"),
    ("\\begin{pmatrix} 1 \\\\ 2/4 \\end{pmatrix}", "\\begin{pmatrix}1\\\\0.5\\end{pmatrix}"), ("\\sqrt{-4}", "2\\sqrt{-1}"), ("\\frac{\\sqrt{x+1}}{x+1}", "\\frac{1}{\\sqrt{x+1}}"), ("\\sqrt{4x+4}", "2\\sqrt{1+x}"), ("x_1+x_2", "x_2+x_1"),
    ("10{,}000", "10000"), ("1,\\!234", "1234"), ("5!x", "x*5!"), ("x^{1/2}", "\\sqrt{x}"), ("12 cm", "12"), ("50\\%", "50"), ("|x|+1", "1+|x|"), ("-2\\frac{1}{2}", "-2.5"),
)
OTHER = (
    ("2/4", "1/2"), ("4/2", "2"), ("(1,2)", "[1,2]"), ("1,2", "12"), ("(1,2)", "(1,2,3)"), ("sqrt(x^2)", "x"), ("0.333", "1/3"), (None, "1"), ("1", None), ("", "1"), ("9^9^9", "9^9^8"), ("(" * 3000, "1"),
    ("1/0", "2/0"), ("\\frac{1}{2", "1/2"), ("2^{3}", "8"), ("x", "y"), ("9" * 6000 + "x", "x"), ("x<5", "x>5"), ("x\\le5", "x<5"), ("\\sqrt{x+1}", "\\sqrt{x}+1"), ("\\{1,2\\}", "\\{1,1\\}"), ("\\sin x", "\\cos x"),
    ("(1,2)", "(2,1)"), ("monday", "sunday"), ("3\\pm2", "5"), ("2^n", "2n"), ("\\sqrt{2}", "1.41421356"), ("(x+1)^{3000}", "x"), ("1-" * 2000, "1"), ("7 3", "10"), ("x_1", "x_2"),
)


@pytest.mark.parametrize(("given", "truth"), SAME)
def test_equal_answers(given, truth):
    assert algebra.graded_equal(given, truth) and algebra.graded_equal(truth, given)


@pytest.mark.parametrize(("given", "truth"), OTHER)
def test_other_answers(given, truth):
    assert not algebra.graded_equal(given, truth) and not algebra.graded_equal(truth, given)


@pytest.mark.parametrize(("given", "truth"), [("2/4", "1/2"), ("4/2", "2"), ("2^{3}", "8"), ("(2/4, 1)", "(1/2,1)")])
def test_lenient_answers(given, truth):
    assert not algebra.graded_equal(given, truth) and algebra.graded_equal(given, truth, lenient=True)


def made(rng, depth):
    """A random formula as text, and the function of x and y that it is."""
    if not depth:
        n = rng.randint(1, 9)
        return rng.choice([(str(n), lambda x, y: Fraction(n)), ("x", lambda x, y: x), ("y", lambda x, y: y)])
    (a, f), (b, g) = made(rng, depth - 1), made(rng, depth - 1)
    k = rng.randint(0, 3)
    return rng.choice([
        (f"({a}+{b})", lambda x, y: f(x, y) + g(x, y)), (f"({a}) - ({b})", lambda x, y: f(x, y) - g(x, y)), (f"({a})({b})", lambda x, y: f(x, y) * g(x, y)), (f"\\frac{{{a}}}{{{b}}}", lambda x, y: f(x, y) / g(x, y)),
        (f"({a})^{k}", lambda x, y: f(x, y) ** k), (f"({a})^{{-{k}}}", lambda x, y: f(x, y) ** -k),
    ])


def test_random_formulas_against_their_values():
    """Brute force: formulas are equal if and only if they agree on a grid too large for their degrees."""
    rng, grid = random.Random(3), [(Fraction(p, 7), Fraction(q, 11)) for p in range(-9, 10, 2) for q in range(-12, 13, 3)]
    seen = [0, 0]
    while min(seen) < 60:
        (a, f), (b, g) = made(rng, 2), made(rng, 2)
        if rng.random() < 0.5:
            # The first one again, by way of the second.
            b, g = f"\\frac{{({a})({b}) + ({a})}}{{({b}) + 1}}", lambda x, y, f=f, g=g: (f(x, y) * g(x, y) + f(x, y)) / (g(x, y) + 1)
        try:
            want = all(f(x, y) == g(x, y) for x, y in grid)
        except ZeroDivisionError:
            continue
        assert algebra.same_value(a, b) == want, (a, b)
        seen[want] += 1


def test_radicals_against_floats():
    rng = random.Random(8)
    for _ in range(200):
        a, b, c = (rng.randint(1, 60) for _ in range(3))
        left, right = f"\\frac{{{a}}}{{\\sqrt{{{b}}}+\\sqrt{{{c}}}}}", f"\\frac{{{a}(\\sqrt{{{b}}}-\\sqrt{{{c}}})}}{{{b - c}}}"
        assert algebra.same_value(left, right) == (b != c), (left, right)


def test_golds_boxes_and_tags():
    assert algebra.boxed_reward("so \\boxed{\\frac{2}{4}}", ["7", "\\boxed{1/2}"]) == {"formatted": True, "correct": True}
    assert algebra.boxed_reward("so \\boxed{3}", ["7", None]) == {"formatted": True, "correct": False}
    assert algebra.boxed_reward("so 7", ["7"]) == algebra.boxed_reward(None, ["7"]) == {"formatted": False, "correct": False}
    assert algebra.boxed_reward("\\boxed{7}", None) == {"formatted": True, "correct": False}
    assert algebra.tagged_reward("<think>x</think> <answer> 7 </answer>", ["7"]) == {"formatted": True, "correct": True}
    assert algebra.tagged_reward("<think>x</think> <answer>\\boxed{8}</answer>", ["8"]) == {"formatted": True, "correct": True}
    assert algebra.tagged_reward("<think>x</think><answer>7</answer>", ["7"]) == {"formatted": False, "correct": False}
    assert algebra.tagged_reward("<think>x</think> <answer>\\boxed{8</answer>", ["8"]) == {"formatted": True, "correct": False}


def test_commas_of_lists_are_no_thousands():
    assert mt.equal_answers("1,234", "1234") and not mt.equal_answers("1,2", "12")


def test_powers_beyond_what_a_coefficient_holds():
    n = 16_407
    same = (
        (f"2^{{{n}}}x", f"4^{{{n}/2}}x"), ("2^{300001}x", "4^{300001/2}x"), ("6^{40000}", "2^{40000}*3^{40000}"), ("2^{40000}+2^{40000}", "2^{40001}"), ("6*2^{40000}", "3*2^{40001}"), ("2^{40000}/2^{39999}", "2"), ("(2^{1000})^{20}", "2^{20000}"),
        ("\\sqrt{2^{80000}}", "2^{40000}"), ("2^{-32768}*2", "2^{-32767}"), ("(2^{40000}+x)^2", "2^{80000}+2^{40001}x+x^2"), ("x^{70000}", "x*x^{69999}"), ("(-2)^{40001}", "-2^{40001}"), ("2^{10^{400}}x", "x*2^{10^{400}}"),
    )
    for given, truth in same:
        assert algebra.graded_equal(given, truth, lenient=True) and algebra.graded_equal(truth, given, lenient=True), (given, truth)
    for given, truth in (("2^{40000}", "2^{40001}"), ("2^{40000}x", "2^{40000}y"), ("(-2)^{40000}", "-2^{40000}"), (f"2^{{{n}}}", f"4^{{{n + 1}/2}}"), ("(10^{400}+7)^{2000}", "1")):
        assert not algebra.graded_equal(given, truth, lenient=True), (given, truth)
