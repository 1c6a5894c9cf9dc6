"""Formulas, answers and LaTeX forms against a table of pairs."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollsmith.functions.algebra import Unreadable, read, same_formula
from rollsmith.functions.answers import announced, same_answer, symbolic_math
from rollsmith.functions.latex import nested_form, nested_latex, tree, written

PAIRS = [
    ("2(x+1)", "2x+2", True), (r"\sqrt{8}", r"2\sqrt2", True), (r"\frac{1}{\sqrt2}", r"\frac{\sqrt{2}}{2}", True), ("(x+y)^2", "x^2+2xy+y^2", True), ("(x+y)^2", "x^2+y^2", False),
    (r"3\frac12", "3.5", True), ("7 3/4", "31/4", True), ("7 3/4", "7", False), (r"\frac{x^2-1}{x-1}", "x+1", True), ("2^{10}", "1024", True), (r"\sqrt[3]{16}", r"2\sqrt[3]{2}", True), (r"\sqrt[3]{-8}", "-2", True),
    (r"\sqrt{3+2\sqrt2}", r"1+\sqrt2", True), (r"\sqrt{4x}", r"2\sqrt{x}", True), ("x^{1/2}", r"\sqrt{x}", True), (r"\sin^2 x+\cos^2 x", "1", True), (r"\sin x", r"\cos x", False), ("2^{x+1}", "2*2^x", True),
    (r"\pi", "3.14", True), (r"2\pi", "6.2832", True), (r"2\pi", "6.5", False), ("5!", "120", True), ("i^2", "-1", True), (r"|-3|", "3", True), (r"\frac{1+\sqrt5}{2}", "1.618034", True),
    ("1,000", "1000", True), ("12,345", "12,445", False), ("25%", "0.25", True), (r"25\%", "25", True), ("0.5", r"\frac12", True), ("0.5", "50", True), ("4.0", "4", True), ("4.1", "4", False), ("2/4", "1/2", True), ("$5", "5", True),
    ("[1,2]", "[1,2]", True), ("[1,2)", "[1,2]", False), ("(1,2)", "(2,1)", False), ("(0.5, 2x)", r"(\frac12, x+x)", True), ("Interval(1, 2)", "[1,2]", True), ("Interval.open(1, 2)", "(1,2)", True), ("Interval.Ropen(1, 2)", "(1,2)", False), ("Point(1, 2)", "(1,2)", True),
    ("1,2,3", "1, 2, 3", True), ("1,2", "1,2,3", False), ("x = 5", "5", True), (r"k=\frac12", r"\frac{1}{2}", True), (r"10\text{ cm}", "10", True), ("10 meters", "10", True), (r"90^\circ", "90", True), (r"\$12", "12", True), ("3 million", "3000000", True), ("Yes", "yes", True), ("yes", "no", False),
    (r"\text{east}", "east", True), (r"\dfrac{3}{4}", r"\frac{3}{4}", True), (r"\left(1,2\right)", "(1,2)", True), (r"\begin{pmatrix}1&2\\3&x+x\end{pmatrix}", "[[1,2],[3,2x]]", True), (r"\begin{pmatrix}1&2\\3&4\end{pmatrix}", "[[1,2],[3,5]]", False), ("", "5", False), ("5", "", False), ("(((", "5", False), ("1/0", "5", False),
    (r"\frac{2}{3}x", "2x/3", True), ("x(x-1)(x+1)", "x^3-x", True), (r"\log(x)", r"\ln x", True), ("a+b", "b+a", True), ("x", "y", False), (r"\infty", "inf", True), (r"(-\infty, 3)", "(-inf,3)", True),
]


@pytest.mark.parametrize("given_, truth, want", PAIRS)
def test_pairs(given_, truth, want):
    assert same_answer(given_, truth) is want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=4), st.lists(st.integers(-9, 9), min_size=1, max_size=4))
def test_products_of_polynomials(a, b):
    shown = lambda p: "+".join(f"({c})x^{{{i}}}" for i, c in enumerate(p))
    product = [sum(a[i] * b[k - i] for i in range(len(a)) if 0 <= k - i < len(b)) for k in range(len(a) + len(b) - 1)]
    assert same_formula(f"({shown(a)})({shown(b)})", shown(product))
    product[0] += 1
    assert not same_formula(f"({shown(a)})({shown(b)})", shown(product))


def test_sums_of_roots():
    random.seed(2)
    for _ in range(40):
        n, k = random.randint(2, 500), random.randint(1, 9)
        assert same_formula(rf"\sqrt{{{n * k * k}}}+1", rf"1+{k}\sqrt{{{n}}}") and (math.isqrt(n) ** 2 == n or not same_formula(rf"\sqrt{{{n}}}", rf"\sqrt{{{n + 1}}}"))


@pytest.mark.parametrize("text", ["", "2+", "(1", "1)", "\\frac{1}", "x" * 2000, "(" * 900 + "1" + ")" * 900, "\\sqrt[0]{2}", "#"])
def test_what_is_not_a_formula(text):
    with pytest.raises(Unreadable):
        read(text)
    assert not same_formula(text, "1")


def test_large_formulas_end():
    assert not same_formula("(a+b+c+d)^{40}", "1") and not same_formula("9^{9^{9^{9}}}", "1") and not same_formula("1000!", "1")


@pytest.mark.parametrize("text, want", [
    (r"\frac{\frac12}{3}", r"\frac{\frac{1}{2}}{3}"), (r"\sqrt[3]{2}", r"\sqrt[3]{2}"), (r"\sqrt[3]2", r"\sqrt[3]{2}"), (r"\frac12", r"\frac{1}{2}"), (r"\text{abc}", "abc"), (r"\frac\pi2", r"\frac{\pi}{2}"), (r"\sqrt 3", r"\sqrt{3}"),
    (r"x = \dfrac{\sqrt2}{\frac34}", r"\frac{\sqrt{2}}{\frac{3}{4}}"), ("3/4", r"\frac{3}{4}"), ("-3/4", r"\frac{-3}{4}"), ("03/4", "03/4"), ("0.5", r"\frac{1}{2}"), (".5", r"\frac{1}{2}"), (r"10\text{ cm}", "10"), (r"1\text{ a}\text{ b}", r"1\text{ a}\text{ b}"),
    (r"\frac\frac123", r"\frac{\frac{1}{2}}{3}"), (r"{\text{a}}", r"{\text{a}}"), (r"\left( \tfrac12, 3\right)", r"(\frac{1}{2},3)"), ("{{", "{{"), ("}", "}"), ("", ""), (r"\frac1", r"\frac1"), (r"\sqrt", r"\sqrt"), (r"50\%", "50"), (r"2^{\frac12}", r"2^{\frac{1}{2}}"), (r"\text{a}\text{b}", r"\text{a}\text{b}"),
])
def test_nested_forms(text, want):
    assert nested_form(text) == want and nested_form(want) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="{}\\ab1 []", max_size=30))
def test_trees_are_written_back(text):
    assert written(tree(text)) == text and isinstance(nested_form(text), str)


def test_deep_groups():
    deep = "{" * 20000 + "\\frac12" + "}" * 20000
    assert nested_form(deep) == "{" * 20000 + "\\frac{1}{2}" + "}" * 20000


@pytest.mark.parametrize("text, want", [
    ("so the answer is 5", (True, "5")), ("Answer: 12", (True, "12")), (r"thus \boxed{x+1}. Done", (True, "x+1")), ("we get y = 3", (True, "3")), ("no number here", (False, "no number here")), (r"\boxed{\frac{1}{2}}", (True, r"\frac{1}{2}")), ("7 is the answer", (True, "7")), ("", (False, "")),
])
def test_announced(text, want):
    assert announced(text) == want


def test_columns(spark):
    rows = [(r"Step 2: so \boxed{2(x+1)}", "2x+2"), ("the answer is 5", "6"), (None, "1"), ("1", None), ("5", "5.0")]
    got = spark.createDataFrame(rows, "s string, t string").select(symbolic_math("s", "t").alias("r"), nested_latex("s").alias("n")).select("r.*", "n").collect()
    assert [tuple(r)[:3] for r in got] == [(1.0, True, "2(x+1)"), (0.0, False, "5"), (0.0, False, None), (0.0, False, None), (1.0, False, "5")] and got[2]["n"] is None
