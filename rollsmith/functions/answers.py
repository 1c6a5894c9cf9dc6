"""Competition answers: found in a solution, and held against the truth by form, value or algebra."""

from __future__ import annotations

import functools
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollsmith.functions.algebra import TOLERANCE, same_formula
from rollsmith.functions.latex import nested_form

# What announces an answer before it, behind it, and within its sentence.
BEFORE = ["answer:", "answer is", "answers are"]
BEHIND = ["is answer", "is the answer", "are answers", "are the answers"]
WITHIN = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]
# Units that are dropped with their plural and power, large numbers, and kinds of intervals.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
LARGE = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
INTERVALS = [("Interval", "[", "]"), ("Interval.Ropen", "[", ")"), ("Interval.Lopen", "(", "]"), ("Interval.open", "(", ")")]

_UNIT = re.compile("|".join(f"{u}(?:es)?s? *(?:\\^[0-9]+)?" for u in UNITS))


def last_boxed(text: str) -> str | None:
    """What the last box holds, if its braces close."""
    at = max(text.rfind("\\boxed"), -1)
    at = at if at >= 0 else text.rfind("\\fbox")
    depth, start = 0, None
    for i in range(at, len(text)) if at >= 0 else ():
        if text[i] == "{":
            depth += 1
            start = i + 1 if start is None else start
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return text[start:i].strip() if start is not None else None
    return None


def announced(solution: str) -> tuple[bool, str]:
    """The answer that a solution announces, and whether it announces one that holds a digit."""
    found, answer = False, solution

    def cut(marks: list[str], tail: bool) -> None:
        nonlocal found, answer
        for mark in marks:
            at = answer.lower().rfind(mark)
            if at >= 0:
                found = True
                answer = (answer[at + len(mark) :] if tail else answer[:at]).strip()

    cut(BEFORE, True)
    cut(BEHIND, False)
    if box := last_boxed(answer):
        found, answer = True, box
    if ". " in answer:
        answer = answer[: answer.rfind(". ")].strip()
    cut(WITHIN, True)
    return found and any(c.isdigit() for c in answer), answer


def plain_form(answer: str) -> str:
    """An answer without signs of money, percents and units, in lower case."""
    if inner := re.fullmatch(r"\\text\{(.+)\}", answer, re.S):
        answer = inner[1]
    answer = answer.replace("\\%", "").replace("\\$", "").replace("$", "").replace("%", "").replace(" or ", " , ").replace(" and ", " , ")
    for name, factor in LARGE:
        answer = answer.replace(name, factor)
    answer = re.sub(r"\^ *\\circ", "", _UNIT.sub("", answer))
    if answer.startswith("{") and answer.endswith("}"):
        answer = answer[1:-1]
    answer = re.sub(r",\\! *", "", answer)
    return re.sub("- *", "-", answer).strip().lower()


def _number(text: str) -> float | None:
    try:
        return float(text.replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def _pieces(text: str) -> list[str]:
    """Parts between commas that stand in no bracket of the text; commas of thousands stay."""
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text) if text[:1] not in "([{" else text
    depth, out = 0, [""]
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth <= 0:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def _rows(matrix: str) -> list[list[str]] | None:
    """A matrix's cells: of LaTeX's environments, or of a list of rows."""
    if inner := re.search(r"\\begin\{[bp]?matrix\}(.*)\\end\{[bp]?matrix\}", matrix, re.S):
        return [[c.strip() for c in row.split("&")] for row in re.split(r"\\\\", inner[1]) if row.strip()]
    if inner := re.fullmatch(r"(?:Matrix\()?\[\s*\[(.*)\]\s*\]\)?", matrix, re.S):
        return [_pieces(row) for row in re.split(r"\]\s*,\s*\[", inner[1])]
    return None


def same_value(given: str, truth: str, *, percent: bool = True, tolerance: float = TOLERANCE) -> bool:
    """Equal as text, as numbers (also a hundred times, or a hundredth, of each other), part by part, or as formulas."""
    a, b = (re.sub(r"^(\d+(?:\.\d+)?)\\?%$", r"\1", re.sub(r"^\$(?=\d)", "", x.strip())) for x in (given, truth))
    if a.lower() == b.lower() or a.replace(" ", "") == b.replace(" ", ""):
        return True
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(math.isclose(v, x, rel_tol=tolerance) for v in ((y / 100, y, y * 100) if percent else (y,)))
    if not a or not b:
        return False
    for name, left, right in INTERVALS:
        if a.startswith(name + "(") and a.endswith(")"):
            a = left + a[len(name) + 1 : -1] + right
    if a.startswith("Point(") and b[0] == "(":
        a = a[5:]
    if (first := _rows(a)) is not None and (second := _rows(b)) is not None:
        return len(first) == len(second) and all(len(p) == len(q) and all(same_value(u, v, percent=percent, tolerance=tolerance) for u, v in zip(p, q)) for p, q in zip(first, second))
    # Brackets count only against brackets of another kind.
    bare = lambda t: t[1:-1] if t[:1] in "([" and t[-1:] in ")]" else t
    ends = a[0] in "([" and a[-1] in ")]", b[0] in "([" and b[-1] in ")]"
    p, q = _pieces(bare(a)), _pieces(bare(b))
    if len(p) > 1 or len(q) > 1:
        if all(ends) and (a[0], a[-1]) != (b[0], b[-1]):
            return False
        return len(p) == len(q) and all(same_value(u, v, percent=percent, tolerance=tolerance) for u, v in zip(p, q))
    return same_formula(a, b, tolerance)


@functools.lru_cache(1 << 14)
def same_answer(given: str, truth: str) -> bool:
    """Equal in one of their forms, or in value."""
    if nested_form(given) == nested_form(truth):
        return True
    a, b = plain_form(given), plain_form(truth)
    return a == b or bool(a) and (same_value(given, truth) or same_value(a, b))


RESULT = "score double, formatted boolean, answer string"


def symbolic_math(solution: Column, truth: Column) -> Column:
    """``score, formatted, answer`` of a solution against a true answer.

    1 where the announced answer (the whole solution, where none is announced) equals the truth in form, in
    value or as a formula. A null of either scores 0. The rows are graded one by one in Arrow batches.
    """

    @F.pandas_udf(RESULT)
    def grade(solutions: pd.Series, truths: pd.Series) -> pd.DataFrame:
        out = []
        for said, want in zip(solutions, truths):
            if said is None or want is None:
                out.append((0.0, False, None))
                continue
            _, answer = announced(said)
            out.append((float(same_answer(answer, want)), "Step 2:" in said and "\\box" in said, answer))
        return pd.DataFrame(out, columns=["score", "formatted", "answer"])

    return grade(solution, truth)
