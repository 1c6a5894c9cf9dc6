"""Rule-based scorers of answers: column expressions, and the router that picks one by data source."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollsmith.functions import text as X
from rollsmith.functions.tokens import let

Score = Callable[[Column, Column], Column]


def _points(extracted: Column, right: Column, score: float, format_score: float) -> Column:
    return F.when(extracted.isNull(), 0.0).when(right, score).otherwise(format_score)


def hash_answer(solution: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = X.last_hash_answer(solution) if method == "strict" else X.last_number(solution)
    return _points(answer, answer == truth, score, format_score)


def boxed_math(solution: Column, truth: Column) -> Column:
    answer = X.last_boxed(solution)
    return F.when(F.coalesce(X.latex_form(answer) == X.latex_form(truth), F.lit(False)), 1.0).otherwise(0.0)


def strict_box(solution: Column, truth: Column) -> Column:
    """1 if the box near the end holds exactly the truth, else -1."""
    return F.when(F.coalesce(X.last_boxed(F.right(solution, F.lit(100))) == truth, F.lit(False)), 1.0).otherwise(-1.0)


def named_answer(solution: Column, truth: Column) -> Column:
    """1 if the last line that names an answer says the truth after reduction, else -1."""
    found = F.regexp_extract_all(F.right(solution, F.lit(300)), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    said = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))
    return F.when(X.final_answer(said) == X.final_answer(truth), 1.0).otherwise(-1.0)


def exact_match(solution: Column, golds: Column, score: float = 1.0, format_score: float = 0.0, most_tags: int = 10) -> Column:
    """Equal to any gold after normalisation; an answer full of tags earns a quarter."""
    answer = X.last_tagged(solution)
    right = let(X.normalized_answer(answer), lambda said: F.exists(golds, lambda g: X.normalized_answer(g) == said))
    crowded = (X.count_of(solution, "<answer>") > most_tags) | (X.count_of(solution, "</answer>") > most_tags)
    return F.when(answer.isNull(), 0.0).when(right & crowded, score / 4).when(right, score).otherwise(format_score)


def contains_match(solution: Column, golds: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    answer = X.last_tagged(solution)
    return _points(answer, let(X.normalized_answer(answer), lambda said: F.exists(golds, lambda g: F.contains(said, X.normalized_answer(g)))), score, format_score)


def thought_format(solution: Column) -> Column:
    return F.when(solution.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def geometry(solution: Column, truth: Column, format_score: float = 0.1) -> Column:
    return (1 - format_score) * boxed_math(solution, truth) + format_score * thought_format(solution)


def _elements(answer: Column) -> Column:
    inner = F.when(answer.rlike(r"^[\[(].*[\])]$"), F.substring(answer, F.lit(2), F.length(answer) - 2)).otherwise(answer)
    return F.when(F.contains(inner, F.lit(",")) & (inner != answer), F.transform(F.split(inner, ","), lambda e: F.trim(e))).otherwise(F.array(answer))


def graded_math(solution: Column, truth: Column) -> Column:
    """Equal in form, or equal tuples: brackets alike, whole numbers strictly, other elements by value.

    Symbolic equality needs an optional library; without it elements compare as numbers or text.
    """
    given, wanted = X.latex_form(solution), X.latex_form(truth)
    a, b = _elements(given), _elements(wanted)
    whole, fraction = r"^-?\d+$", r"^-?\d+/-?\d+$|^-?\\frac\{-?\d+\}\{-?\d+\}$"
    value = lambda e: F.try_divide(F.regexp_extract(e, r"frac\{(-?\d+)\}", 1).try_cast("double"), F.regexp_extract(e, r"\}\{(-?\d+)\}", 1).try_cast("double"))
    number = lambda e: F.coalesce(F.replace(e, F.lit(","), F.lit("")).try_cast("double"), value(e))
    one = lambda g, w: F.when(g.rlike(fraction) & w.rlike(fraction), g == w).when(g.rlike(whole) != w.rlike(whole), F.lit(False)).otherwise((g == w) | F.coalesce(F.abs(number(g) - number(w)) < 1e-9, F.lit(False)))
    ends = (F.size(b) <= 1) | ((F.left(given, F.lit(1)) == F.left(wanted, F.lit(1))) & (F.right(given, F.lit(1)) == F.right(wanted, F.lit(1))))
    same = ends & (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, one), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(F.coalesce((given == wanted) | same, F.lit(False)), 1.0).otherwise(0.0)


def tests_passed(results: Column, continuous: bool = True, first: int = 10) -> Column:
    """Share of passed tests: of the first ones, or of all; no result counts as one failure."""
    taken = F.slice(results, 1, first) if continuous else results
    return F.size(F.filter(taken, lambda r: r)) / F.greatest(F.size(taken), F.lit(1))


def multiple_choice(solution: Column, truth: Column) -> Column:
    return F.when(F.coalesce(X.first_choice(solution) == truth, F.lit(False)), 1.0).otherwise(0.0)


def char_count(solution: Column, truth: Column) -> Column:
    return F.when(F.coalesce(X.last_boxed(solution) == truth, F.lit(False)), 1.0).otherwise(0.0)


def matching_reward(reward: Column, best: Column) -> Column:
    """Share of the best assignment's reward, within 0 and 1; a failed proposal earns 0."""
    return F.coalesce(F.least(F.greatest(reward / F.greatest(best, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def error_penalty(reward: Column, errors: Column, penalty: float) -> Column:
    return F.greatest(reward - errors * penalty, F.lit(0.0))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def assignment_score(table: Column, pairs: Column) -> Column:
    """Sum of a table's cells at pairs of row and column."""
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.get(F.get(table, p["row"]), p["col"]).cast("double"))


def best_assignment(values: np.ndarray) -> float:
    """Largest total of one cell from each row and column, by dynamic programming over sets of columns."""
    n = len(values)
    best = np.full(1 << n, -np.inf)
    best[0] = 0
    masks = np.arange(1 << n)
    rows = np.bitwise_count(masks)
    for row in range(n):
        mine = masks[rows == row]
        for column in range(n):  # a set grows by one column to one other set, so no two of ``wide`` are the same
            free = mine[mine >> column & 1 == 0]
            wide = free | 1 << column
            best[wide] = np.maximum(best[wide], best[free] + values[row][column])
    return float(best[-1])


def pooled_best(table: Column, known_a: Column, known_b: Column, unknown: float = 50.0) -> Column:
    """The best assignment if both players pool what they know; unknown cells count as the middle value."""

    @F.pandas_udf("double")
    def solve(tables: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(tables, first, second):
            t, a, b = (np.array([list(r) for r in x], dtype=float) for x in (t, a, b))
            out.append(best_assignment(np.where((a > 0) | (b > 0), t, unknown)))
        return pd.Series(out)

    return solve(table, known_a, known_b)


def library_verified(solution: Column, truth: Column, timeout_score: float = 0.0) -> Column:
    """An optional verifier library's verdict; an error scores 0, a timeout a given score, no library null."""

    @F.pandas_udf("double")
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        try:
            from math_verify import parse, verify as check
            from math_verify.errors import TimeoutException
        except ImportError:
            return pd.Series([None] * len(a), dtype="float64")

        def one(x: str, y: str) -> float:
            try:
                return float(check(parse(y), parse(x)))
            except TimeoutException:
                return timeout_score
            except Exception:
                return 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return verify(solution, truth)


def by_split(split: Column, rule: Column, model: Column, test: str = "test") -> Column:
    """Rule scores on the test split, a model's given scores elsewhere."""
    return F.when(split == test, rule).otherwise(model)


#: Which scorer serves which data source, by exact name or by prefix.
ROUTES: list[tuple[str, bool, Score]] = [
    ("openai/gsm8k", False, hash_answer), ("lighteval/MATH", False, boxed_math), ("DigitalLearningGmbH/MATH-lighteval", False, boxed_math), ("HuggingFaceH4/MATH-500", False, boxed_math),
    ("math_dapo", False, named_answer), ("aime", True, named_answer), ("numina_", True, graded_math), ("hiyouga/geometry3k", False, geometry),
]


def routed(source: Column, solution: Column, truth: Column, routes: list[tuple[str, bool, Score]] | None = None) -> Column:
    """The score by the source's scorer; an unknown source raises."""
    found = F.when(F.lit(False), F.lit(0.0))
    for name, prefix, score in routes or ROUTES:
        found = found.when(F.startswith(source, F.lit(name)) if prefix else source == name, score(solution, truth))
    return found.otherwise(F.raise_error(F.concat(F.lit("no scorer for data source "), F.coalesce(source, F.lit("null")))))
