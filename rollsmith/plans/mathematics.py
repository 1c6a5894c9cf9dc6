"""Queries of answers that are held against the truth by algebra, and of nested LaTeX forms.

The given tables hold no formulas, so they are put together from numbers of the events. A
shape is a text with terms in angle quotes, which both engines compute alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsmith.functions import scorers as R
from rollsmith.functions import text as X
from rollsmith.functions.answers import symbolic_math
from rollsmith.functions.latex import nested_latex
from rollsmith.plans.registry import Tables, query

_TERMS = {"a": "(event_id % 97 + 2)", "b": "(user_id % 50 + 3)"}


def _parts(shape: str) -> list[tuple[bool, str]]:
    """Stretches of a shape, and whether they are terms, in SQL."""
    parts = re.split("«(.*?)»", shape)
    return [(i % 2 == 1, re.sub(r"\b[ab]\b", lambda m: _TERMS[m[0]], p) if i % 2 else p) for i, p in enumerate(parts) if p]


def shaped(shape: str | None) -> Column:
    if shape is None:
        return F.lit(None).cast("string")
    return F.concat(*[F.expr(p).cast("string") if term else F.lit(p) for term, p in _parts(shape)] or [F.lit("")])


def shaped_sql(shape: str | None) -> str:
    if shape is None:
        return "NULL"
    return " || ".join(f"({p})::VARCHAR" if term else "'" + p.replace("'", "''") + "'" for term, p in _parts(shape)) or "''"


def _by_event(shapes: list[str | None]) -> Column:
    return F.element_at(F.array(*map(shaped, shapes)), (F.col("event_id") % len(shapes) + 1).cast("int"))


def _by_event_sql(cases: list[str]) -> str:
    return f"CASE event_id % {len(cases)} {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(cases))} END"


#: A solution, the truth, and when, in SQL, the one is right.
GRADED = [
    ("So the answer is 2(x+«a»)", "2x+«2*a»", "true"),
    ("\\boxed{\\sqrt{«2*a*a»}}", "«a»\\sqrt2", "true"),
    ("\\boxed{(x+«a»)^2}", "x^2+«2*a»x+«a*a + user_id % 2»", "user_id % 2 = 0"),
    ("Answer: \\frac{«2*a»}{«2*b»}", "«a»/«b»", "true"),
    ("\\boxed{[«a»,«a+b»)}", "[«a»,«a+b»]", "false"),
    ("\\boxed{«a»\\%}", "«100*a»", "true"),
    ("\\boxed{«a»\\frac{1}{2}}", "«2*a+1»/2", "true"),
    ("\\boxed{(«a», x+x)}", "(«a», 2x)", "true"),
    ("we get \\frac{x^2-«a*a»}{x-«a»}", "x+«a»", "true"),
    ("\\boxed{x(x+«a»)}", "x^2+«a»", "false"),
    ("\\boxed{«a»\\text{ cm}}", "«a + user_id % 3»", "user_id % 3 = 0"),
    ("\\boxed{\\begin{pmatrix}«a»&x\\\\«b»&1\\end{pmatrix}}", "[[«a»,x],[«b»,1]]", "true"),
    ("\\boxed{\\sin^2 x+\\cos^2 x+«a»}", "«a+1»", "true"),
    ("I don't know", "«a»", "false"),
    (None, "«a»", "false"),
    ("\\boxed{\\frac{«a»}{\\sqrt{«b»}}}", "\\frac{«a»\\sqrt{«b»}}{«b»}", "true"),
]


@query("r8_symbolic_math", f"SELECT event_id, ({_by_event_sql([right for *_, right in GRADED])})::INT::DOUBLE AS score FROM events")
def r8_symbolic(t: Tables) -> DataFrame:
    solution, truth = _by_event([s for s, *_ in GRADED]), _by_event([w for _, w, _ in GRADED])
    return t.events.select("event_id", symbolic_math(solution, truth)["score"].alias("score"))


#: An answer and its form.
NESTED = [
    ("\\frac{\\frac«a % 8 + 1»2}{«b»}", "\\frac{\\frac{«a % 8 + 1»}{2}}{«b»}"),
    ("\\sqrt[3]{«a»}+\\sqrt «b % 7 + 2»", "\\sqrt[3]{«a»}+\\sqrt{«b % 7 + 2»}"),
    ("x = \\dfrac{\\sqrt«a % 9»}{\\tfrac{«b»}7}", "\\frac{\\sqrt{«a % 9»}}{\\frac{«b»}{7}}"),
    ("\\text{ box «a» }", "box«a»"),
    ("\\left( «a», {\\text{b}}\\right)", "(«a»,{\\text{b}})"),
    ("«a»\\text{ cm}", "«a»"),
    ("«a»/«b»", "\\frac{«a»}{«b»}"),
    (".«a + 10»\\%", "0.«a + 10»"),
    ("2^{\\frac\\pi«a % 9»} ", "2^{\\frac{\\pi}{«a % 9»}}"),
    ("{{«a»}", "{{«a»}"),
    (None, None),
    ("«a»\\text{ a}\\text{ b}", "«a»\\text{ a}\\text{ b}"),
]


@query("x16_nested_form", f"SELECT event_id, {_by_event_sql([shaped_sql(w) for _, w in NESTED])} AS form FROM events")
def x16_nested(t: Tables) -> DataFrame:
    return t.events.select("event_id", nested_latex(_by_event([s for s, _ in NESTED])).alias("form"))


@query("r10_char_count", "SELECT event_id, coalesce(event_id % 4 = 1, false)::INT::DOUBLE AS score FROM events")
def r10_char_count(t: Tables) -> DataFrame:
    said = (F.length("event_type") + F.col("event_id") % 4 - 1).cast("string")
    boxed = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("there are "), said)).otherwise(F.concat(F.lit("\\boxed{0} no, \\boxed{"), said, F.lit("} letters")))
    return t.events.select("event_id", R.char_count(boxed, F.length("event_type").cast("string")).alias("score"))


_NEAR = "'A very GOOD start, then ' || repeat('x ', event_id % 60) || event_type || repeat(' y', user_id % 40) || ' which is the best and highest of all'"
_QUALIFIERS = ", ".join(f"'{q}'" for q in X.QUALIFIERS)


@query("x10_qualifiers_near", f"SELECT event_id, array_to_string(list_filter([{_QUALIFIERS}], lambda q: contains(near, q)), ' ') AS qualifiers FROM (SELECT event_id, lower(substr(s, greatest(p - 50, 0) + 1, p + length(event_type) + 50 - greatest(p - 50, 0))) AS near FROM (SELECT *, instr(s, event_type) - 1 AS p FROM (SELECT *, {_NEAR} AS s FROM events)))")
def x10_qualifiers(t: Tables) -> DataFrame:
    s = t.events.select("event_id", "event_type", F.expr(_NEAR).alias("s")).withColumn("p", F.expr("instr(s, event_type) - 1"))
    return s.select("event_id", F.array_join(X.qualifiers_near("s", F.col("p"), F.col("p") + F.length("event_type")), " ").alias("qualifiers"))
