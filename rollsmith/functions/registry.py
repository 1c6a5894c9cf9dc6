"""Extension points: scorers, losses and sources by name, and scorers in Python that cannot break a job."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    """Functions by name. A name taken by another function raises; an unknown name names the known ones."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str, function: Callable | None = None) -> Callable:
        if function is None:
            return partial(self.register, name)
        if self.known.get(name, function) is not function:
            raise ValueError(f"{self.kind} {name} is registered already")
        self.known[name] = function
        return function

    def get(self, name: str, **bound) -> Callable:
        if name not in self.known:
            raise ValueError(f"unknown {self.kind} {name}; known: {', '.join(sorted(self.known))}")
        return partial(self.known[name], **bound) if bound else self.known[name]


SCORERS, LOSSES, SOURCES = Registry("scorer"), Registry("loss"), Registry("source")


def guarded(score: Callable[[str, str], float | dict], fields: dict[str, str] | None = None, failed: float = 0.0) -> Callable[[Column, Column], Column]:
    """A Python scorer of one answer as a column builder, in Arrow batches; what it raises scores ``failed``.

    With ``fields`` it returns a dict and the column is a struct of them (the first is the score).
    """
    shape = ", ".join(f"{n} {k}" for n, k in fields.items()) if fields else "double"

    def one(solution: str, truth: str):
        try:
            return score(solution, truth)
        except Exception:
            return {next(iter(fields)): failed} if fields else failed

    if fields:

        @F.pandas_udf(shape)
        def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=list(fields))
    else:

        @F.pandas_udf(shape)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([float(one(x, y)) for x, y in zip(a, b)], dtype="float64")

    return run


def batched(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A Python scorer of many answers at once as a column builder."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(a.tolist(), b.tolist()), dtype="float64")

    return run
