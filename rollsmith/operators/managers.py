"""Reward managers by name: how a table of answers gets its column ``score``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsmith.functions import scorers
from rollsmith.functions.registry import Registry, batched, guarded

MANAGERS = Registry("reward manager")


@MANAGERS.register("naive")
def naive(df: DataFrame, *, source: str, solution: str, truth: str, routes: list | None = None) -> DataFrame:
    """Each answer by the scorer of its data source."""
    return df.withColumn("score", scorers.routed(F.col(source), F.col(solution), F.col(truth), routes))


@MANAGERS.register("batch")
def batch(df: DataFrame, *, solution: str, truth: str, score: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """Many answers at once by one Python scorer."""
    return df.withColumn("score", batched(score)(F.col(solution), F.col(truth)))


@MANAGERS.register("prime")
def parallel(df: DataFrame, *, solution: str, truth: str, score: Callable[[str, str], float]) -> DataFrame:
    """Each answer by a Python scorer; what it raises scores 0."""
    return df.withColumn("score", guarded(score)(F.col(solution), F.col(truth)))


@MANAGERS.register("dapo")
def overlong(df: DataFrame, *, score: Column, length: str, most: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """A score less a penalty that grows over the last ``buffer`` tokens before ``most``."""
    return df.withColumn("score", score + scorers.overlong_penalty(F.col(length), most, buffer, factor))


def managed(name: str, df: DataFrame, **options) -> DataFrame:
    """Run the manager registered under ``name``."""
    return MANAGERS.get(name)(df, **options)
