"""What a majority of n drawn answers is worth: the exact mean and deviation, from vote counts alone."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache(1 << 12)
def winning_chances(counts: tuple[int, ...], n: int) -> tuple[float, ...]:
    """For votes of ``counts`` answers, how likely each wins ``n`` draws with replacement.

    The winner is the vote drawn most often, of several the one drawn first; votes drawn equally
    often are alike to be first. For each height m a table runs over the votes: how many draws are
    used, how many votes stand at m (the others below), with the chance of it, and how many votes
    of each count are among those at m. Draws are taken as independent counts of Poisson's law,
    held to n in all at the end.
    """
    kinds, kind = np.unique(counts, return_inverse=True)
    rate = n * np.array(counts, float) / sum(counts)
    drawn = np.arange(n + 1)
    factorials = np.concatenate(([0.0], np.cumsum(np.log(np.maximum(drawn[1:], 1)))))
    chance = np.exp(-rate[:, None] + drawn * np.log(rate)[:, None] - factorials)
    gap = drawn[None, :] - drawn[:, None]
    found = np.zeros(len(kinds))
    for m in range(1, n + 1):
        table = np.zeros((1 + len(kinds), n // m + 1, n + 1))
        table[0, 0, 0] = 1
        for c, k in zip(chance, kind):
            at = table.copy()
            at[1 + k] += table[0]
            table = table @ np.where((gap >= 0) & (gap < m), c[np.clip(gap, 0, n)], 0.0)
            table[:, 1:, m:] += c[m] * at[:, :-1, : n + 1 - m]
        found += (table[1:, 1:, n] / np.arange(1, n // m + 1)).sum(axis=1)
    each = found / np.bincount(kind) / math.exp(-n + n * math.log(n) - factorials[n])
    return tuple(each[kind].tolist())


def majority_moments(counts: list[int], means: list[float], squares: list[float], n: int) -> tuple[float, float]:
    """Mean and deviation of the majority's value in ``n`` draws: that of the winner's first answer drawn, any of the vote's answers alike.

    Votes have ``counts`` answers, in ascending order, whose values have ``means`` and mean ``squares``.
    """
    chances = winning_chances(tuple(int(c) for c in counts), n)
    mean, square = (sum(p * v for p, v in zip(chances, values)) for values in (means, squares))
    return float(mean), math.sqrt(max(float(square) - float(mean) ** 2, 0.0))


def majority_expected(df: DataFrame, group: list[str], value: str, vote: str, sizes: list[int] | None = None) -> DataFrame:
    """``group, k, maj_mean, maj_std`` for each of ``sizes``, or for k = 2, 4, 8, ... below each group's answers, and their number.

    Answers are counted by vote before they meet, so a group arrives as one cell for each of its votes.
    A null vote is a vote of its own; rows of null value take no part. A group costs the cube of k for each vote.
    """

    @F.pandas_udf("array<struct<k:long,maj_mean:double,maj_std:double>>")
    def moments(cells: pd.Series) -> pd.Series:
        out = []
        for votes in cells:
            counts, means, squares = ([v[key] for v in votes] for key in ("c", "mean", "square"))
            answers = int(sum(counts))
            ks = sizes or [2**e for e in range(1, 21) if 2**e < answers] + [answers] * (answers > 1)
            out.append([(k, *majority_moments(counts, means, squares, k)) for k in ks])
        return pd.Series(out)

    v = F.col(value).cast("double")
    votes = df.where(v.isNotNull()).groupBy(*group, vote).agg(F.count("*").alias("c"), F.avg(v).alias("mean"), F.avg(v * v).alias("square"))
    cells = votes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("c", "mean", "square"))).alias("_cells"))
    return cells.select(*group, F.inline(moments("_cells")))
