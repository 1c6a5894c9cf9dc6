"""Splits, samples and orders that only keys and seeds decide."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.operators.ranking import hash_ranked, indexed
from rollsmith.operators.windows import hashed_order

#: Copies that a piece of a row may expect in resampling.
PIECE = 16


def split_exact(df: DataFrame, fraction: float, key: list[str], seed: int = 42, rounding: str = "floor") -> DataFrame:
    """Tag rows ``train`` or ``val`` with an exact count, in an order fixed by seeded hash.

    ``floor``: int(n * fraction) rows train; ``ceil``: the rest is rounded up.
    """
    ranked, n = hash_ranked(df, hashed_order(key, seed), key)
    cut = math.floor(n * fraction + 1e-9) if rounding == "floor" else n - math.ceil(n * (1 - fraction) - 1e-9)
    return ranked.withColumn("split", F.when(F.col("_rank") < cut, "train").otherwise("val")).drop("_rank")


def split_three(df: DataFrame, fractions: tuple[float, float, float], key: list[str], seed: int = 42) -> DataFrame:
    """Tag rows train, val or test; the counts of the first two are rounded half to even."""
    if abs(sum(fractions) - 1) > 1e-6:
        raise ValueError("the fractions must add up to 1")
    ranked, n = hash_ranked(df, hashed_order(key, seed), key)
    a, b = (round(n * f) for f in fractions[:2])
    return ranked.withColumn("split", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < a + b, "val").otherwise("test")).drop("_rank")


def resample_weights(score: Column, method: str, power: float, top: Column, low: Column) -> Column:
    if method == "pow":
        weight = F.pow(F.abs(score), power)
    elif method == "max_min":
        weight = F.when((score == top) | (score == low), 1.0).otherwise(0.0)
    elif method == "max_random":
        weight = F.when(score == top, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method}")
    return F.greatest(weight + 1e-8, F.lit(1e-8))


def weighted(df: DataFrame, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """Add each row's probability of being drawn."""
    ends = df.agg(F.max(score).alias("_top"), F.min(score).alias("_low"))
    scored = df.crossJoin(F.broadcast(ends)).withColumn("weight", resample_weights(F.col(score), method, power, F.col("_top"), F.col("_low"))).drop("_top", "_low")
    total = scored.agg(F.sum("weight").alias("_sum"))
    return scored.crossJoin(F.broadcast(total)).withColumn("probability", F.col("weight") / F.col("_sum")).drop("_sum")


def _poisson(mean: Column, uniform: Column) -> Column:
    """The number whose share of a Poisson distribution a uniform number falls into (means of at most ``PIECE``)."""

    @F.pandas_udf("long")
    def draw(means: pd.Series, numbers: pd.Series) -> pd.Series:
        m, u = means.to_numpy(float), numbers.to_numpy(float)
        found, term = np.zeros(len(m), np.int64), np.exp(-m)
        total = term.copy()
        for k in range(1, 8 * PIECE):
            above = u >= total
            if not above.any():
                break
            found[above] = k
            term = term * m / k
            total += term
        return pd.Series(found)

    return draw(mean, uniform)


def resample(df: DataFrame, score: str, key: str, *, method: str = "pow", power: float = 2.0, seed: int = 42) -> DataFrame:
    """As many rows as there are, each drawn with replacement by weight, independently (seeded).

    Numbers of copies that are Poisson by weight are, given their sum, those of that many
    independent draws, and of these any fixed number chosen at random is again such a
    sample. So every row draws its own number, a little too high in all, and the draws of
    lowest hash stay: no draw is joined to a range, and no task sees all rows. A row that
    expects many copies draws in pieces. Rows that repeat a key and all else draw alike.
    """
    drawn = weighted(df, score, method, power)
    n = drawn.count()
    if not n:
        return drawn.withColumn("copy", F.lit(1).cast("long"))
    wanted = n + 8 * math.sqrt(n) + 16
    while True:
        mean = F.col("probability") * wanted
        pieces = drawn.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(mean / PIECE), F.lit(1)) - 1)))
        number = _poisson(mean / F.greatest(F.ceil(mean / PIECE), F.lit(1)), F.pmod(F.xxhash64(key, "_piece", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)))
        copies = pieces.withColumn("_copies", number).where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).drop("_copies")
        ranked, total = hash_ranked(copies, F.xxhash64(key, "_piece", "_copy", F.lit(seed + 1)), [key, "_piece", "_copy"])
        if total >= n:
            return ranked.where(F.col("_rank") < n).withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy("_piece", "_copy")).cast("long")).drop("_piece", "_copy", "_rank")
        wanted *= 1.1  # eight standard deviations below the mean: draw more


def sampler_order(df: DataFrame, kind: str, key: list[str], *, seed: int = 0, difficulty: str | None = None) -> DataFrame:
    """Add ``order_key``, by which a reader sorts: sequential, random (seeded) or curriculum."""
    if kind == "sequential":
        return df.withColumn("order_key", F.struct(*key))
    if kind == "random":
        return df.withColumn("order_key", F.struct(hashed_order(key, seed).alias("h"), *key))
    if kind == "curriculum":
        return df.withColumn("order_key", F.struct(F.col(difficulty).alias("difficulty"), *key))
    raise ValueError(f"unknown sampler {kind}")


def top_up(existing: DataFrame, more: DataFrame, target: int, order: list) -> DataFrame:
    """Existing rows, filled up from ``more`` to the target number, in an explicit order that no one task sorts."""
    lack = max(0, target - existing.count())
    return existing.unionByName(indexed(more, order, "_index").where(F.col("_index") < lack).drop("_index"))
