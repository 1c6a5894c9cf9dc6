"""Synthetic assignment games, generated in parallel from seeds.

A seed decides a game, wherever it is generated: tables, masks and scales come from a
generator of that seed. A game is drawn again until pooling knowledge is worth a quarter
more than either player's own (or after ``MOST_DRAWS`` draws).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from rollsmith.functions.scorers import best_assignment

MOST_DRAWS, TOP, SIZE, OBSERVED = 20, 100, 5, 0.4
SCHEMA = "game_id bigint, table array<array<double>>, mask1 array<array<int>>, mask2 array<array<int>>, scale1 double, scale2 double, best double, draws int"


def game(seed: int, size: int = SIZE, observed: float = OBSERVED) -> dict:
    rng = np.random.RandomState(seed % (1 << 32))
    for draw in range(1, MOST_DRAWS + 1):
        table = rng.randint(0, TOP + 1, (size, size)).astype(float)
        a, b = ((rng.random_sample((size, size)) < observed).astype(int) for _ in range(2))
        scales = rng.uniform(1, 10, 2)
        table[(a == 0) & (b == 0)] = TOP / 2
        value = lambda known: best_assignment(np.where(known > 0, table, TOP / 2))  # noqa: B023, E731
        best = value(a | b)
        if value(a) * 1.25 < best and value(b) * 1.25 < best:
            break
    return {"table": table.tolist(), "mask1": a.tolist(), "mask2": b.tolist(), "scale1": scales[0], "scale2": scales[1], "best": best, "draws": draw}


def games(spark: SparkSession, n: int, *, seed: int = 0, size: int = SIZE, observed: float = OBSERVED, group_size: int = 1) -> DataFrame:
    """``n`` games; those of a group share a seed and so a state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"game_id": int(i)} | game(seed + int(i) // group_size, size, observed) for i in frame["id"]])

    return spark.range(n).mapInPandas(run, SCHEMA)
