"""The offline round: from rollouts to trained and held-out rows, and the round's record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.operators import filters as P
from rollsmith.operators.advantage import centred
from rollsmith.operators.losses import offline_kl
from rollsmith.operators.metrics import round_record
from rollsmith.operators.splits import split_exact


def process(
    rollouts: DataFrame, *, text: str, length: str, reward: str, game: str, key: list[str], marker: str, group_size: int = 8, kl: tuple[str, str, float] | None = None,
    kl_before_centering: bool = False, percentile: float | None = None, validation: float = 0.1, most: int = 5000, seed: int = 42,
) -> DataFrame:
    """Rows with ``weight`` and ``split``, after failures, over-long rows and weak weights are gone.

    Weights are rewards centred within a group of games; the divergence is taken off
    after that (the order that is usual), or before it if asked.
    """
    rows = rollouts.withColumn("_g", F.floor(F.col(game) / group_size)).withColumn("weight", F.col(reward).cast("double"))
    if kl and kl_before_centering:
        rows = offline_kl(rows, "weight", *kl)
    rows = centred(rows, "weight", "_g", "weight")
    if kl and not kl_before_centering:
        rows = offline_kl(rows, "weight", *kl)
    rows = P.trim_lengths(P.without_marker(rows, text, marker), length, most=most)
    rows = P.positive(rows, "weight")
    if percentile is not None:
        rows = P.weight_percentile(rows, "weight", percentile)
    return split_exact(rows, 1 - validation, key, seed, rounding="ceil").drop("_g")


def record(rollouts: DataFrame, *, length: str, reward: str, game: str, by: list[str], group_size: int = 8, most: int = 5000) -> DataFrame:
    """The record of each round: what was generated and what the length trim left."""
    rows = centred(rollouts.withColumn("_g", F.floor(F.col(game) / group_size)), reward, "_g", "_w")
    cut = rows.groupBy(*by).agg(F.least(F.floor(F.percentile(length, 0.95)), F.lit(most)).alias("_cut"))
    marked = rows.join(cut, by).withColumn("_kept", F.col(length) <= F.col("_cut"))
    return round_record(marked, reward, "_w", length, "_kept", by)


def needs_another_round(means: DataFrame, order: str, mean: str, k: int) -> bool:
    """Whether the last round's mean lies below all of the ``k`` before it."""
    last = [r[0] for r in means.orderBy(F.col(order).desc()).limit(k + 1).select(mean).collect()]
    return len(last) == k + 1 and all(last[0] < m for m in last[1:])
