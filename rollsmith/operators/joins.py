"""Joins: analysis tables, pairs within groups, text proximity, fuzzy options, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_prop") -> DataFrame:
    """Inner join on keys; columns that both sides have get a suffix on the right. Keys may repeat."""
    renamed = right.withColumnsRenamed({c: c + suffix for c in right.columns if c in left.columns and c not in keys})
    return left.join(renamed, keys, "inner")


def group_pairs(df: DataFrame, uid: str, order: str, columns: list[str]) -> DataFrame:
    """Pairs i < j of a group's rows. Groups are the samples of one prompt, so pairs stay few."""
    a = df.select(uid, F.col(order).alias("i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    b = df.select(uid, F.col(order).alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return a.join(b, uid).where("i < j")


def opposite_peers(df: DataFrame, uid: str, acc: str, score: str, out: str = "peer_mean") -> DataFrame:
    """Mean score of the group's rows of worse outcome (for a positive outcome) or better (for 0).

    Instead of comparing rows with rows, the group's scores are summed for each outcome
    and read by running sums over outcomes.
    """
    per = df.groupBy(uid, acc).agg(F.sum(score).alias("_s"), F.count("*").alias("_n"))
    lower = Window.partitionBy(uid).orderBy(acc).rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.partitionBy(uid).orderBy(acc).rowsBetween(1, Window.unboundedFollowing)
    side = lambda c: F.when(F.col(acc) > 0, F.sum(c).over(lower)).otherwise(F.sum(c).over(upper))
    per = per.select(uid, acc, F.coalesce(F.try_divide(side("_s"), side("_n")), F.lit(0.0)).alias(out))
    return df.join(per, [uid, acc])


def preference_pairs(df: DataFrame, pos: str, score: str) -> DataFrame:
    """Neighbours (2k, 2k+1): which of the two is chosen; a tie goes to the first."""
    w = Window.partitionBy(F.floor(F.col(pos) / 2)).orderBy(F.col(score).desc(), pos)
    return df.withColumn("pair", F.floor(F.col(pos) / 2)).withColumn("chosen", F.row_number().over(w) == 1)


def positions(text: Column, needle: Column) -> Column:
    """Where a needle stands in a text (from 0), without overlaps."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")))
    starts = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda a, p: F.struct((a["at"] + F.length(p) + F.length(needle)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(F.length(needle) > 0, starts).otherwise(F.expr("cast(array() as array<int>)"))


def proximity_pairs(messages: DataFrame, key: str, text: str, first: list[str], second: list[str], distance: int = 100) -> DataFrame:
    """Pairs of names of which some places in a message are closer than ``distance``, ignoring case.

    The name lists are part of the plan; each message is looked at once.
    """
    low = F.lower(F.col(text))
    named = lambda names: F.filter(F.array(*[F.struct(F.lit(n).alias("name"), positions(low, F.lit(n.lower())).alias("at")) for n in names]), lambda s: F.size(s["at"]) > 0)
    found = messages.select(key, F.explode(named(first)).alias("a"), named(second).alias("bs")).select(key, "a", F.explode("bs").alias("b"))
    near = F.exists("a.at", lambda x: F.exists("b.at", lambda y: F.abs(x - y) < distance))
    return found.where(near).select(key, F.col("a.name").alias("first"), F.col("b.name").alias("second"))


def best_option(df: DataFrame, text: str, options: list[str], out: str = "match") -> DataFrame:
    """The option sharing most words with a text; ties to the first option, null if none is shared."""
    words = F.array_distinct(F.split(F.lower(F.trim(F.col(text))), r"\s+"))
    scored = [F.struct(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(set(o.lower().split()))]))).alias("n"), F.lit(-i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)]
    best = F.array_max(F.array(*scored))
    return df.withColumn(out, F.when(best["n"] > 0, best["o"]))


def priced(calls: DataFrame, prices: DataFrame, model: str = "model", tokens_in: str = "input_tokens", tokens_out: str = "output_tokens") -> DataFrame:
    """Cost of each call by its model's prices a million tokens; an unknown model costs 0 and still counts."""
    joined = calls.join(prices, model, "left")
    cost = (F.col(tokens_in) * F.col("price_in") + F.col(tokens_out) * F.col("price_out")) / 1e6
    return joined.withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("price_in", "price_out")


def seeded_group(game: Column, size: int) -> Column:
    """The group that games share a state in: the game's number divided by the group size."""
    return F.floor(game / size)
