"""Schemas of the engine's tables, and checks of what a table must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"
GAME_INFO = "struct<num_messages:int,completed:boolean,turn_count:int,game_normalized_reward:double,raw_normalized_reward:double,total_errors:int>"
CONVERSATION = "array<struct<turn:int,player:string,message:string,retry:int>>"
ROLLOUTS = (
    "input_ids array<bigint>, attention_mask array<bigint>, position_ids array<bigint>, loss_mask array<bigint>, sample_weight double, "
    "game_normalized_reward double, game_id bigint, game_info string, full_conversation string, policy_logprobs string"
)
RL_PROMPTS = f"data_source string, prompt {MESSAGES}, ability string, reward_model struct<style:string,ground_truth:string>, extra_info struct<split:string,index:bigint,answer:string,question:string>"
PREFERENCES = "prompt string, chosen string, rejected string"
EPISODES = "game_id bigint, question_count int, turn_count int, reward double, qwen_turns int, question_types map<string,int>"
API_CALLS = "experiment string, model string, input_tokens bigint, output_tokens bigint"


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself; it raises when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, columns: list[str]) -> Column:
    """The first of several columns that the table has."""
    for c in columns:
        if c in df.columns:
            return F.col(c)
    raise ValueError(f"none of these columns is present: {', '.join(columns)}")


def flat(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns named by their paths."""

    def walk(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            out += walk(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(separator.join(here))]
        return out

    return df.select(*walk(df.schema, ()))


def aligned(df: DataFrame, arrays: list[str]) -> DataFrame:
    """The table itself; a row whose arrays differ in length raises when it is read."""
    same = F.lit(True)
    for c in arrays[1:]:
        same &= F.size(c) == F.size(arrays[0])
    return df.withColumn(arrays[0], F.when(same, F.col(arrays[0])).otherwise(F.raise_error(F.lit("arrays of a row differ in length"))))
