"""Queries of what users plug in: sources, tools, dispatch modes and outside scorers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.functions.calls import bounded_calls
from rollsmith.functions.tools import register_tools
from rollsmith.operators.dispatch import dispatch
from rollsmith.plans.registry import Tables, query
from rollsmith.sources.plugin import RowGroups, register
from rollsmith.streaming.commits import step_log

BY_TYPE_SQL = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"


@query("e7_source_batch", BY_TYPE_SQL)
def e7_batch(t: Tables) -> DataFrame:
    rows = t.spark.read.format(register(t.spark, RowGroups)).option("path", f"{t.folder}/events.parquet").load()
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("e7_source_stream", BY_TYPE_SQL)
def e7_stream(t: Tables) -> DataFrame:
    stream = t.spark.readStream.format(register(t.spark, RowGroups)).option("path", f"{t.folder}/events.parquet").load()
    log = step_log(stream, "plugged", lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    return log.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def _turns(t: Tables) -> None:
    register_tools(t.spark)
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda c: F.struct(c["role"].alias("role"), c["text"].alias("text")))
    t.conversations.groupBy("conv_id").agg(turns.alias("turns")).createOrReplaceTempView("rollsmith_turns")


@query("e8_tool_letters", """SELECT conv_id, place, role, letters, sum(letters) OVER (PARTITION BY conv_id ORDER BY place)::INTEGER AS so_far FROM (
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS place, role, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))::INTEGER AS letters FROM conversations)""")  # fmt: skip
def e8_letters(t: Tables) -> DataFrame:
    _turns(t)
    return t.spark.sql("SELECT conv_id, r.* FROM rollsmith_turns, LATERAL tool_turns('letters', turns) r")


@query("e8_tool_repeats", """SELECT conv_id, place, role, first < place AS repeated, first AS first_turn FROM (SELECT *, min(place) OVER (PARTITION BY conv_id, role, text) AS first FROM (
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS place, role, text FROM conversations))""")  # fmt: skip
def e8_repeats(t: Tables) -> DataFrame:
    _turns(t)
    return t.spark.sql("SELECT conv_id, r.* FROM rollsmith_turns, LATERAL tool_turns('repeats', turns) r")


def _doubled(worker: int, frames):
    for rows in frames:
        yield pd.DataFrame({"event_id": rows["event_id"], "twice": rows["value"] * 2 + worker})


@query("e9_shares", "SELECT i // ((n + 6) // 7) AS worker, i AS place, event_id, round(value * 2 + i // ((n + 6) // 7), 6) AS twice FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)")
def e9_shares(t: Tables) -> DataFrame:
    return dispatch(t.events.select("event_id", "ts", "value"), "shares", 7, ["ts", "event_id"], _doubled, "event_id long, twice double").withColumn("twice", F.round("twice", 6))


@query("e9_one_to_all", "SELECT worker::INTEGER AS worker, row_number() OVER (PARTITION BY worker ORDER BY event_id) - 1 AS place, event_id, round(value * 2 + worker, 6) AS twice FROM events, range(3) w(worker)")
def e9_all(t: Tables) -> DataFrame:
    return dispatch(t.events.select("event_id", "value"), "one_to_all", 3, ["event_id"], _doubled, "event_id long, twice double").withColumn("twice", F.round("twice", 6))


def _outside(value, attempt: int) -> float:
    """A scorer that fails once for some rows and always for others."""
    if value % 7 == 0 or value % 5 == 0 and attempt == 0:
        raise ConnectionError("no answer")
    return value % 100 / 100


@query("z7_bounded_calls", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 100) / 100 END AS score FROM events")
def z7(t: Tables) -> DataFrame:
    return bounded_calls(t.events.select("event_id"), "event_id", _outside, most=8, window=64)
