"""Registered queries: a callable of the tables, and the SQL its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read when they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under ``name``, with its SQL where there is one."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


#: Token rows of the order lines: a sequence for each order, its lines in order as tokens.
TOKENS_SQL = """tok AS (
  SELECT l_orderkey AS seq, l_orderkey % 500 AS uid,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t,
    l_quantity / 50.0 AS reward, l_tax AS value, (l_returnflag <> 'R')::INT AS mask,
    -l_discount AS old_lp, -l_tax AS lp, -(l_discount + l_tax) / 2 AS ref_lp
  FROM lineitem)"""
