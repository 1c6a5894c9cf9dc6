"""Tools that a conversation's turns are replayed through: one row in, a row for each turn out.

A tool is a class with ``columns``, the names and types of what it adds to a turn, and ``reply``. It is made
anew for every conversation and may keep what it has seen of it. In SQL a tool is a table function
of the turns, joined laterally; which columns it gives depends on the tool that is named.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

TOOLS: dict[str, type] = {}


def tool(name: str):
    """Register a class as a tool; another class of the same name raises."""

    def register(cls: type) -> type:
        if TOOLS.get(name, cls) is not cls:
            raise ValueError(f"another tool is named {name}")
        TOOLS[name] = cls
        return cls

    return register


def named(name: str | None) -> type:
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}; known are {', '.join(sorted(TOOLS))}")
    return TOOLS[name]


@tool("letters")
class Letters:
    """How many letters of the alphabet a turn has, and all turns so far."""

    columns = [("letters", IntegerType()), ("so_far", IntegerType())]

    def __init__(self) -> None:
        self.so_far = 0

    def reply(self, role: str | None, text: str | None) -> tuple:
        n = sum(c.isascii() and c.isalpha() for c in text or "")
        self.so_far += n
        return n, self.so_far


@tool("repeats")
class Repeats:
    """Whether the same role has said the same before, and when first (from 0)."""

    columns = [("repeated", BooleanType()), ("first_turn", IntegerType())]

    def __init__(self) -> None:
        self.said: dict[tuple, int] = {}
        self.turn = -1

    def reply(self, role: str | None, text: str | None) -> tuple:
        self.turn += 1
        first = self.said.setdefault((role, text), self.turn)
        return first < self.turn, first


class _ToolTurns:
    """``tool_turns(tool, turns)``: place, role and the tool's reply for each of ``turns`` (``role, text`` structs in order)."""

    @staticmethod
    def analyze(tool: AnalyzeArgument, turns: AnalyzeArgument) -> AnalyzeResult:
        if not tool.isConstantExpression or not isinstance(tool.value, str):
            raise ValueError("the tool's name has to be a constant string")
        shape = StructType().add("place", IntegerType()).add("role", StringType())
        for name, kind in named(tool.value).columns:
            shape = shape.add(name, kind)
        return AnalyzeResult(shape)

    def eval(self, tool: str, turns: list) -> Iterator[tuple]:
        own = named(tool)()
        for place, turn in enumerate(turns or []):
            yield place, turn["role"], *own.reply(turn["role"], turn["text"])


def register_tools(spark: SparkSession) -> None:
    """Make ``tool_turns`` known to SQL; a null list of turns gives no rows."""
    spark.udtf.register("tool_turns", udtf(_ToolTurns))
