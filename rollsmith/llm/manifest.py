"""Merkle manifest of a table: a digest over all rows, and for every row a proof that it is part of it.

Each row is a leaf, the SHA-256 of its fields. Leaves are numbered within their group by
``row_number``; at each level an index is floor-divided by the fan-out, the sorted array of a
parent's children is hashed, and so on until one node, the group's subroot, is left. The
subroots, in order of their groups, make a tree of the same kind up to the root.

A row's proof is its siblings at every level. Joins, one a level, hand them down from the
root: a node passes its own proof, with the siblings of each child put before it, to its
children, so the joins touch one and a half rows for each leaf in all and not one for each
leaf and level. Only digests are shuffled, never the fields. A group of any size is numbered
by ranges of the order: rows are numbered in their range, ranges are counted and added up.

Defined results: a null field counts as ``-``, any other as its UTF-8 length, ``:`` and its
text, so null, empty and joined fields differ; long texts are hashed whole. Null ids come
first in their group and the null group comes first; rows that repeat an id are ordered by
leaf, and equal rows have a place each. A group of one row has its leaf as subroot, a table of
one group its subroot as root. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.llm.common import materialize, tidy

FANOUT = 3
_STEPS = "array<struct<left:string,right:string>>"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(steps, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """One digest of a whole proof: its siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``at``, each row's place in its ``part``, and ``n``, the part's rows; also the largest part's rows."""
    dealt = materialize(rows.repartitionByRange("part", *order).withColumn("_range", F.spark_partition_id()))
    part = Window.partitionBy("part")
    counted = dealt.groupBy("_range", "part").agg(F.count("*").alias("_here"))
    ahead = part.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counted.select("_range", "part", F.coalesce(F.sum("_here").over(ahead), F.lit(0)).alias("_start"), F.sum("_here").over(part).alias("n")))
    within = F.row_number().over(Window.partitionBy("_range", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("_within", within).join(starts, ["_range", "part"]).withColumn("at", F.col("_start") + F.col("_within"))
    return placed.drop("_range", "_start", "_within"), starts.agg(F.max("n")).first()[0] or 0


def _grown(nodes: DataFrame, largest: int, carried: list[str], fanout: int) -> list[DataFrame]:
    """The levels above ``part, at, n, hash``: nodes with their children, until each part has one left.

    A part of one row is passed on as it is (``lone``); a part is in no level above its last.
    """
    levels: list[DataFrame] = []
    while not levels or largest > 1:
        child = F.struct("at", "hash", *([] if levels else carried))
        open_ = nodes.where("n > 1") if levels else nodes
        met = open_.groupBy("part", F.expr(f"at div {fanout}").alias("at")).agg(F.first("n").alias("below"), F.sort_array(F.collect_list(child)).alias("children"))
        lone = F.col("below") == 1
        together = F.array_join(F.transform("children", lambda c: c["hash"]), "")
        made = F.when(lone, F.col("children")[0]["hash"]).otherwise(F.sha2(together, 256))
        nodes = materialize(met.select("part", "at", F.ceil(F.col("below") / fanout).alias("n"), made.alias("hash"), lone.alias("lone"), "children"))
        levels.append(nodes)
        largest = -(-largest // fanout)
    return levels


def _descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """What each part of ``tops`` (with ``steps``, its own proof) hands down to its leaves, and their proofs."""
    given = [c for c in tops.columns if c not in ("part", "steps")]
    reached = None
    for number, level in reversed(list(enumerate(levels))):
        own = level.where("n = 1").select("part", "at").join(tops, "part")
        reached = own if reached is None else reached.unionByName(own)
        met = reached.join(level.select("part", "at", "lone", "children"), ["part", "at"])
        met = met.select("part", "steps", *given, "lone", "children", F.posexplode("children").alias("_place", "_child"))
        hashes = lambda cells: F.array_join(F.transform(cells, lambda c: c["hash"]), "")
        left, right = hashes(F.slice("children", 1, F.col("_place"))), hashes(F.slice("children", F.col("_place") + 2, F.size("children")))
        steps = F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("steps")))
        kept = ["part", "_child.at"] if number else ["part", "_child.*"]
        reached = met.select(*kept, steps.cast(_STEPS).alias("steps"), *given)
        if number:
            reached = materialize(reached)
    return reached


def _proved(docs: DataFrame, fields: list[str], id_col: str, group_col: str, fanout: int, altered: dict[str, Column] | None) -> DataFrame:
    if fanout < 2:
        raise ValueError("a parent needs two children at least")
    own, found = leaf([F.col(f) for f in fields]), leaf([(altered or {}).get(f, F.col(f)) for f in fields])
    part = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).alias("id"), part.alias("part"), own.alias("hash"), (found if altered else F.lit(None).cast("string")).alias("found"))
    leaves = leaves.withColumn("found", F.when(F.col("found") != F.col("hash"), F.col("found"))).withColumn("_row", F.monotonically_increasing_id())
    placed, largest = _placed(materialize(leaves), ["id", "hash", "_row"])
    levels = _grown(placed.drop("_row"), largest, ["id", "found"], fanout)
    subroots = functools.reduce(DataFrame.unionByName, [level.where("n = 1").select("part", "hash") for level in levels])
    placed, parts = _placed(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "hash"), ["name"])
    above = _grown(placed, parts, ["name"], fanout)
    top = above[-1].where("n = 1").select("part", F.col("hash").alias("root"), F.array().cast(_STEPS).alias("steps"))
    tops = _descended(above, top).select(F.col("name").alias("part"), F.col("hash").alias("subroot"), "root", "steps")
    return _descended(levels, materialize(tops)).select("id", F.col("hash").alias("leaf"), F.coalesce("found", "hash").alias("found"), "subroot", "root", "steps")


@tidy
def proofs(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> DataFrame:
    """``id, leaf, subroot, root, steps`` of every row; ``steps`` are the siblings left and right of its path, from the leaf up."""
    return _proved(docs, fields, id_col, group_col, fanout, None).drop("found").withColumnRenamed("id", id_col)


@tidy
def audit(docs: DataFrame, fields: list[str], altered: dict[str, Column] | None = None, *, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> DataFrame:
    """Hold rows, some of whose fields are now as ``altered`` says, against the manifest of the rows as they were.

    ``leaf``, ``subroot``, ``root`` and ``proof_sha256`` are those of the manifest, ``folded_root`` is where the row as
    it is now leads with its proof; it is ``verified`` if that is the root.
    """
    found = _proved(docs, fields, id_col, group_col, fanout, altered).withColumn("folded_root", fold(F.col("found"), F.col("steps")))
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
