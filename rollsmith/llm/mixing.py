"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of copies.
The whole copies are certain; the fractions are rounded together: two documents at
a time pass words between them, at random and without bias, until one of them holds
no or one whole copy, and the other goes on to the next. Words are conserved in every
step, so a source misses its target by less than one document. Documents are dealt
to chunks of a source, largest first; each chunk leaves one residual, and residuals
are paired again in a tree of ever fewer chunks, until each source has one. That one
is drawn by its share; the words this adds or lacks are made up for by documents of
the source's first chunk, largest first, whose rounding is turned where it fits.

Defined results: size is the number of runs of characters other than ASCII white
space (null: 0); a source of size 0 has target 0; null is a source of its own, last;
repeated rows are rounded each for itself; an empty table gives an empty result.
Texts of any length are sized whole; ties of size go by a hash of the row. The report
reads no other column, whatever its name; ``mixed_rows`` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.llm.common import TextBuffer, frugal, materialize, release, slices, tidy

WEIGHTS, MOST_COPIES = (1.0, 2.0, 3.0), 3.0
#: Documents of a chunk, and residuals of chunks that meet in one chunk of the next level.
CHUNK, FAN_IN = 1024, 16_384
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def count_words(buffer: TextBuffer) -> np.ndarray:
    """The number of words of each text: bytes that are no space, at a text's start or after a space."""
    word = ~_SPACE[buffer.data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = buffer.offsets[:-1][np.diff(buffer.offsets) > 0]
    start[firsts] = word[firsts]
    return buffer.sums(start)


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size, text_hash`` for each document."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                size = pa.array(count_words(TextBuffer(part.column("text"))), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("source"), size, part.column("text_hash")], names=["id", "source", "size", "text_hash"])

    return kept.mapInArrow(frugal(run), f"id {kept.schema['id'].dataType.simpleString()}, source {kept.schema['source'].dataType.simpleString()}, size long, text_hash long")


def ranked(keys: DataFrame, column: str) -> DataFrame:
    """Add ``rank`` (from 0, nulls last) over a written table, without one task for all rows.

    Rows are dealt by ranges of the column; the driver sees one count for each range.
    """
    dealt = materialize(keys.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    before, total = [], 0
    for part, count in counts:
        before += [F.lit(part), F.lit(total)]
        total += count
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())) - 1
    return dealt.withColumn("rank", (start + within).cast("long")).drop("part")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``source, source_size, docs, target``: all sizes shared by weight, none above ``most`` times its source.

    The level of the sharing is found by repeated sums; each round sends one row to the driver.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = materialize(ranked(per, "source").withColumn("weight", weight).drop("rank"))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    most_size = F.col("source_size") * F.lit(most)
    level = 0.0
    while True:
        above = most_size < F.col("weight") * F.lit(level)
        capped, free = per.agg(F.sum(F.when(above, most_size)), F.sum(F.when(~above, F.col("weight")))).first()
        reached = (total - float(capped or 0)) / free if free else level
        if not reached > level:
            break
        level = reached
    return per.select("source", "source_size", "docs", F.least(most_size, F.col("weight") * F.lit(level)).alias("target"))


def _pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairwise transfer of words within runs of equal ``source, chunk`` of a sorted partition.

    Adds ``extra``: 0 or 1 for a settled row; the one row left of each run keeps its
    share in ``share``, and has ``extra`` null.
    """
    names = ["id", "text_hash", "source", "group", "size", "share", "draw", "extra"]
    held: dict[str, list] = {n: [] for n in names}
    key, pending = None, None

    def put(row: list, share: float | None, extra: int | None) -> None:
        row[5] = share
        for n, v in zip(names, [*row, extra]):
            held[n].append(v)

    schema = None
    for batch in batches:
        schema = batch.schema.append(pa.field("extra", pa.int32()))
        rows = zip(*(batch.column(n).to_pylist() for n in names[:-1]))
        for row in map(list, rows):
            now = (row[2], row[3])
            if now != key:
                if pending is not None:
                    put(pending, pending[5], None)
                key, pending = now, None
            if pending is None:
                pending = row
                continue
            a, b = pending, row
            up = min((1 - a[5]) * a[4], b[5] * b[4])
            down = min(a[5] * a[4], (1 - b[5]) * b[4])
            moved = up if b[6] * (up + down) < down else -down
            # What settles is set, not computed, so that no rounding error keeps a share open.
            first = (moved > 0 and moved == (1 - a[5]) * a[4]) or (moved < 0 and -moved == a[5] * a[4])
            if first:
                put(a, None, int(moved > 0))
                b[5] = min(1.0, max(0.0, b[5] - moved / b[4]))
                pending = b
            else:
                put(b, None, int(moved < 0))
                a[5] = min(1.0, max(0.0, a[5] + moved / a[4]))
                pending = a
            if pending[5] in (0.0, 1.0):
                put(pending, None, int(pending[5]))
                pending = None
        yield pa.RecordBatch.from_arrays([pa.array(held[n], schema.field(n).type) for n in names], schema=pa.schema([schema.field(n) for n in names]))
        held = {n: [] for n in names}
    if pending is not None:
        put(pending, pending[5], None)
        yield pa.RecordBatch.from_arrays([pa.array(held[n], schema.field(n).type) for n in names], schema=pa.schema([schema.field(n) for n in names]))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn the rounding of rows, sorted by source and falling size, while that brings ``over`` nearer to 0."""
    source, over = object(), 0.0
    for batch in batches:
        extra = batch.column("extra").to_pylist()
        rows = zip(batch.column("source").to_pylist(), batch.column("size").to_pylist(), batch.column("over").to_pylist())
        for i, (now, size, start) in enumerate(rows):
            if now != source:
                source, over = now, start
            if size <= abs(over) and extra[i] == (over > 0):
                over += -size if extra[i] else size
                extra[i] = 1 - extra[i]
        yield batch.set_column(batch.schema.get_field_index("extra"), "extra", pa.array(extra, pa.int32()))


def _draw(seed: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


@tidy
def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 1) -> DataFrame:
    """``id, text_hash, source, size, source_size, target, copies`` for every document."""
    sizes = materialize(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    goal = materialize(targets(sizes, weights=weights, most=most).withColumn("ratio", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))))
    g = goal.withColumnRenamed("source", "goal_source")
    rows = sizes.join(g, sizes["source"].eqNullSafe(g["goal_source"])).drop("goal_source")
    rows = rows.withColumn("whole", F.floor("ratio")).withColumn("share", F.col("ratio") - F.floor("ratio"))
    rows = materialize(rows)
    certain = (F.col("share") == 0) | (F.col("size") == 0)
    sure = rows.where(certain).withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole")))
    shared = ["id", "text_hash", "source", "group", "size", "share", "draw"]
    open_rows = rows.where(~certain).withColumn("chunks", F.ceil(F.col("docs") / CHUNK))
    waiting = open_rows.withColumn("group", F.pmod(F.xxhash64("id", "text_hash", F.lit(seed)), "chunks")).withColumn("draw", _draw(seed + 1, "id", "text_hash", "size")).select(*shared)
    chunks = int(rows.agg(F.max(F.ceil(F.col("docs") / CHUNK))).first()[0] or 1)
    kinds = ", ".join(f"{n} {waiting.schema[n].dataType.simpleString()}" for n in shared) + ", extra int"
    settled, level = [], 0
    while True:
        level += 1
        dealt = waiting.repartition("source", "group").sortWithinPartitions("source", "group", F.col("size").desc(), "id", "text_hash")
        done = materialize(dealt.mapInArrow(_pivot, kinds))
        settled.append(done.where("extra is not null").select("id", "text_hash", "source", "size", "extra", "group"))
        left = done.where("extra is null").drop("extra")
        if chunks == 1:
            break
        chunks = max(1, -(-chunks // FAN_IN))
        waiting = left.withColumn("group", F.pmod("group", F.lit(chunks))).withColumn("draw", _draw(seed + 1 + level, "id", "text_hash", "size")).select(*shared)
    # The last residual of a source holds a fraction of one document; it is drawn by that fraction.
    last = materialize(left.withColumn("extra", (F.col("draw") < F.col("share")).cast("int")))
    over = last.select(F.col("source").alias("over_source"), ((F.col("extra") - F.col("share")) * F.col("size")).alias("over"))
    near = settled[0].where("group = 0")
    near = near.join(over, near["source"].eqNullSafe(over["over_source"])).select("id", "text_hash", "source", "size", "extra", "over")
    near = near.repartition("source").sortWithinPartitions("source", F.col("size").desc(), "id", "text_hash", "extra")
    turned = near.mapInArrow(_settle, near.schema)
    final = ["id", "text_hash", "source", "size", "extra"]
    # Rounding may settle a source without a residual; its first chunk then stands as it is.
    alone = settled[0].where("group = 0").join(over, F.col("source").eqNullSafe(F.col("over_source")), "left_anti")
    drawn = settled[0].where("group <> 0").select(*final).union(turned.select(*final)).union(alone.select(*final)).union(last.select(*final))
    for more in settled[1:]:
        drawn = drawn.union(more.select(*final))
    drawn = drawn.join(g, drawn["source"].eqNullSafe(g["goal_source"])).withColumn("copies", F.floor("ratio") + F.col("extra"))
    columns = ["id", "text_hash", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies")]
    return sure.select(*columns).union(drawn.select(*columns))


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: ``size, source_size, target, taken``, in words."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows, with all their columns, each as often as the mix takes it.

    Rows that share id, text and source stand for one another.
    """
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key = F.struct(F.col("id").alias("id"), F.col("text_hash").alias("text_hash"), F.col("source").alias("source")).alias("key")
    copies = materialize(mixed.groupBy(key).agg(F.sum("copies").alias("copies"), (F.count("*") > 1).alias("many")).where("copies > 0"))
    release(mixed)
    keyed = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source")).alias("row_key"))
    # Texts are exchanged once: only rows that repeat a key are then told apart, where they lie.
    met = lambda x: keyed.join(x.hint("shuffle_hash"), keyed["row_key"] == x["key"])
    taken = met(copies.where("not many")).select("row", "copies")
    if not copies.where("many").isEmpty():
        taken = taken.union(met(copies.where("many")).dropDuplicates(["row_key"]).select("row", "copies"))
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")
