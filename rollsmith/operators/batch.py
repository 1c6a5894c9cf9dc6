"""Batch algebra on tables with an explicit position column.

DataFrames have no row order; whatever depends on order takes the column that holds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.operators.ranking import indexed


def select_keys(df: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """The named columns with the position."""
    return df.select(position, *[k for k in keys if k != position])


def pop(df: DataFrame, keys: list[str], position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The named columns as a table of their own, and what is left."""
    return select_keys(df, keys, position), df.drop(*keys)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumnsRenamed(names)


def take(df: DataFrame, indices: DataFrame, position: str = "pos", index: str = "index") -> DataFrame:
    """Rows at given positions, in the order of ``indices`` (columns ``ord, index``); repeats are kept."""
    return indices.join(df, indices[index] == df[position]).drop(index)


def slice_rows(df: DataFrame, start: int, stop: int, step: int = 1, position: str = "pos") -> DataFrame:
    p = F.col(position)
    return df.where((p >= start) & (p < stop) & ((p - start) % step == 0))


def numbered(df: DataFrame, order: list, position: str = "pos", partition: list[str] = ()) -> DataFrame:
    """Add positions from 0 in an explicit order, within partitions if given."""
    if not partition:
        return indexed(df, order, position)
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def zip_union(a: DataFrame, b: DataFrame, position: str = "pos") -> DataFrame:
    """Columns of two batches side by side; columns that both have must agree in every row.

    Row counts and shared columns are checked inside the plan: a conflict raises.
    """
    shared = [c for c in b.columns if c in a.columns and c != position]
    right = b.select(F.col(position).alias("_p"), *[F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns if c != position])
    both = a.join(right, a[position] == right["_p"], "full_outer")
    wrong = reduce(lambda x, c: x | ~F.col(c).eqNullSafe(F.col(f"_b_{c}")), shared, F.col(position).isNull() | F.col("_p").isNull())
    checked = both.withColumn(position, F.when(wrong, F.raise_error(F.lit("batches differ in rows or in a shared column")).cast("long")).otherwise(F.col(position)))
    return checked.drop("_p", *[f"_b_{c}" for c in shared])


def concat(batches: list[DataFrame], position: str = "pos", fill: bool = False) -> DataFrame:
    """Batches one after the other; positions of each go on where the one before ended.

    Each batch's size is one number on the driver.
    """
    out, start = None, 0
    for i, batch in enumerate(batches):
        moved = batch.withColumn(position, F.col(position) + start)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=fill)
        start += batch.count() if i < len(batches) - 1 else 0
    return out


def repeat(df: DataFrame, times: int, interleave: bool = True, position: str = "pos") -> DataFrame:
    """Each row ``times`` times: AABB if interleaved, else ABAB; positions are renewed."""
    copies = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return copies.withColumn(position, F.col(position) * times + F.col("_k")).drop("_k")
    return copies.withColumn(position, F.col(position) + F.col("_k") * F.lit(df.count())).drop("_k")


def repeat_each(df: DataFrame, times: Column | str) -> DataFrame:
    """Each row as often as its own count; a count of 0 drops it."""
    n = F.col(times) if isinstance(times, str) else times
    return df.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))


def unfold_chunks(df: DataFrame, arrays: list[str], n: int) -> DataFrame:
    """Each row as ``n`` rows holding equal pieces of its arrays; other columns repeat."""
    piece = lambda c, k: F.slice(c, k * F.floor(F.size(c) / n).cast("int") + 1, F.floor(F.size(c) / n).cast("int"))
    spread = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.withColumns({c: piece(c, F.col("chunk")) for c in arrays})


def fold(df: DataFrame, columns: list[str], k: int, position: str = "pos") -> DataFrame:
    """Every ``k`` rows as one row of arrays in order."""
    cell = F.sort_array(F.collect_list(F.struct(position, *columns)))
    part = lambda c: F.transform("_cells", lambda x: x[c])
    return df.groupBy(F.floor(F.col(position) / k).alias("row")).agg(cell.alias("_cells")).select("row", *[part(c).alias(c) for c in columns])


def unfold(df: DataFrame, columns: list[str], k: int, position: str = "pos") -> DataFrame:
    """The inverse of ``fold``."""
    return df.select("row", F.posexplode(F.arrays_zip(*columns)).alias("_i", "_c")).select((F.col("row") * k + F.col("_i")).alias(position), *[F.col("_c")[c].alias(c) for c in columns])


def chunk(df: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """Tag rows with one of ``n`` chunks of ``ceil(rows / n)``."""
    size = max(1, -(-df.count() // n))
    return df.withColumn("chunk", F.floor(F.col(position) / size))


def split(df: DataFrame, size: int, position: str = "pos") -> DataFrame:
    """Tag rows with pieces of a given size."""
    return df.withColumn("chunk", F.floor(F.col(position) / size))


def pad_to_divisor(df: DataFrame, divisor: int, position: str = "pos") -> DataFrame:
    """Rows repeated from the start until their number is divisible; ``padded`` tells which."""
    n = df.count()
    lack = -n % divisor
    own = df.withColumn("padded", F.lit(False))
    if not lack or not n:
        return own
    rounds = -(-lack // n)
    more = df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(position, F.col(position) + F.col("_k") * n).where(F.col(position) < n + lack)
    return own.unionByName(more.drop("_k").withColumn("padded", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("padded")).drop("padded")


def mini_batches(df: DataFrame, size: int, epochs: int, position: str = "pos") -> DataFrame:
    """Every row once for each epoch, tagged with its mini-batch; the size must divide the rows."""
    if df.count() % size:
        raise ValueError("the rows are not divisible by the mini-batch size")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col(position) / size))


def reorder(df: DataFrame, order: DataFrame, position: str = "pos") -> DataFrame:
    """Rows at new positions: ``order`` maps a new position ``pos`` to an old one ``index``."""
    return order.join(df.withColumnRenamed(position, "_old"), F.col("index") == F.col("_old")).drop("_old", "index")


def inverse(order: DataFrame) -> DataFrame:
    """The permutation that undoes ``order``."""
    return order.select(F.col("index").alias("pos"), F.col("pos").alias("index"))


def columns_to_rows(df: DataFrame, row: str, sample: str, value: str) -> DataFrame:
    """Values of many samples as one array for each row, in sample order."""
    return df.groupBy(row).agg(F.transform(F.sort_array(F.collect_list(F.struct(sample, value))), lambda x: x[value]).alias(value))
