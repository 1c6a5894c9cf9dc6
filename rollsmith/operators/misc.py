"""Small operators: dialogue roles, passages, packing indices, checks, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith.functions import text as X
from rollsmith.functions import tokens as T


def trained_player(turns: Column, first_block: Column, least: int = 20, window: int = 150) -> Column:
    """The player of the first message whose opening stands in the first trained block."""
    opening = lambda m: F.substring(X.public_text(m["message"]), 1, window)
    said = F.filter(turns, lambda m: (F.length(opening(m)) > least) & F.contains(first_block, opening(m)))
    return F.try_element_at(said, F.lit(1))["player"]


def questions_by_round(df: DataFrame, round_: str, conversation: str, text: str) -> DataFrame:
    """Mean number of question marks of a conversation, for each round."""
    per = df.groupBy(round_, conversation).agg(F.sum(X.count_of(text, "?")).alias("_q"))
    return per.groupBy(round_).agg(F.avg("_q").alias("mean_questions"), F.count("*").alias("n"))


def project_totals(df: DataFrame, cost: str, model: str, keep: Column | None = None) -> DataFrame:
    """Calls, costs and the models used; models are few and sorted."""
    rows = df if keep is None else df.where(keep)
    return rows.agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"), F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models"))


def passages(texts: Column | str) -> Column:
    """Retrieved texts numbered from 1, each with its first line as a title."""
    t = F.col(texts) if isinstance(texts, str) else texts
    title = lambda p: F.substring_index(p, "\n", 1)
    one = lambda p, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), title(p), F.lit(")\n"), F.substring(p, F.length(title(p)) + 2, F.length(p)), F.lit("\n\n"))
    return F.array_join(F.transform(t, one), "")


def left_pad_positions(mask: Column | str) -> Column:
    """The running sum of a mask less one, 0 at least."""
    m = F.col(mask) if isinstance(mask, str) else mask
    run = F.aggregate(m, F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<int>)").alias("o")), lambda a, x: F.struct((a["s"] + x.cast("int")).alias("s"), F.concat(a["o"], F.array(F.greatest(a["s"] + x.cast("int") - 1, F.lit(0)))).alias("o")), lambda a: a["o"])
    return run


def unpad_index(df: DataFrame, key: str, mask: str, width: int) -> DataFrame:
    """Flat positions of counted tokens of rows numbered by ``key``."""
    return df.select(key, F.posexplode(mask).alias("at", "m")).where("m > 0").select((F.col(key) * width + F.col("at")).alias("position"))


def cumulative_lengths(df: DataFrame, batch: str, key: str, mask: str) -> DataFrame:
    """For each row of a batch where its tokens begin and end in the unpadded stream."""
    n = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    end = F.sum("_n").over(Window.partitionBy(batch).orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(batch, key, n.alias("_n")).withColumn("end", end).withColumn("start", F.col("end") - F.col("_n")).drop("_n")


def temperature(logits: Column | str, t: float) -> Column:
    return F.transform(F.col(logits) if isinstance(logits, str) else logits, lambda x: x / t)


def prompt_and_response(ids: Column, prompt_size: Column, most: int, most_response: int) -> tuple[Column, Column]:
    """A full sequence cut to the model's length, then into prompt and capped response."""
    cut = F.slice(ids, F.lit(1), F.lit(most))
    return F.slice(cut, F.lit(1), prompt_size), F.slice(cut, prompt_size + 1, F.lit(most_response))


def final_check(arrays: list[str], expected: str, got: str, mode: str = "strict") -> Column:
    """What is wrong with a finished rollout: lengths that differ, or texts that do."""
    same = F.lit(True)
    for c in arrays[1:]:
        same &= F.size(c) == F.size(arrays[0])
    squeeze = (lambda c: F.regexp_replace(c, r"\s+", "")) if mode == "ignore_whitespace" else F.col
    return F.when(~same, "lengths differ").when(squeeze(expected) != squeeze(got), "text differs").otherwise("ok")


def size_in_gib(df: DataFrame, texts: list[str], arrays: dict[str, int]) -> DataFrame:
    """The size of a batch: bytes of texts and of array cells, in GiB."""
    total = sum((F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    for c, width in arrays.items():
        total = total + F.coalesce(F.size(c), F.lit(0)).cast("long") * width
    return df.agg((F.sum(total) / float(1 << 30)).alias("gib"))


def pretty_table(table: Column, width: int = 12) -> Column:
    """A table as text: blanks as a dash, cells filled up to a width but never cut."""
    cell = lambda v: F.when(v == "", "-").otherwise(v)
    padded = lambda v: F.lpad(cell(v), F.greatest(F.lit(width), F.length(cell(v))), F.lit(" "))
    return F.array_join(F.transform(table, lambda r: F.array_join(F.transform(r, padded), "")), "\n")


def verdict(text: Column | str) -> Column:
    return F.when(F.coalesce(X.last_boxed(text) == "True", F.lit(False)), 1.0).otherwise(0.0)


def batch_normed(tokens: DataFrame, reward: str, *, seq: str = "seq", order: str = "t") -> DataFrame:
    """Rewards over the largest sum to the end, in size, of the whole batch."""
    w = Window.partitionBy(seq).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    top = tokens.select(F.abs(F.sum(reward).over(w)).alias("_a")).agg(F.max("_a").alias("_top"))
    return tokens.crossJoin(F.broadcast(top)).withColumn(reward, F.col(reward) / (F.col("_top") + 1e-6)).drop("_top")


def sequence_log_prob(lp: str, labels: str, *, ignore: int = -100, mean: bool = False) -> Column:
    """Log-probabilities of labels shifted by one, summed or averaged over those that count."""
    pairs = F.zip_with(F.slice(lp, F.lit(1), F.greatest(F.size(lp) - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.when(y != ignore, p.cast("double")))
    kept = F.filter(pairs, lambda p: p.isNotNull())
    return F.try_divide(T.total(kept), F.size(kept)) if mean else T.total(kept)


def text_export(df: DataFrame, path: str, game: str, order: str, player: str, message: str, reward: str) -> None:
    """One text a game: its turns and its reward, as lines of a text table."""
    cells = F.sort_array(F.collect_list(F.struct(order, F.concat(F.col(player), F.lit(": "), F.col(message)).alias("_l"))))
    games = df.groupBy(game).agg(cells.alias("_x"), F.first(reward, ignorenulls=True).alias("_r"))
    games.select(F.concat(F.lit("game "), game, F.lit(" reward "), F.coalesce(F.col("_r").cast("string"), F.lit("-")), F.lit("\n"), F.array_join(F.transform("_x", lambda x: x["_l"]), "\n")).alias("value")).write.mode("overwrite").text(path)


def preference_ids(chosen: Column, rejected: Column, length: int, pad: int, eos: int | None = None) -> Column:
    """Two id arrays cut or padded to a length, with an end id if asked."""
    end = lambda x: x if eos is None else F.concat(x, F.array(F.lit(eos)))
    fit = lambda x: T.pad_right(T.truncate(end(x), length), length, pad)
    return F.array(fit(chosen), fit(rejected))


def nested(df: DataFrame, root: str, path: list[str]) -> Column:
    """A field below nested structs, maps and arrays of one."""
    c, kind = F.col(root), df.schema[root].dataType
    for key in path:
        if kind.typeName() == "array":
            c, kind = F.get(c, F.lit(0)), kind.elementType
        c, kind = c[key], kind[key].dataType if kind.typeName() == "struct" else kind.valueType
    return F.get(c, F.lit(0)) if kind.typeName() == "array" else c
