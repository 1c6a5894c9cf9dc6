"""Chat formatting with typed content parts, in DataFrame expressions only.

A message's content is a string or an array of typed parts. A visitor turns the
parts, in order, into text: a text part is escaped, and an image, audio or document
part becomes a numbered placeholder, whose reference and expanded token count are
recorded as an attachment. Turns are wrapped in the template's marks; what the model
is trained on, the assistants' text, is recorded as spans of code points.

Control strings inside texts and roles are escaped reversibly: after their opening
``<`` or ``[`` (and any backslashes there) one backslash is put in, and taken out on
reading back. Turns are first joined into segments of ``SEGMENT`` turn numbers, then
segments into conversations, so a long conversation is assembled in two steps.

Defined results: a null text or role is empty; rows are ordered by turn (null last),
then role and text; repeated rows are repeated turns; null conversation ids make one
conversation; a part of unknown type or without a reference is a placeholder with an
empty reference; a missing measure (width, seconds, pages) counts as the least one;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Turn numbers that one segment spans.
SEGMENT = 64
#: Tokens: side of an image patch in pixels, audio tokens a second, tokens of a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
TRAINED_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_OPEN, _REST = r"([<\[]\\*)", r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\" + _REST, "$1$2")


def text_part(text: Column) -> Column:
    """A content array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def expanded_tokens(part: Column) -> Column:
    """Token count that a part's placeholder stands for."""
    side = lambda n: F.greatest(F.ceil(F.coalesce(part[n], F.lit(1)) / PATCH), F.lit(1))
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND), F.lit(1)))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PER_PAGE)
        .otherwise(F.lit(1))
        .cast("long")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it asks for it."""
    return F.transform(F.array(value), body)[0]


def flatten(parts: Column) -> Column:
    """The visitor: parts in order as escaped text and placeholders, each numbered within its turn.

    Text parts that follow one another are joined before they are escaped, so no control
    string can arise where one ends and the next begins; a placeholder holds none either
    way, as no control string goes on after ``<`` or ``[`` with ``<`` or holds ``|>`` inside.
    """
    text = lambda p: F.coalesce(p["text"], F.lit(""))
    mark = lambda p, number: F.concat(F.lit("<|"), F.regexp_replace(F.coalesce(p["type"], F.lit("")), r"[<|>\[\]\\]", ""), F.lit(":"), number.cast("string"), F.lit("|>"))

    def segments(ps: Column, ends: Column) -> Column:
        # Between two placeholders (or the ends) lies one run of text parts.
        run = lambda j: F.slice(ps, ends[j] + 1, ends[j + 1] - ends[j] - 1)
        said = lambda j: escape(F.array_join(F.transform(run(j), text), ""))
        last = F.size(ends) - 2
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda j: F.when(j < last, F.concat(said(j), mark(F.get(ps, ends[j + 1] - 1), j + 1))).otherwise(said(j))), "")

    def ends(ps: Column) -> Column:
        places = F.filter(F.transform(ps, lambda p, i: F.when(~_is_text(p), i + 1)), lambda i: i.isNotNull())
        return F.concat(F.array(F.lit(0)), places, F.array(F.size(ps) + 1))

    return _let(parts, lambda ps: _let(ends(ps), lambda e: segments(ps, e)))


def attachments(parts: Column, turn: Column) -> Column:
    """What the placeholders of a turn stand for, in order."""
    return F.transform(F.filter(parts, lambda p: ~_is_text(p)), lambda p, i: F.struct(turn.alias("turn"), (i + 1).alias("number"), p["type"].alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), expanded_tokens(p).alias("tokens")))


def format_chat(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation.

    ``formatted``: the text; ``loss_spans``: for each assistant text its turn (from 0),
    its ``start`` in the formatted text, its ``offset`` in the turn and its ``length``,
    in code points; ``attachments``; ``expanded_tokens``, their sum.
    """
    content = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.expr(f"cast(array() as array<{PART}>)")) if parts_col else text_part(F.coalesce(F.col(text_col), F.lit("")))
    said = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("parts"))
    said = said.withColumn("body", flatten(F.col("parts"))).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    one = F.struct(
        F.col("turn").isNull().alias("unknown"), "turn", "role", "body", F.concat("head", "body", F.lit(END)).alias("block"),
        F.when(F.col("role") == TRAINED_ROLE, F.length("head")).alias("offset"), F.length("body").alias("length"), attachments(F.col("parts"), F.col("turn")).alias("attachments"),
    )
    part = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit((1 << 62))).alias("segment")
    segments = said.groupBy("conv", part).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    segments = segments.select("conv", F.struct(
        "segment", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("text"), F.transform("turns", lambda t: F.length(t["block"])).alias("sizes"),
        F.transform("turns", lambda t: F.struct(t["offset"].alias("offset"), t["length"].alias("length"))).alias("spans"), F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    ).alias("piece"))
    whole = segments.groupBy("conv").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = whole.select(
        "conv",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: p["sizes"])).alias("sizes"),
        F.flatten(F.transform("pieces", lambda p: p["spans"])).alias("spans"),
        F.flatten(F.transform("pieces", lambda p: p["attachments"])).alias("attachments"),
    )
    # A turn's start is the sum of the sizes before it; sums over segments of turns keep this near linear.
    step = 64
    strides = F.expr(f"transform(sequence(0, greatest(cast(ceil(size(sizes) / {step}) as int) - 1, 0)), k -> aggregate(slice(sizes, k * {step} + 1, {step}), 0L, (a, x) -> a + x))")
    whole = whole.withColumn("strides", strides)
    bases = F.expr("aggregate(strides, named_struct('sum', 0L, 'at', cast(array() as array<bigint>)), (a, x) -> named_struct('sum', a.sum + x, 'at', concat(a.at, array(a.sum))), a -> a.at)")
    whole = whole.withColumn("bases", bases)
    spans = F.expr(
        f"filter(transform(spans, (s, i) -> named_struct('turn', i, 'start', bases[i div {step}] + aggregate(slice(sizes, (i div {step}) * {step} + 1, i % {step}), 0L, (a, x) -> a + x) + s.offset, 'offset', s.offset, 'length', s.length)), s -> s.offset is not null)"
    )
    return whole.select(F.col("conv").alias(conv_col), "formatted", spans.alias("loss_spans"), "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``blocks`` (the text after each turn mark), and ``roles``, ``texts`` and ``loss_text`` read from them."""
    blocks = formatted.withColumn("blocks", F.expr("slice(split(formatted, '<\\\\|turn\\\\|>'), 2, 2147483647)"))
    cut = lambda b: F.substring_index(b, SAYS, 1)
    rest = lambda b: F.substring(b, F.length(cut(b)) + len(SAYS) + 1, F.length(b) - F.length(cut(b)) - len(SAYS) - len(END))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get(F.col("blocks"), s["turn"]), s["offset"] - len(TURN) + 1, s["length"])))
    return blocks.withColumns({"roles": F.transform("blocks", lambda b: unescape(cut(b))), "texts": F.transform("blocks", lambda b: unescape(rest(b))), "loss_text": F.array_join(loss, "")})


def digests(formatted: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of what the formatted text says when it is read back."""
    back = read_back(formatted)
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return back.select(
        conv_col, F.size("blocks").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
