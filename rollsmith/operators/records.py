"""Nested records: prompts, chat roles, role-swapped views, typed content, and what JSON columns hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollsmith import schemas
from rollsmith.functions import text as X
from rollsmith.functions.tokens import let
from rollsmith.operators.ranking import indexed


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def prompt_records(df: DataFrame, *, source: str, question: Column, answer: Column, order: list[str], split: str, instruction: str = "", ability: str = "math", style: str = "rule") -> DataFrame:
    """Prompt records; their index follows a stable key."""
    return indexed(df, order, "_index").select(
        F.lit(source).alias("data_source"), F.array(message("user", F.concat(question, F.lit(instruction)))).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), answer.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col("_index").alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info"),
    )


def map_examples(df: DataFrame, build) -> DataFrame:
    """Records by a function from a table to its output columns; the table's own columns are dropped."""
    return df.select(*build(df))


def shuffled_choices(df: DataFrame, gold: Column, wrong: Column, key: list[str], seed: int = 0) -> DataFrame:
    """Choices in a seeded order with the right one among them, and its letter."""
    all_ = F.concat(F.array(gold), wrong)
    keyed = F.array_sort(F.transform(all_, lambda c, i: F.struct(F.xxhash64(F.lit(seed), *key, i).alias("h"), i.alias("i"), c.alias("choice"))))
    return df.withColumn("choices", F.transform(keyed, lambda x: x["choice"])).withColumn("letter", F.element_at(F.split(F.lit("ABCDEFGHIJ"), ""), F.array_position(F.transform(keyed, lambda x: x["i"]), 0).cast("int")))


def search_records(df: DataFrame, *, question: str, truth: Column, golds: Column, source: str, index: str, split: str, system: str, prefix: str) -> DataFrame:
    """Search prompts: the given truth or the gold answers, the tagged source, and the tool's arguments."""
    truth = F.coalesce(truth, golds)
    tagged = F.concat(F.lit("searchR1_"), F.coalesce(F.col(source), F.lit("")))
    arguments = F.struct(truth.alias("ground_truth"), F.col(question).alias("question"), tagged.alias("data_source"))
    return df.select(
        tagged.alias("data_source"), F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(prefix.rstrip("\n")), F.col(question)))).alias("prompt"),
        F.struct(F.col(index).alias("index"), F.lit(True).alias("need_tools_kwargs"), F.col(question).alias("question"), F.lit(split).alias("split"), F.struct(F.struct(arguments.alias("create_kwargs")).alias("search")).alias("tools_kwargs")).alias("extra_info"),
    )


def unrolled_preferences(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """A preference row as two rows of prompt and response."""
    both = F.array(F.struct(F.lit("chosen").alias("kind"), F.col(chosen).alias("response")), F.struct(F.lit("rejected").alias("kind"), F.col(rejected).alias("response")))
    return df.select(prompt, F.explode(both).alias("x")).select(prompt, "x.*")


def perspectives(df: DataFrame, key: str, log: str, players: list[str]) -> DataFrame:
    """A game log as one message list for each player: its own turns assist, the others' ask."""
    seen = df.withColumn("player", F.explode(F.array(*map(F.lit, players))))
    said = F.filter(log, lambda m: m["type"] == "message")
    return seen.select(key, "player", F.transform(said, lambda m: F.struct(F.when(m["player"] == F.col("player"), "assistant").otherwise("user").alias("role"), m["message"].alias("content"))).alias("messages"))


def typed_content(text: Column | str) -> Column:
    """A text cut at media marks: parts of type text, image or video in order, empty ones dropped."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(t, r"(?=<image>|<video>)|(?<=<image>)|(?<=<video>)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def tagged_messages(text: Column | str) -> Column:
    """Messages between code, interpreter and answer tags, in order, with what stands before each."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(t, F.lit(r"(?s)(.*?<(?:code|interpreter|answer)>.*?</(?:code|interpreter|answer)>)"), F.lit(1))

    def one(p: Column) -> Column:
        tag = F.regexp_extract(p, r"<(code|interpreter|answer)>", 1)
        before, inner = F.regexp_extract(p, r"(?s)^(.*?)<(?:code|interpreter|answer)>", 1), F.regexp_extract(p, r"(?s)<(?:code|interpreter|answer)>(.*?)</", 1)
        fenced = F.regexp_extract(inner, r"(?s)```python(.*?)```", 1)
        return F.struct(
            F.when(tag == "interpreter", "tool").otherwise("assistant").alias("role"),
            X.stripped(F.when(tag == "code", before).when(tag == "answer", F.concat(before, inner)).otherwise(inner)).alias("content"),
            F.when(tag == "code", X.stripped(F.when(fenced != "", fenced).otherwise(inner))).alias("code"),
        )

    return F.transform(found, one)


def agent_records(df: DataFrame, *, source: Column, problem: Column, answer: Column, format_: str) -> DataFrame:
    """Tool-agent prompts: the answer's format is appended, the source's last part names the set."""
    return df.select(
        F.lower(F.element_at(F.split(source, "/"), -1)).alias("data_source"), F.array(message("user", F.concat(problem, F.lit(format_)))).alias("prompt"), F.lit("MATH").alias("ability"),
        F.struct(answer.cast("string").alias("ground_truth")).alias("reward_model"), F.lit("tool_agent").alias("agent_name"),
    )


def game_prompts(df: DataFrame, key: str, table: str, best: str) -> DataFrame:
    """Game states as prompts."""
    lines = F.array_join(F.transform(table, lambda r: F.array_join(r.cast("array<string>"), ",")), "\n")
    return df.select(key, F.array(message("user", F.concat(F.lit("Assign every paper.\n"), lines))).alias("prompt"), F.col(best).alias("optimal_score"))


def table_view(table: Column | str, mask: Column | str, scale: Column, columns: list[str], rows: list[str]) -> Column:
    """A player's view: unknown cells blank, known ones scaled and cut to whole numbers, with headers."""
    t, m = (F.col(x) if isinstance(x, str) else x for x in (table, mask))
    cells = F.zip_with(t, m, lambda r, k: F.zip_with(r, k, lambda v, s: F.when(s > 0, (v * scale).cast("int").cast("string")).otherwise("")))
    named = F.zip_with(F.array(*map(F.lit, rows)), cells, lambda n, r: F.concat(F.array(n), r))
    return F.concat(F.array(F.array(F.lit(""), *map(F.lit, columns))), named)


def role_lines(df: DataFrame, messages: str) -> DataFrame:
    """The agent's view and the user's view (roles swapped) of message lists."""
    swapped = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "assistant", "user").when(m["role"] == "user", "assistant").otherwise(m["role"]).alias("role"), m["content"].alias("content")))
    return df.withColumn("agent", F.struct(F.col(messages).alias("messages"))).withColumn("user", F.struct(swapped.alias("messages")))


def reward_chain(df: DataFrame, columns: list[str], json: str, keys: list[str], out: str = "reward") -> DataFrame:
    """The first source of a reward: columns as they are present, then keys of a JSON column.

    If any row has none, no row has one.
    """
    found = [F.col(c).cast("double") for c in columns if c in df.columns] + [F.get_json_object(json, f"$.{k}").try_cast("double") for k in keys]
    valued = df.withColumn("_r", F.coalesce(*found))
    complete = valued.agg((F.count("_r") == F.count("*")).alias("_all"))
    return valued.crossJoin(F.broadcast(complete)).withColumn(out, F.when(F.col("_all"), F.col("_r"))).drop("_r", "_all")


def turn_count(info: Column, conversation: Column, decoded: Column) -> Column:
    """Turns by the game's own count, else by its conversation, else by role marks of its text."""
    return F.coalesce(F.get_json_object(info, "$.num_messages").try_cast("int"), F.size(F.from_json(conversation, schemas.CONVERSATION)), X.turns_by_marks(decoded).cast("int"))


def game_details(info: Column | str) -> Column:
    """A game's details with defaults for what its JSON lacks or where it does not parse."""
    g = F.from_json(F.col(info) if isinstance(info, str) else info, schemas.GAME_INFO)
    return F.struct(*[F.coalesce(g[n], F.lit(d)).alias(n) for n, d in (("num_messages", 0), ("completed", False), ("turn_count", 0), ("game_normalized_reward", 0.0), ("total_errors", 0))])


def chat_errors(messages: Column | str) -> Column:
    """What is wrong with a chat: too short, system not first, roles not alternating, empty content."""
    m = F.col(messages) if isinstance(messages, str) else messages
    body = F.filter(m, lambda x: x["role"] != "system")
    turned = F.forall(F.sequence(F.lit(1), F.greatest(F.size(body) - 1, F.lit(1))), lambda i: F.coalesce(F.get(body, i)["role"] != F.get(body, i - 1)["role"], F.lit(True)))
    late = F.exists(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda x: x["role"] == "system")
    return F.filter(
        F.array(
            F.when(F.size(m) < 2, "too short"), F.when(late, "system not first"), F.when(~turned, "roles do not alternate"),
            F.when(F.exists(m, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) == ""), "empty content"),
        ),
        lambda e: e.isNotNull(),
    )


def preferred_reward(df: DataFrame) -> Column:
    """The normalised reward, else the reward, else 0."""
    found = [F.col(c) for c in ("normalized_reward", "reward") if c in df.columns]
    return F.coalesce(*found, F.lit(0.0))


def proposal(message_: Column, rows: list[str], columns: list[str]) -> Column:
    """A proposal parsed into assignments: struct of ``status`` and ``pairs`` (row and column numbers).

    Only lines that start with a dash right after the header count; each names a column
    and a row by most shared words, split at the last colon.
    """
    bag = lambda s: F.array_distinct(F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"""[!-/:-@\[-`{-~]""", ""))))

    def under_header(parts: Column) -> Column:
        lines = F.filter(F.transform(parts, lambda x: X.stripped(x)), lambda x: x != "")
        bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^(?:&emsp;|&nbsp;|\s)+", ""))
        # A remark on the header's own line is part of the header.
        return let(bare, lambda b: F.when(F.trim(parts[0]) != "", F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0)))).otherwise(b))

    def dashed(bare: Column) -> Column:
        stop = F.array_position(F.transform(bare, lambda x: F.startswith(x, F.lit("-"))), False)
        return let(stop, lambda s: F.when(s > 0, F.slice(bare, F.lit(1), (s - 1).cast("int"))).otherwise(bare))

    def match(s: Column, names: list[str]) -> Column:
        scored = lambda words: F.array_max(F.array(*[F.struct(F.size(F.array_intersect(words, bag(F.lit(n)))).alias("n"), F.lit(-i).alias("i")) for i, n in enumerate(names)]))
        return let(bag(s), lambda words: let(scored(words), lambda best: F.when(best["n"] > 0, -best["i"])))

    n = len(columns)

    def judged(items: Column, pairs: Column) -> Column:
        status = (
            F.when(~F.contains(message_, F.lit("Proposal:")), "no header")
            .when(F.size(items) != n, "wrong number of lines")
            .when(F.exists(items, lambda x: ~F.contains(x, F.lit(":"))), "no colon")
            .when(F.exists(pairs, lambda p: p["row"].isNull() | p["column"].isNull()), "unknown name")
            .when(F.size(F.array_distinct(F.transform(pairs, lambda p: p["column"]))) < n, "column repeated")
            .when(F.size(F.array_distinct(F.transform(pairs, lambda p: p["row"]))) < n, "row repeated")
            .otherwise("ok")
        )
        return let(status, lambda s: F.struct(s.alias("status"), F.when(s == "ok", pairs).alias("pairs")))

    # Each step is bound once: an expression that names the one before it several times would compute it as often, and so on down.
    bare = let(F.split(F.regexp_extract(message_, r"(?s)Proposal:(.*)", 1), r"\n|<br/>"), under_header)
    items = F.transform(let(bare, dashed), lambda x: F.translate(F.regexp_replace(x, r"^[- ]+", ""), "*_`~#[](){}|\\<>", ""))
    paired = lambda i: F.transform(i, lambda x: F.struct(match(F.substring_index(x, ":", -1), rows).alias("row"), match(F.regexp_extract(x, r"^(.*):[^:]*$", 1), columns).alias("column")))
    return let(items, lambda i: let(paired(i), lambda p: judged(i, p)))


def tool_runs(df: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """Add ``run``: consecutive tool messages share one, any other message has its own."""
    w = Window.partitionBy(key).orderBy(order)
    first = F.when((F.col(role) == "tool") & (F.lag(role).over(w) == "tool"), 0).otherwise(1)
    return df.withColumn("_first", first).withColumn("run", F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")
