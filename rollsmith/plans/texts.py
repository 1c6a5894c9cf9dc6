"""Queries of the text functions (X1-X21) and scorers.

The given tables hold no answers, tags or game messages, so where a function needs
them they are put together from table columns, by the same rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsmith.functions import scorers as R
from rollsmith.functions import text as X
from rollsmith.plans.registry import Tables, query

E = F.expr
#: Word boundaries of SQL engines differ on letters outside ASCII; these two queries put x for them.
PLAIN = lambda: F.regexp_replace("text", "[^\\x00-\\x7F]", "x")
PLAIN_SQL = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


def _events(t: Tables, **columns: str) -> DataFrame:
    return t.events.select("event_id", *[E(v).alias(k) for k, v in columns.items()])


SAID = "concat(element_at(array('what is the score of ', 'I like ', 'Is that the paper? ', 'which reviewer fits ', 'fine. '), cast(event_id % 5 + 1 as int)), event_type, element_at(array('.', '?', '! Then? Next.'), cast(event_id % 3 + 1 as int)))"
SAID_SQL = "(['what is the score of ', 'I like ', 'Is that the paper? ', 'which reviewer fits ', 'fine. '])[1 + event_id % 5] || event_type || (['.', '?', '! Then? Next.'])[1 + event_id % 3]"


@query("x1_question_flag", f"""SELECT event_id, regexp_matches(s, '\\?') OR regexp_matches(s, '(?:^|\\s)(what|who|where|when|why|how|which|can|could|would|is|are|do|does|tell me)\\b') OR regexp_matches(s, 'score.*(for|of|between)')
OR regexp_matches(s, '(affinity|rating|preference|expertise).*(for|of|between)') OR regexp_matches(s, '(what|how).*(think|feel|rate|score)') OR regexp_matches(s, 'could you (tell|share|give)') AS asks FROM (SELECT event_id, lower({SAID_SQL}) AS s FROM events)""")  # fmt: skip
def x1(t: Tables) -> DataFrame:
    return _events(t, s=SAID).select("event_id", X.is_question("s").alias("asks"))


@query("x2_question_kind", f"""SELECT event_id, CASE WHEN regexp_matches(s, '(score|rating|affinity).*(for|of|between).*\\w+.*\\w+') THEN 'specific_cell' WHEN regexp_matches(s, '(what|which).*(reviewer|paper|assignment)') THEN 'general_query'
WHEN regexp_matches(s, '(is that|does that|would that|can you confirm)') THEN 'confirmation' WHEN contains(s, '?') THEN 'other' END AS kind FROM (SELECT event_id, lower({SAID_SQL}) AS s FROM events)""")  # fmt: skip
def x2(t: Tables) -> DataFrame:
    return _events(t, s=SAID).select("event_id", X.question_kind("s").alias("kind"))


@query("x3_public_text", """SELECT conv_id, turn, trim(regexp_replace(regexp_extract('Plan <think>a</think> [' || role || '] [message] so <THINK>hidden ' || turn || '</think>' || text, '\\[(?:message|propose|accept|reject)\\](.*)', 1, 's'), '<think>.*?</think>', '', 'gis')) AS said FROM conversations""")
def x3(t: Tables) -> DataFrame:
    message = F.concat(F.lit("Plan <think>a</think> ["), "role", F.lit("] [message] so <THINK>hidden "), F.col("turn").cast("string"), F.lit("</think>"), "text")
    return t.conversations.select("conv_id", "turn", X.public_text(message).alias("said"))


@query("x4_questions", f"""SELECT event_id, i::INT AS i, trim(list_last(string_split_regex(list_last(string_split(trim(p), chr(10))), '[.!] '))) || '?' AS question FROM (SELECT event_id, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS p FROM (
SELECT event_id, list_filter(string_split({SAID_SQL}, '?')[:-2], lambda x: trim(x) <> '') AS ps FROM events))""".replace("list_last(", "list_extract(").replace("'[.!] '))) ||", "'[.!] '), -1)) ||").replace("chr(10))), '", "chr(10)), -1), '"))  # fmt: skip
def x4(t: Tables) -> DataFrame:
    return _events(t, s=SAID).select("event_id", F.posexplode(X.questions("s")).alias("i", "question"))


TAGGED = "concat('[Message] first [', element_at(array('PROPOSE', 'accept', 'note'), cast(event_id % 3 + 1 as int)), '] ', event_type, element_at(array('...', ':', '.'), cast(event_id % 3 + 1 as int)))"
TAGGED_SQL = "'[Message] first [' || (['PROPOSE', 'accept', 'note'])[1 + event_id % 3] || '] ' || event_type || (['...', ':', '.'])[1 + event_id % 3]"


@query("x5_action_tag", f"SELECT event_id, list_extract(regexp_extract_all(lower({TAGGED_SQL}), '\\[(message|propose|accept|reject)\\]', 1), -1) AS tag FROM events")
def x5(t: Tables) -> DataFrame:
    return _events(t, s=TAGGED).select("event_id", X.action_tag("s").alias("tag"))


@query("x6_unfinished", f"SELECT event_id, suffix({TAGGED_SQL}, '...') OR suffix({TAGGED_SQL}, ':') AS unfinished FROM events")
def x6(t: Tables) -> DataFrame:
    return _events(t, s=TAGGED).select("event_id", X.unfinished("s").alias("unfinished"))


@query("x8_name_mentions", "SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3)::BIGINT AS mentions FROM documents")
def x8(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.mentions("text", ["The", "ing"]).alias("mentions"))


@query("x9_entities", f"""SELECT doc_id, len(p)::INT AS people, len(list_filter(list_distinct(regexp_extract_all(text, '\\b([A-Z][A-Za-z]*)', 1)), lambda x: NOT list_contains(list_transform(p, lambda y: split_part(y, ' ', 1)), x) AND length(x) > 2))::INT AS titles
FROM (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '\\b([A-Z][a-z]+ [A-Z][a-z]+)\\b', 1)) AS p FROM (SELECT doc_id, {PLAIN_SQL} AS text FROM documents))""")  # fmt: skip
def x9(t: Tables) -> DataFrame:
    people, titles = X.people_and_titles(PLAIN())
    return t.documents.select("doc_id", F.size(people).alias("people"), F.size(titles).alias("titles"))


@query("x10_information_units", "SELECT event_id, len(list_distinct(regexp_extract_all(s, '\\b(\\d+)\\b', 1)))::INT AS numbers, len(regexp_extract_all(s, '\\b(first|second|third|fourth|fifth|top|primary|main)\\b', 1))::INT AS rankings FROM (SELECT event_id, 'top ' || user_id || ' first, second ' || user_id || ' ' || event_id AS s FROM events)")
def x10(t: Tables) -> DataFrame:
    s = _events(t, s="concat('top ', user_id, ' first, second ', user_id, ' ', event_id)")
    return s.select("event_id", F.size(X.numbers("s")).alias("numbers"), X.rankings("s").alias("rankings"))


SOLVED = "concat('So #### ', user_id, ' or #### ', format_string('%,d', event_id * 7), element_at(array(' end', ' .', ''), cast(event_id % 3 + 1 as int)))"
SOLVED_SQL = "'So #### ' || user_id || ' or #### ' || format('{:,}', event_id * 7) || ([' end', ' .', ''])[1 + event_id % 3]"


@query("x11_hash_answer", f"SELECT event_id, replace(list_extract(regexp_extract_all(right(s, 300), '#### (-?[0-9.,]+)', 1), -1), ',', '') AS strict, coalesce(list_extract(list_filter(regexp_extract_all(right(s, 300), '(-?[0-9.,]+)', 1), lambda x: x <> '.'), -1), '.') AS flexible FROM (SELECT event_id, {SOLVED_SQL} AS s FROM events)")
def x11(t: Tables) -> DataFrame:
    return _events(t, s=SOLVED).select("event_id", X.last_hash_answer("s").alias("strict"), X.last_number("s").alias("flexible"))


@query("x12_first_hash_answer", f"SELECT event_id, replace(regexp_extract({SOLVED_SQL}, '#### (-?[0-9.,]+)', 1), ',', '') AS answer FROM events")
def x12(t: Tables) -> DataFrame:
    return _events(t, s=SOLVED).select("event_id", X.first_hash_answer("s").alias("answer"))


NORMAL_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("x13_normalized_answer", f"SELECT conv_id, turn, {NORMAL_SQL.format(PLAIN_SQL)} AS answer FROM conversations")
def x13(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.normalized_answer(PLAIN()).alias("answer"))


@query("x14_last_tagged", "SELECT conv_id, turn, trim(regexp_extract('<answer>' || role || '</answer> then <answer> ' || text || ' </answer>', '.*<answer>(.*?)</answer>', 1, 's')) AS answer, 2::BIGINT AS opened FROM conversations")
def x14(t: Tables) -> DataFrame:
    s = t.conversations.select("conv_id", "turn", F.concat(F.lit("<answer>"), "role", F.lit("</answer> then <answer> "), "text", F.lit(" </answer>")).alias("s"))
    return s.select("conv_id", "turn", X.last_tagged("s").alias("answer"), X.count_of("s", "<answer>").alias("opened"))


def _by_shape(shapes: list) -> Column:
    """One of several texts, by the event's number."""
    return F.element_at(F.array(*shapes), (F.col("event_id") % len(shapes) + 1).cast("int"))


@query("x15_last_boxed", r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '\frac{' || event_id || '}{' || user_id || '}' WHEN 1 THEN '{a}{' || event_id || '}' WHEN 2 THEN NULL WHEN 3 THEN event_id::VARCHAR WHEN 4 THEN event_type WHEN 5 THEN NULL END AS boxed FROM events""")
def x15(t: Tables) -> DataFrame:
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    shapes = [
        F.concat(F.lit("first \\boxed{1}, then $\\boxed{\\frac{"), e, F.lit("}{"), u, F.lit("}}$ {unbalanced")),
        F.concat(F.lit("\\boxed{{a}{"), e, F.lit("}} and }} more")),
        F.concat(F.lit("never closed \\boxed{{"), e, F.lit("}")),
        F.concat(F.lit("$\\boxed "), e, F.lit("$ is all")),
        F.concat(F.lit("framed \\fbox{"), F.col("event_type"), F.lit("}.")),
        F.concat(F.lit("no box, "), e),
    ]
    return t.events.select("event_id", X.last_boxed(_by_shape(shapes)).alias("boxed"))


@query("x16_final_answer", "SELECT event_id, 'frac{1}{2}+' || event_id AS answer FROM events")
def x16(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.final_answer(F.concat(F.lit("x = $frac12 + "), "event_id", F.lit(" \\text{ }meters$"))).alias("answer")).withColumn("answer", F.replace("answer", F.lit("\\text{}"), F.lit("")))


@query("x16_latex_form", "SELECT event_id, '\\frac{' || event_id || '}{' || user_id || '}' AS form FROM events")
def x16b(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.latex_form(F.concat(F.lit("k="), "event_id", F.lit("/"), "user_id")).alias("form"))


@query("x17_tool_calls", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS calls, CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN event_type END AS name,
CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN event_id::VARCHAR END AS argument, CASE event_id % 4 WHEN 0 THEN 'go  on' WHEN 1 THEN event_type || chr(10) WHEN 2 THEN 'plain ' || user_id ELSE '<tool_call>open ' || event_id END AS content FROM events""")  # fmt: skip
def x17(t: Tables) -> DataFrame:
    e, u, kind = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    shapes = [
        F.concat(F.lit('go <tool_call>{"name": "search", "arguments": {"q": '), u, F.lit("}}</tool_call><tool_call>{broken</tool_call> on")),
        F.concat(F.lit('<tool_call>\n{"name": "'), kind, F.lit('", "arguments": {"q": "'), e, F.lit('"}}\n</tool_call>'), kind, F.lit('\n<tool_call>{"arguments": {}, "name": "b"}</tool_call>')),
        F.concat(F.lit('<tool_call>{"name": "no arguments"}</tool_call>plain '), u),
        F.concat(F.lit("<tool_call>open "), e),
    ]
    calls, rest = X.tool_calls(_by_shape(shapes))
    return t.events.select("event_id", F.size(calls).alias("calls"), F.get(calls, F.lit(0))["name"].alias("name"), F.get_json_object(F.get(calls, F.lit(0))["arguments"], "$.q").alias("argument"), rest.alias("content"))


@query("x18_fenced_code", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'print(' || event_id || ')' WHEN 1 THEN chr(10) || 'x = ' || user_id || chr(10) WHEN 2 THEN 'only ' || event_type ELSE chr(10) || 'y = ' || event_id END AS code FROM events")
def x18(t: Tables) -> DataFrame:
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    shapes = [
        F.concat(F.lit("see ```python\nx``` and ```python"), F.lit("print("), e, F.lit(")``` done")),
        F.concat(F.lit("```sh\nls\n``` then ```python\nx = "), u, F.lit("\n```")),
        F.concat(F.lit("only "), F.col("event_type")),
        F.concat(F.lit("```python\ny = "), e),
    ]
    return t.events.select("event_id", X.fenced_code(_by_shape(shapes)).alias("code"))


@query("x19_first_choice", "SELECT event_id, (['A', 'B', 'C', 'D', NULL])[1 + event_id % 5] AS choice FROM events")
def x19(t: Tables) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, "ABCDx")), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", X.first_choice(F.concat(F.lit("So\nanswer: $"), letter, F.lit("$ not Answer: E"))).alias("choice"))


@query("x20_turns_by_marks", "SELECT conv_id, greatest(count(*) FILTER (role = 'assistant'), count(*) FILTER (role = 'user')) AS turns FROM conversations GROUP BY conv_id")
def x20(t: Tables) -> DataFrame:
    roles = t.conversations.groupBy("conv_id").agg(F.array_join(F.collect_list("role"), " ").alias("s"))
    return roles.select("conv_id", X.turns_by_marks("s").alias("turns"))


@query("x21_ngrams", "SELECT conv_id, turn, greatest(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) - 2, 0)::INT AS n FROM conversations")
def x21(t: Tables) -> DataFrame:
    from rollsmith.operators.metrics import ngrams

    return t.conversations.select("conv_id", "turn", F.size(ngrams(X.words("text"), 3)).alias("n"))


@query("r1_routed_score", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE (event_id % 2 = 0)::INT::DOUBLE END AS score FROM events")
def r1(t: Tables) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("event_id") % 4 + 1).cast("int"))
    n = F.col("event_id").cast("string")
    solution = F.concat(pick("#### ", "so \\boxed{", "Answer: no", "\\boxed{x"), F.when(F.col("event_id") % 4 == 2, F.lit("")).otherwise(n), pick("", "}", "", "}"))
    return t.events.select("event_id", R.routed(pick("openai/gsm8k", "lighteval/MATH", "aime_2024", "HuggingFaceH4/MATH-500"), solution, n).alias("score"))


@query("r2_hash_score", f"SELECT event_id, CASE WHEN replace(list_extract(regexp_extract_all(s, '#### (-?[0-9.,]+)', 1), -1), ',', '') = (user_id * 49)::VARCHAR THEN 1.0 ELSE 0.1 END AS score FROM (SELECT event_id, user_id, {SOLVED_SQL} AS s FROM events)")
def r2(t: Tables) -> DataFrame:
    return _events(t, s=SOLVED, truth="cast(user_id * 49 as string)").select("event_id", R.hash_answer(F.col("s"), F.col("truth"), format_score=0.1).alias("score"))


@query("r3_boxed_score", "SELECT event_id, (event_id % 3 = 0)::INT::DOUBLE AS score FROM events")
def r3(t: Tables) -> DataFrame:
    solution = F.concat(F.lit("thus $\\boxed{\\dfrac12 + \\left("), (F.col("event_id") % 3).cast("string"), F.lit("\\right)}$"))
    return t.events.select("event_id", R.boxed_math(solution, F.lit("\\frac{1}{2}+(0)")).alias("score"))


@query("r4_named_answer", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE -1.0 END AS score, CASE WHEN event_id % 4 = 1 THEN 1.0 ELSE -1.0 END AS strict FROM events")
def r4(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 4).cast("string")
    return t.events.select("event_id", R.named_answer(F.concat(F.lit("answer: 7\nAnswer: $1,00"), n, F.lit("$ dollars")), F.lit("1000")).alias("score"), R.strict_box(F.concat(F.lit("\\boxed{"), n, F.lit("}")), F.lit("1")).alias("strict"))


@query("r5_exact_match", "SELECT item_id, (item_id % 2 = 0)::INT::DOUBLE AS score FROM benchmark")
def r5(t: Tables) -> DataFrame:
    golds = F.array(F.lit("another"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" more"))))
    s = F.concat(F.lit("<answer>no</answer><answer>The "), "text", F.lit("</answer>"))
    return t.benchmark.select("item_id", R.exact_match(s, golds).alias("score"))


@query("r6_contains_match", f"SELECT doc_id, (contains({NORMAL_SQL.format('text')}, 'and of') OR contains({NORMAL_SQL.format('text')}, 'de la'))::INT::DOUBLE AS score FROM documents")
def r6(t: Tables) -> DataFrame:
    s = F.concat(F.lit("<answer>"), "text", F.lit("</answer>"))
    return t.documents.select("doc_id", R.contains_match(s, F.array(F.lit("And, of!"), F.lit("De la"))).alias("score"))


@query("r7_geometry", "SELECT event_id, round(0.9 * (event_id % 2 = 0)::INT + 0.1 * (event_id % 3 = 0)::INT, 6) AS score FROM events")
def r7(t: Tables) -> DataFrame:
    s = F.concat(F.when(F.col("event_id") % 3 == 0, "<think>x</think>").otherwise(""), F.lit("\\boxed{"), (F.col("event_id") % 2).cast("string"), F.lit("}"))
    return t.events.select("event_id", F.round(R.geometry(s, F.lit("0")), 6).alias("score"))


@query("r8_graded_math", "SELECT event_id, (event_id % 4 IN (0, 1))::INT::DOUBLE AS score FROM events")
def r8(t: Tables) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", R.graded_math(pick("(1, 2.50)", "1/2", "[1,2.5]", "3.0"), pick("(1,2.5)", "\\frac12", "(1,2.5)", "3")).alias("score"))


@query("r9_tests_passed", "SELECT user_id, count(*) FILTER (value > 50 AND rn <= 10) / 10.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id")
def r9(t: Tables) -> DataFrame:
    results = t.events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", (F.col("value") > 50).alias("ok")))), lambda x: x["ok"]).alias("results"))
    return results.select("user_id", R.tests_passed(F.col("results")).alias("score"))


@query("r10_multiple_choice", "SELECT event_id, (event_id % 5 = 1)::INT::DOUBLE AS score FROM events")
def r10(t: Tables) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, "ABCDx")), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", R.multiple_choice(F.concat(F.lit("Answer: "), letter), F.lit("B")).alias("score"))


@query("r11_matching_reward", "SELECT event_id, round(coalesce(least(greatest(CASE WHEN event_id % 7 > 0 THEN value - 10 END / greatest(user_id - 5, 1e-6), 0), 1), 0), 9) AS score FROM events")
def r11(t: Tables) -> DataFrame:
    reward = F.when(F.col("event_id") % 7 > 0, F.col("value") - 10)
    return t.events.select("event_id", F.round(R.matching_reward(reward, (F.col("user_id") - 5).cast("double")), 9).alias("score"))


@query("r12_error_penalty", "SELECT event_id, round(greatest(value / 100 - (event_id % 5) * 0.1, 0), 9) AS score FROM events")
def r12(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(R.error_penalty(F.col("value") / 100, F.col("event_id") % 5, 0.1), 9).alias("score"))


@query("r13_overlong_penalty", "SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / 1000.0 * 0.5, 0), 9) AS score FROM documents")
def r13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(R.overlong_penalty(F.col("n_chars"), 4000, 1000, 0.5), 9).alias("score"))


@query("r14_assignment_score", "SELECT vec_id, round(embedding[1]::DOUBLE + embedding[10]::DOUBLE + embedding[19]::DOUBLE, 6) AS score FROM embeddings")
def r14(t: Tables) -> DataFrame:
    table = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, F.lit(8)))
    pairs = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(i).alias("col")) for i in range(3)])
    return t.embeddings.select("vec_id", F.round(R.assignment_score(table, pairs), 6).alias("score"))


@query("r15_pooled_best")
def r15(t: Tables) -> DataFrame:
    square = lambda f: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda r: F.transform(F.slice("embedding", r * 5 + 1, F.lit(5)), f))
    known = square(lambda x: (x > 0).cast("int"))
    return t.embeddings.select("vec_id", R.pooled_best(square(lambda x: F.round(x * 100).cast("double")), known, square(lambda x: (x < -0.1).cast("int"))).alias("best"))


@query("r16_score_by_split", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE value / 100 END AS score FROM events")
def r16(t: Tables) -> DataFrame:
    split = F.when(F.col("event_id") % 10 == 0, "test").otherwise("train")
    return t.events.select("event_id", R.by_split(split, R.hash_answer(F.concat(F.lit("#### "), "user_id"), F.col("user_id").cast("string")), F.col("value") / 100).alias("score"))
