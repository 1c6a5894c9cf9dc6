"""Text functions of dialogue analysis and answer extraction, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a question, and the kinds of questions in order of precedence.
QUESTION_PATTERNS = [
    r"\?",
    r"(?:^|\s)(what|who|where|when|why|how|which|can|could|would|is|are|do|does|tell me)\b",
    r"score.*(for|of|between)",
    r"(affinity|rating|preference|expertise).*(for|of|between)",
    r"(what|how).*(think|feel|rate|score)",
    r"could you (tell|share|give)",
]
QUESTION_KINDS = [
    ("specific_cell", r"(score|rating|affinity).*(for|of|between).*\w+.*\w+"),
    ("general_query", r"(what|which).*(reviewer|paper|assignment)"),
    ("confirmation", r"(is that|does that|would that|can you confirm)"),
]
ACTIONS = ["message", "propose", "accept", "reject"]
QUALIFIERS = ["best", "highest", "strong", "top", "excellent", "good", "great", "weak", "low", "poor", "decent", "solid", "very", "high", "clear"]
RANKING_WORDS = ["first", "second", "third", "fourth", "fifth", "top", "primary", "main"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """Runs without white space; an empty or blank text has none."""
    bare = F.btrim(_c(text), F.lit(" \t\n\r\f\x0b"))
    return F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, r"\s+"))


def is_question(text: Column | str) -> Column:
    low = F.lower(F.trim(_c(text)))
    return F.coalesce(reduce(lambda a, p: a | low.rlike(p), QUESTION_PATTERNS[1:], low.rlike(QUESTION_PATTERNS[0])), F.lit(False))


def question_kind(text: Column | str) -> Column:
    low = F.lower(F.trim(_c(text)))
    found = F.when(F.length(_c(text)) == 0, None)
    for name, pattern in QUESTION_KINDS:
        found = found.when(low.rlike(pattern), name)
    return found.when(F.contains(_c(text), F.lit("?")), "other")


def public_text(message: Column | str) -> Column:
    """What follows the first action tag, without thoughts; a thought that does not close stays."""
    after = F.regexp_extract(_c(message), r"(?s)\[(?:" + "|".join(ACTIONS) + r")\](.*)", 1)
    return stripped(F.regexp_replace(after, r"(?is)<think>.*?</think>", ""))


def questions(text: Column | str, most: int = 500) -> Column:
    """The last sentence before each question mark."""
    parts = F.split(_c(text), r"\?")
    ended = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s+", " "))) > 0)
    line = lambda p: F.element_at(F.split(stripped(p), "\n"), -1)
    sentence = lambda p: F.element_at(F.split(line(p), r"[.!] "), -1)
    return F.transform(ended, lambda p: F.substring(F.concat(F.trim(sentence(p)), F.lit("?")), 1, most))


def action_tag(message: Column | str) -> Column:
    """The last action tag of a message, in lower case; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(F.lower(_c(message)), F.lit(r"\[(" + "|".join(ACTIONS) + r")\]"), F.lit(1)), F.lit(-1))


def unfinished(message: Column | str) -> Column:
    return F.endswith(_c(message), F.lit("...")) | F.endswith(_c(message), F.lit(":"))


def mentions(text: Column | str, names: list[str]) -> Column:
    """How often names stand in a text, ignoring case and without overlaps."""
    low = F.lower(_c(text))
    one = lambda n: ((F.length(low) - F.length(F.replace(low, F.lit(n.lower()), F.lit("")))) / len(n)).cast("long")
    return reduce(lambda a, n: a + one(n), names[1:], one(names[0])) if names else F.lit(0).cast("long")


def people_and_titles(text: Column | str) -> tuple[Column, Column]:
    """Names of two capitalised words, and capitalised words over two letters that begin no such name."""
    people = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), F.lit(1)))
    firsts = F.transform(people, lambda p: F.split_part(p, F.lit(" "), F.lit(1)))
    titles = F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b([A-Z][A-Za-z]*)"), F.lit(1)))
    return people, F.filter(F.array_except(titles, firsts), lambda t: F.length(t) > 2)


def numbers(text: Column | str) -> Column:
    """The distinct whole numbers of a text."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\b(\d+)\b"), F.lit(1)))


def rankings(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"\b(" + "|".join(RANKING_WORDS) + r")\b"), F.lit(1)))


def qualifiers_near(text: Column | str, start: Column, end: Column, around: int = 50) -> Column:
    """The qualifying words within some characters around a stretch of a text."""
    a = F.greatest(start - around, F.lit(0))
    near = F.substring(F.lower(_c(text)), a + 1, end + around - a)
    return F.filter(F.array(*map(F.lit, QUALIFIERS)), lambda q: F.contains(near, q))


def last_hash_answer(text: Column | str, clip: int = 300) -> Column:
    """The last number after four hashes near the end, without commas and dollar signs."""
    found = F.regexp_extract_all(F.right(_c(text), F.lit(clip)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.replace(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))


def last_number(text: Column | str, clip: int = 300) -> Column:
    """The last number near the end that is more than a dot; the first candidate if all are dots."""
    found = F.regexp_extract_all(F.right(_c(text), F.lit(clip)), F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    real = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(real, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def first_hash_answer(text: Column | str) -> Column:
    found = F.regexp_extract(_c(text), r"#### (-?[0-9.,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))


def normalized_answer(text: Column | str) -> Column:
    """Lower case, without ASCII punctuation, articles and spare white space, in this order."""
    low = F.regexp_replace(F.lower(_c(text)), r"""[!-/:-@\[-`{-~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\b(a|an|the)\b", " "), r"\s+", " "))


def last_tagged(text: Column | str, tag: str = "answer") -> Column:
    found = F.regexp_extract_all(_c(text), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return stripped(F.try_element_at(found, F.lit(-1)))


def count_of(text: Column | str, needle: str) -> Column:
    """How often a string stands in a text, without overlaps."""
    return ((F.length(_c(text)) - F.length(F.replace(_c(text), F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def last_boxed(text: Column | str) -> Column:
    r"""The content of the last balanced ``\boxed{...}`` (or ``\fbox{...}``), or what follows ``\boxed`` and a blank."""
    t = _c(text)
    spaced = F.when(F.contains(t, F.lit("\\boxed ")), F.substring_index(F.substring_index(t, "\\boxed ", -1), "$", 1))
    tail = F.when(F.contains(t, F.lit("\\boxed")), F.substring_index(t, "\\boxed", -1)).when(F.contains(t, F.lit("\\fbox")), F.substring_index(t, "\\fbox", -1))
    # Characters up to the brace that closes the first one: depth, whether it is closed, and their number.
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.lit(0).alias("n"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(a["closed"], a).otherwise(F.struct(depth.alias("depth"), ((c == "}") & (depth == 0)).alias("closed"), (a["n"] + 1).alias("n")))

    end = F.aggregate(F.split(tail, ""), start, step)
    inner = F.when(end["closed"] & F.startswith(tail, F.lit("{")), F.substring(tail, F.lit(2), end["n"] - 2))
    return F.coalesce(spaced, inner)


# What is replaced and what is dropped in a final answer.
ANSWER_REPLACED = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
ANSWER_DROPPED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals",
    "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def final_answer(text: Column | str) -> Column:
    """A final answer reduced for comparison: units and wrappers dropped, fractions and roots braced."""
    t = F.substring_index(_c(text), "=", -1)
    for old, new in [*ANSWER_REPLACED, *((x, "") for x in ANSWER_DROPPED)]:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"^([^\n]*?)\$([^\n]*?)\$([^\n]*)", r"\$$2\$")
    for wrapper in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, rf"\\{wrapper}\{{([^\n]*?)\}}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{([^\n]*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    bare = F.replace(t, F.lit(","), F.lit(""))
    return F.trim(F.when(bare.rlike(r"^\d+$"), bare).otherwise(t))


def latex_form(text: Column | str) -> Column:
    """A LaTeX answer in one form: no spacing, units or sizes, braced fractions and roots, a/b as a fraction."""
    t = _c(text)
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.substring_index(t, "\\text{ ", 1)
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"^[^=]{0,2}=([^=]*)$", "$1")
    t = F.replace(F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    t = F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"\\frac([^{])\{", r"\\frac{$1}{")
    t = F.when(t == "0.5", "\\frac{1}{2}").otherwise(t)
    return F.regexp_replace(t, r"^(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))$", r"\\frac{$1}{$2}")


TOOL_CALL = "struct<name:string,arguments:string>"


def tool_calls(text: Column | str) -> tuple[Column, Column]:
    """Well-formed tool calls of a message, and the text without their marks; broken ones are dropped."""
    raw = F.regexp_extract_all(_c(text), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(raw, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull()), F.regexp_replace(_c(text), r"(?s)<tool_call>.*?</tool_call>", "")


def fenced_code(text: Column | str, language: str = "python") -> Column:
    """What the last fence of a language holds; the text itself where there is none."""
    return F.substring_index(F.substring_index(_c(text), f"```{language}", -1), "```", 1)


def first_choice(text: Column | str) -> Column:
    found = F.regexp_extract(_c(text), r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when(found != "", F.upper(found))


def turns_by_marks(text: Column | str, first: str = "assistant", second: str = "user") -> Column:
    """Turns counted by role marks: the larger of two counts."""
    return F.greatest(count_of(text, first), count_of(text, second))


def cleaned(text: Column | str) -> Column:
    """Trimmed, titles as sentences, bracketed notes dropped, double blanks halved once."""
    t = F.replace(F.trim(_c(text)), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(t, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))
