"""LaTeX answers as trees of braces, and the one form that equal answers share."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Node = str | list

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|.", re.S)

# What is replaced, in this order, before groups are read.
REPLACED = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]
DECIMALS = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]
# Fixed value: a right-hand unit begins so.
UNIT = "\\text{ "


def tree(text: str) -> list[Node]:
    """Commands and characters in order, a group of braces as a list; a brace without its partner is a character."""
    open_: list[list[Node]] = [[]]
    for token in _TOKEN.findall(text):
        if token == "{":
            open_.append([])
        elif token == "}" and len(open_) > 1:
            group = open_.pop()
            open_[-1].append(group)
        else:
            open_[-1].append(token)
    while len(open_) > 1:
        rest = open_.pop()
        open_[-1] += ["{", *rest]
    return open_[0]


def written(nodes: list[Node]) -> str:
    """A tree as text. The stack holds what is still to be written, so groups of any depth are."""
    out, stack = [], [iter(nodes)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            if stack:
                out.append("}")
        elif isinstance(node, list):
            out.append("{")
            stack.append(iter(node))
        else:
            out.append(node)
    return "".join(out)


def braced(nodes: list[Node]) -> list[Node]:
    """The tree with the arguments of every fraction and root in braces, at every depth, and without blanks."""
    out: list[Node] = []
    todo = [(nodes, out)]
    while todo:
        source, target = todo.pop()
        source = [n for n in source if n != " "]
        at = 0

        def take() -> None:
            nonlocal at
            node, made = source[at], []
            todo.append((node if isinstance(node, list) else [node], made))
            target.append(made)
            at += 1

        while at < len(source):
            node = source[at]
            at += 1
            if isinstance(node, list):
                at -= 1
                take()
                continue
            target.append(node)
            if node == "\\sqrt" and at < len(source):
                if source[at] == "[" and "]" in source[at:]:
                    end = source.index("]", at)
                    target += source[at : end + 1]
                    at = end + 1
                if at < len(source):
                    take()
            elif node == "\\frac" and at + 1 < len(source):
                # A command's own arguments go with it: \frac\frac123 is \frac{\frac{1}{2}}{3}.
                for _ in range(2):
                    if at < len(source) and source[at] in ("\\frac", "\\sqrt"):
                        size = 3 if source[at] == "\\frac" else 2
                        source[at : at + size] = [source[at : at + size]]
                    if at < len(source):
                        take()
    return out


def nested_form(answer: str) -> str:
    """An answer without spacing, sizes, units and a leading name, fractions and roots braced at any depth."""
    text = answer.strip()
    if text.startswith("\\text{") and text.endswith("}") and len(text) > 7:
        inner = tree(text)
        if len(inner) == 2:
            text = written(inner[1]).strip()
    whole = text
    for old, new in REPLACED:
        text = text.replace(old, new)
    if UNIT in text:
        cut = text.split(UNIT)
        if len(cut) > 2:
            return whole
        text = cut[0]
    for old, new in DECIMALS:
        text = text.replace(old, new)
    if text.startswith("."):
        text = "0" + text
    name = text.split("=")
    if len(name) == 2 and len(name[0]) <= 2:
        text = name[1]
    text = written(braced(tree(text)))
    if text == "0.5":
        return "\\frac{1}{2}"
    if parts := re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", text):
        return f"\\frac{{{parts[1]}}}{{{parts[2]}}}"
    return text


def nested_latex(text: Column | str) -> Column:
    """``nested_form`` of a column; null stays null."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else nested_form(t))

    return form(F.col(text) if isinstance(text, str) else text)
