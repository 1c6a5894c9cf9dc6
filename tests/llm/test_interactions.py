"""The filter audit against a plain count, and the scan of texts against Python's."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rollsmith.llm import interactions
from rollsmith.llm.interactions import audit_filters, count_texts

DOCS = "doc_id long, text string, source string, part string, mask int, digest string"
LABELS = "doc_id long, quality int, toxic int, good int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def counted(texts):
    return [tuple(map(int, row)) for row in zip(*count_texts(pa.array(texts, pa.string())))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\n\t\u00a0#|\U0001f600", max_size=60), max_size=6))
def test_counts(texts):
    assert counted(texts) == [plain(t) for t in texts]


def test_counts_over_blocks(monkeypatch):
    monkeypatch.setattr(interactions, "BLOCK", 16)
    texts = ["a" * 100 + " b a b " + "a" * 100, "", None, "é " * 40, "x" * 64, "Word word " * 9 + "#"]
    assert counted(texts) == [plain(t or "") for t in texts]


def test_words_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(interactions, "_hashes", lambda data, begins, ends: np.zeros(len(begins), np.uint64))
    texts = ["a b a cc", "dd dd", "", "a"]
    assert counted(texts) == [plain(t) for t in texts]
    # Words that a polynomial modulo 2 ** 64 cannot tell apart, whatever its base.
    monkeypatch.undo()
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    assert counted([f"{one} {two} {one}"]) == [plain(f"{one} {two} {one}")]


def expected(docs, labels):
    told = {i: [any(r[j] == 1 for r in labels if r[0] == i) for j in (1, 2)] for i in {r[0] for r in labels} if i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source, *_ in docs:
        w, d, c, n, s = plain(text or "")
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 2 * n, "D": s > 0, "E": i is not None and least[text or ""] < i}
        parts[source or ""].append(({f for f, v in fails.items() if v}, *told.get(i, (False, False))))
    out = []
    for part, rows in parts.items():
        shares, mine = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                ahead = set(order[:k])
                gone = [r for r in rows if f in r[0] and not r[0] & ahead]
                shares[f] += len(gone)
                kept, again, alone = (sum(map(test, rows)) for test in (lambda r: not r[0] & (ahead | {f}), lambda r: f in r[0] and r[0] & ahead != set(), lambda r: r[0] == {f}))
                mine.append((part, "".join(order), k + 1, kept, len(gone), again, alone, sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*r[:-1], shares[r[-1]]) for r in mine]
    return sorted(out)


def test_against_a_plain_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a b", "a b", long, long, long + " #", "SHOUT " * 250, "same " * 300, long + " A" * 60, "x" * 300000 + " " + long, long]
    docs = [(i, t, ["a", "b", None, ""][i % 4], "p", 1, "d") for i, t in enumerate(texts * 4)]
    docs += [docs[4], docs[5], docs[0], (None, long, "a", "p", 1, "d"), (None, "", None, "p", 1, "d"), (-3, "SHOUT " * 250, "only", "p", 1, "d")]
    labels = [(i, i % 2, (i % 5 == 0) + 0, 0) for i in range(0, 48, 2)] + [(4, 1, 1, 0), (5, None, 1, 0), (None, 1, 1, 0), (999, 1, 1, 0), (7, 1, None, 0)]
    got = audit_filters(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == expected(docs, labels)


def test_no_documents(spark):
    assert audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
