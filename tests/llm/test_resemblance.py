"""Near-duplicates by similarity, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("rollsmith.llm")
from rollsmith.llm import resemblance  # noqa: E402


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, rng, least, most):
    """``words`` with single words replaced until their similarity lies within the bounds."""
    out, own = list(words), shingles(" ".join(words))
    while similarity(own, shingles(" ".join(out))) > most:
        before = list(out)
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
        if similarity(own, shingles(" ".join(out))) < least:
            out = before
    return " ".join(out)


def brute(texts):
    sets, parent = [shingles(t or "") for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("direct", [32, 3])
def test_pipeline_keeps_one_of_each_group_alike(spark, direct, monkeypatch):
    from corpus_pipeline import deduplicate

    monkeypatch.setattr(resemblance, "DIRECT", direct)
    monkeypatch.setattr(resemblance, "PAIRS", 5)
    rng = random.Random(3)
    texts = [None, " ", "", "one two", "One  TWO", "one three"]
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(120, 300))]
        texts += [" ".join(words), edited(words, rng, 0.8, 0.84), edited(words, rng, 0.8, 0.84).upper(), edited(words, rng, 0.7, 0.76), " ".join(words[: len(words) // 2])]
    words = [f"v{rng.randrange(5000)}" for _ in range(200)]
    texts += [edited(words, rng, 0.8, 0.95) for _ in range(40)] + [edited(words, rng, 0.6, 0.8) for _ in range(10)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["doc_id"] for r in deduplicate(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts) and len(got) < len(texts) - 80
    assert deduplicate(spark, docs.where("false"), "").count() == 0


def test_pairs_at_the_limit_share_a_key():
    rng = random.Random(5)
    found = total = 0
    for _ in range(300):
        words = [f"w{rng.randrange(9000)}" for _ in range(250)]
        pair = [resemblance.shingle_set(t.encode()) for t in (" ".join(words), edited(words, rng, 0.8, 0.83))]
        least = np.array([resemblance.least_hashes(s) for s in pair])
        sketch, keys = resemblance.sketches(least), resemblance.band_keys(least)
        total += 1
        found += bool((keys[0] == keys[1]).any() and resemblance.differing(sketch[0], sketch[1]) <= resemblance.DIFFER)
    assert found >= 0.99 * total


def test_groups_come_whole_or_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    for slab in (3, 8, 1000):
        monkeypatch.setattr(resemblance, "SLAB", slab)
        for _ in range(60):
            keys = np.sort(np.array([rng.choice([-5, 0, 1, 2, 3, 9, 9, 9, 9, *range(20, 60)]) for _ in range(rng.randrange(80))], np.int64))
            cuts = sorted(rng.randrange(len(keys) + 1) for _ in range(rng.randrange(8)))
            parts = zip([0, *cuts], [*cuts, len(keys)])
            batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(np.arange(a, b))], names=["key", "x"]) for a, b in parts]
            got, wanted = {}, {k: np.flatnonzero(keys == k).tolist() for k in set(keys.tolist())}
            for whole, (k, x) in resemblance._groups(iter(batches), ["key", "x"]):
                assert len(set(k.tolist())) == 1 and (len(x) > 1 or not whole)
                got.setdefault(int(k[0]), []).append((whole, x.tolist()))
            for k, members in wanted.items():
                if len(members) > 1:
                    assert sorted(sum((x for _, x in got[k]), [])) == members
                    assert [w for w, _ in got[k]] == ([True] if len(got[k]) == 1 and got[k][0][0] else [False] * len(got[k]))
            assert {k for k, m in wanted.items() if len(m) > 1} >= {k for k, parts_ in got.items() if any(w for w, _ in parts_)}


@pytest.mark.parametrize("side", [1 << 20, 4000])
def test_large_group_of_nearly_alike_texts(spark, side, monkeypatch):
    """Some 300 edited copies of one text, between 0.55 and 0.9 alike to one another, in one block and in many."""
    monkeypatch.setattr(resemblance, "SIDE", side)
    monkeypatch.setattr(resemblance, "OTHER", 2 * side)
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(140)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for _ in range(60):  # far from the base, so that most stay alone
        words = list(base)
        for _ in range(9):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join([*words[:-1], "z"])] if rng.random() < 0.5 else [" ".join(words)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r["doc_id"] for r in resemblance.keep_one_alike(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts) and 1 < len(got) < 200


def test_repeated_rows_and_unknown_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, a, "x"), (2, a + " c", "y"), (None, a, "z"), (None, b, "u"), (None, b, "u"), (5, None, "v"), (4, "", "w"), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["row"]) for r in resemblance.keep_one_alike(docs).collect())
    assert got == [(0, b, "u"), (1, a, "x"), (4, "", "w")]
