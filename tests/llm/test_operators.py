"""The operators of the llm subpackage: brute force, round trips, and edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rollsmith.llm import additive, chat, common, components, html, language, licenses, maxscore, mixing, packing, quality, simhash, vectors
from rollsmith.llm.common import TextBuffer

LOW = {c: c + 32 for c in range(65, 91)}
SHAPE = "doc_id long, text string, lang string, source string, score double, id long, bin long, offset long, label string, extra string"
ODD = ["", None, " \n\t ", "a", "Été à l'école ÀÇ ß œ Ÿ", "MIT license, cc  by CC-BY", "x" * 5000, "日本語 😀 \x85 é", "don't I'M 12,5% <|endoftext|> ...!? ½"]


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0.5, 7, 8, 9, "l", "x") for i, t, s in rows], SHAPE)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    return ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark, words):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    texts += [texts[0]] * 4 + [" ".join(texts[1].split()[:-1] + ["zz"])] + ODD + [" ".join(rng.choices(words, k=9000))]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return table(spark, [*rows, rows[3], rows[3], (None, "nobody knows", "s1"), (None, texts[0], "s1")])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def test_text_buffer_and_slices():
    buffer = TextBuffer(pa.array(["ab", None, "", "é"])[1:])
    assert buffer.data.tobytes() == "é".encode() and buffer.offsets.tolist() == [0, 0, 0, 2]
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 10] * 5})
    assert [p.num_rows for p in common.slices(batch, "t", 20)] == [2, 2, 1]


# --- chat


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, blocks int")


def test_chat_reads_back_what_was_said(spark):
    rng = random.Random(0)
    odd = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|turn|>", "[\\\\INST]", "", None, "a\n<|says|>b", "<<|", "s>", "\\", "é😀", "[/INST][INST]</s><s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|x|>"]), rng.choice(odd), "f", 1) for c in (1, 2, None) for t in [*range(150), 3, 3, None]]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chat(messages(spark, rows))).collect()}
    assert set(got) == {1, 2, None}
    for c, r in got.items():
        mine = sorted(((t is None, t or 0, role or "", text or "") for k, t, role, text, _, _ in rows if k == c))
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in mine).encode()).hexdigest()
        loss = "".join(b for _, _, a, b in mine if a == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chat(messages(spark, rows).where("turn = -5"))).count() == 0


def test_chat_spans_are_offsets_into_the_text(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"[INST]{t}😀", "f", 1) for t in range(300)]
    r = chat.format_chat(messages(spark, rows)).first()
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == [f"[\\INST]{t}😀" for t in range(1, 300, 2)]


def test_chat_parts_become_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 1.5, None), (None, "t", None, None, None, None, None), ("document", None, None, None, None, None, 2)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    r = chat.format_chat(df, parts_col="parts").first()
    assert r["formatted"] == "<|turn|>user<|says|>see <\\|image:0|><|image:1|><|audio:2|>t<|document:3|><|end|><|turn|>assistant<|says|><|end|>"
    assert [(a["turn"], a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 38), (0, 3, "document", "", 1024)]
    assert r["expanded_tokens"] == 1066


CONTROLS = ["<|turn|>", "<|says|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<\\|turn|>", "[\\\\INST]", "<|image:1|>"]


def test_no_control_string_arises_across_parts(spark):
    """Every control string, cut at every place into two text parts, alone and beside placeholders, reads back as it was."""
    blank = (None,) * 5
    image, said = ("image", None, "a.png", None, None, None, None), lambda t: ("text", t, *blank)
    rows, wanted = [], {}
    for control in CONTROLS:
        for cut in range(len(control) + 1):
            a, b = control[:cut], control[cut:]
            for parts in ([said("x" + a), said(b + ">x")], [said(a), (None, b, *blank)], [said(a), said(""), said(b)], [*map(said, control)], [image, said(a), said(b), image, said(b)], [said(a), image, said(b)], [said("<"), said(a), said(b)], [said("["), image, image, said(a), said(b)]):
                number, text = 0, ""
                for kind, t, *_ in parts:
                    number += kind == "image"
                    text += f"<|image:{number}|>" if kind == "image" else t
                c = len(wanted)
                turns = [("user", text), (control, text), ("assistant", text), (a, "ok")]
                rows += [(c, i, role, parts if i < 3 else [said("ok")]) for i, (role, _) in enumerate(turns)]
                wanted[c] = (turns, text)
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.read_back(chat.format_chat(df, parts_col="parts")).collect()
    assert len(got) == len(wanted)
    for r in got:
        turns, text = wanted[r["conv_id"]]
        assert list(zip(r["roles"], r["texts"])) == turns and r["loss_text"] == text
        assert [r["formatted"].count(m) for m in (chat.TURN, chat.SAYS, chat.END)] == [len(turns)] * 3
        assert not re.search(r"\[/?INST\]|</?s>", r["formatted"])


def test_chat_main_path_is_native(spark):
    typed = spark.createDataFrame([(1, 0, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for formatted in (chat.format_chat(messages(spark, [(1, 0, "user", "x", "f", 1)])), chat.format_chat(typed, parts_col="parts")):
        plan = chat.digests(formatted)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# --- licenses


def test_licenses_against_brute_force(spark, docs, empty):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rng = random.Random(1)
    bits = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "nc", "é", "MIT", "Version", "2", "0", "-", "\n"]
    made = [(1000 + i, rng.choice([" ", ", "]).join(rng.choices(bits, k=rng.randint(1, 60))), "s") for i in range(60)]
    both = docs.union(table(spark, made))
    got = defaultdict(list)
    for r in licenses.scan_licenses(both).collect():
        got[r["doc_id"]].append(r)
    for row in both.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (row["text"] or "").translate(LOW))
        found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        wanted = (len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found})))
        assert any((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == wanted for r in got[row["doc_id"]])
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got[row["doc_id"]])
    assert sum(map(len, got.values())) == both.count() and licenses.scan_licenses(empty).count() == 0


def test_license_bodies_need_their_key_phrases(spark):
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [(1, body, "s"), (2, body.replace("obtaining a copy", "wanting a copy"), "s"), (3, body.replace("free of charge", "at a price"), "s"), (4, "Licensed under CC BY-SA 4.0", "s")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "" and got[3][0] == "mit" and got[3][1] < 1 and got[4][0] == "cc-by,cc-by-sa"


def test_license_results_do_not_depend_on_other_rows(spark):
    cut = "zzz to use copy modify and or distribute this software for any purpose"
    rows = [(1, "foo permission", "s"), (2, cut, "s"), (3, "permission", "s"), (4, "foo", "s"), (5, cut + " with", "s")]
    pick = lambda order: {r["doc_id"]: tuple(r) for r in licenses.scan_licenses(table(spark, [rows[i] for i in order]).coalesce(1)).collect()}
    first = pick([0, 1, 2, 3, 4])
    assert 0 < first[2][-1] < 1
    for order in ([3, 1, 0, 2, 4], [4, 2, 1, 0, 3], [1, 0, 4, 3, 2], [2, 1, 4, 0, 3]):
        assert pick(order) == first


def test_whole_licenses_and_long_words(spark):
    whole = next(t for t in licenses.OWN if len(t.words) > 150)
    text = "Copyright 2020 Somebody. " + " ".join(whole.words).upper().replace(" TORT ", " WRONG ") + " the end"
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, [(1, text, "s"), (2, " ".join(whole.words[:100]), "s"), (3, "a verylongwordofalicence b", "s"), (4, "verylongwordofalicencf", "s")]), own=(whole, licenses.template("long", "verylongwordofalicence"))).collect()}
    assert got[1]["labels"] == whole.label and 0.9 < got[1]["score"] < 1 and [got[i]["labels"] for i in (2, 3, 4)] == ["", "long", ""]


def test_license_cost_goes_by_the_rarest_word_of_a_file():
    """Common key words, however often they stand in a text, propose nothing where a rarer one is asked for too."""
    templates = (licenses.template("a", "mit license"), licenses.template("b", "license of the deep"))
    vocabulary = licenses.Vocabulary(templates)
    index = licenses.Index(templates, vocabulary, {"mit": 1.0, "license": 9.0, "of": 1.0, "the": 1.0, "deep": 1.0})
    words = licenses.Words(pa.array(["license " * 200_000 + "mit license", "license " * 50, "of the deep"]), vocabulary)
    owners, found, held, position = index._candidates(licenses.Places(words))
    assert (owners.tolist(), found.tolist()) == ([0], [0])
    assert [tuple(x.tolist() for x in p) for p in index.proposals(words)] == [([0], [200_000], [0])]


def test_many_license_templates_against_brute_force(spark):
    """500 templates over shared words: exactly those stand whose key phrases are in place and whose words hold the share."""
    rng = random.Random(9)
    words = [f"l{i}" for i in range(400)]
    made = []
    for k in range(500):
        body = rng.choices(words, k=rng.randint(4, 30))
        a = rng.randrange(len(body) - 2)
        made.append(licenses.Template(f"t{k}", tuple(body), ((a, a + 2),)))
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            body = list(rng.choice(made).words)
            for _ in range(rng.randint(0, 3)):
                body[rng.randrange(len(body))] = "other"
            parts += [*body, *rng.choices(["x", "y", *words[:20]], k=rng.randint(0, 5))]
        rows.append((i, " ".join(parts), "s"))
    docs = table(spark, rows)
    total, df = licenses.document_frequencies(docs, "text", tuple(made))
    idf = {w: np.log((total + 1) / (df.get(w, 0) + 1)) + 1 for w in words}
    assert total == 60 and all(df.get(w, 0) == sum(w in r[1].split() for r in rows) for w in words)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, own=tuple(made)).collect()}
    found = 0
    for i, text, _ in rows:
        w, best, labels = text.split(), 0.0, set()
        for t in made:
            (a, b), n = t.keys[0], len(t.words)
            for s in range(len(w) - n + 1):
                if tuple(w[s + a : s + b]) == t.words[a:b]:
                    share = sum(idf[x] for j, x in enumerate(t.words) if x in w[max(0, s + j - 1) : s + j + 2]) / sum(idf[x] for x in t.words)
                    if share >= licenses.ACCEPT:
                        best, labels = max(best, share), labels | {t.label}
        found += len(labels)
        assert got[i]["labels"] == ",".join(sorted(labels)) and got[i]["score"] == pytest.approx(best)
    assert found > 60


# --- exact and approximate search


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype("f4")
    x[100:160] = x[5]
    rows = [(i, [float(v) for v in r], 0, 1.0) for i, r in enumerate(x)]
    rows += [(2000, None, 0, 1.0), (2020, [1.0, None], 0, 1.0), (2040, [float("nan")] * 16, 0, 1.0), (2060, [float("inf")] * 16, 0, 1.0), (None, [1.0] * 16, 0, 1.0), (2080, [0.0] * 16, 0, 1.0), (2100, [2.0] * 3, 0, 1.0), (2100, [2.0] * 3, 0, 1.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def valid(points, drop_zero=False):
    """The rows that take part, as (id, vector); an id may have several."""
    out = []
    for r in points.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and not (drop_zero and not any(v)):
            out.append((r["vec_id"], np.pad(np.array(v, float), (0, 16 - len(v)))))
    return out


def best_pairs(known, q, k):
    """The best pairs of a query id's rows and rows of other ids, as (id, score)."""
    pairs = [(i, v @ w) for n, w in known if n == q for i, v in known if i != q]
    return sorted(pairs, key=lambda x: (-round(float(x[1]), 9), x[0]))[:k]


def test_exact_search_against_brute_force(points, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 128)
    got = defaultdict(list)
    for r in maxscore.exact_search(points, vectors.every("id", 20)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    known = [(k, np.floor(1024 * v).astype(int)) for k, v in valid(points)]
    assert set(got) == {k for k, _ in known if k % 20 == 0}
    for q, found in got.items():
        assert found == best_pairs(known, q, 10)
    assert maxscore.exact_search(points.where("vec_id < 0"), vectors.every("id", 20)).count() == 0
    assert maxscore.exact_search(points.where("vec_id < 3"), vectors.every("id", 1)).count() == 6


def test_exact_search_of_huge_components(spark):
    df = spark.createDataFrame([(0, [3e30, 1.0]), (1, [1e30, 0.0]), (2, [-2e30, 5.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in maxscore.exact_search(df, vectors.every("id", 100)).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (3, got[1][1]), (2, -(1 << 63))]


def test_exact_search_with_outliers(spark, monkeypatch):
    """Vectors with huge components in a shard and among the queries, against Python's integers."""
    monkeypatch.setattr(vectors, "SHARD", 64)
    rng = np.random.default_rng(3)
    x = [[float(v) for v in r] for r in rng.normal(size=(400, 6))]
    x[17], x[40], x[101], x[200] = [1e306, 1.0, 0.0, 0.0, 0.0, 0.0], [3e14, *[0.25] * 5], [-1e306, *[-0.5] * 5], [1e5, -1e7, 1e6, 3.0, 0.1, 2e12]
    x[300] = [-1e306, 1.0]
    whole = [[int(math.floor(1024 * v)) if abs(v) < 1e300 else 1024 * int(v) for v in r] for r in x]
    got = defaultdict(list)
    for r in maxscore.exact_search(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), vectors.every("id", 20)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    hold = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q, found in got.items():
        exact = [(hold(sum(a * b for a, b in zip(whole[q], r))), i) for i, r in enumerate(whole) if i != q]
        assert found == [(i, s) for s, i in sorted(exact, key=lambda e: (-e[0], e[1]))[:10]]


def test_nearest_over_many_shards(spark, monkeypatch):
    """At least 40 shards in a grid of tasks: recall where a query's best estimates over all are reranked."""
    monkeypatch.setattr(vectors, "SHARD", 100)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "HELD", 2 * 32 * 8 * 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(50, 32))
    x = centres[rng.integers(0, 50, 4000)] + 0.6 * rng.normal(size=(4000, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in additive.nearest(df, vectors.every("id", 20), rerank=100).collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(found) & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 200 and hits / (20 * len(got)) >= 0.9


def test_nearest_recall_and_scores(points, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 256)
    known = valid(points, drop_zero=True)
    got = defaultdict(list)
    for r in additive.nearest(points, vectors.every("id", 20), rerank=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {k for k, _ in known if k % 20 == 0}
    hits = 0
    for q, found in got.items():
        hits += sum((Counter(k for k, _ in found) & Counter(k for k, _ in best_pairs(known, q, 20))).values())
        assert all(any(s == pytest.approx(float(v @ w)) for n, w in known if n == q for i, v in known if i == k) for k, s in found) and len(found) == 20
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits / (20 * len(got)) >= 0.9
    assert additive.nearest(points.where("vec_id < 0"), vectors.every("id", 20)).count() == 0


def test_copies_of_a_vector_come_by_their_ids(points):
    found = [r["vec_id"] for r in additive.nearest(points, F.col("id") == 5).orderBy("rank").collect()]
    assert found == list(range(100, 120))


# --- mixing


def words_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_sizes_targets_and_bounds(docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = docs.select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += words_of(r["text"])
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(words_of(r["text"]) for r in rows if r["source"] == s)
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix_report(docs).collect()))
    assert mixing.mix_report(empty).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(docs).count() == sum(r["copies"] for r in got)


def test_mix_counts_words(spark):
    texts = ["", None, " a", "a\x0bb\tc\r\n", "é\xa0é x", "a"]
    got = sorted((r["id"], r["size"]) for r in mixing.sized(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect())
    assert got == [(i, words_of(t)) for i, t in enumerate(texts)]


# --- quality and language


def test_quality_learns_and_scores_whole_texts(spark, words):
    rng = random.Random(8)
    good = [" ".join(rng.choices(words, k=rng.randint(20, 150))) + "." for _ in range(240)]
    bad = [" ".join(w + rng.choice(["!!", "%%%", "###"]) for w in rng.choices(words, k=rng.randint(20, 150))) for _ in range(240)]
    late = " ".join(rng.choices(words, k=4000)) + " " + " ".join([*bad[:40]])
    rows = [(i, t, "s") for i, t in enumerate([*good, *bad])]
    docs = table(spark, [*rows, (900, None, "s"), (901, "", "s"), (902, late, "s"), (None, "x", "s"), rows[0]])
    labels = spark.createDataFrame([(i, int(i < 240), "z") for i in range(480)] + [(None, 1, "z"), (5, None, "z")], "doc_id long, quality int, text string")
    held = common.id_remainder("doc_id", 5) == 0
    model = quality.fit_quality_model(docs, labels, ~held)
    got = {r["doc_id"]: r for r in quality.predict_quality(docs, model).select("*", F.coalesce(held, F.lit(False)).alias("held")).collect()}
    test = [i for i in range(480) if got[i]["held"]]
    assert 60 < len(test) < 140 and sum((got[i]["predicted"] == 1) == (i < 240) for i in test) / len(test) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and 901 in got
    assert got[902]["score"] < got[0]["score"]  # what is wrong at the very end counts
    assert quality.keep_quality(docs, model).columns == docs.columns
    assert quality.predict_quality(docs.where("doc_id < 0"), model).count() == 0
    unknown = quality.fit_quality_model(docs, labels.where("quality = 5"), ~held)
    assert {r["score"] for r in quality.predict_quality(docs, unknown).collect()} == {0.5}


def test_quality_score_does_not_depend_on_neighbours():
    model = quality.QualityModel()
    model.fitted = True
    texts = ["a b c", "", "x" * 5000, "é" * 300, "q" * 124, "w" * 128]
    together = model.score(pa.array(texts))
    assert together == pytest.approx([float(model.score(pa.array([t]))[0]) for t in texts], abs=1e-5)


def plain_quality(model, text):
    """The network on one text, window by window."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    units = -(-(len(text) + quality.STRIDE) // quality.UNIT)
    data = text + b"\0" * (units * quality.UNIT - len(text))
    block = lambda i: w["embed"][list(data[i : i + quality.STRIDE])].ravel()
    pooled = []
    for u in range(units):
        windows = []
        for i in range(u * quality.UNIT, (u + 1) * quality.UNIT, quality.STRIDE):
            far = block(i + quality.STRIDE) @ w["far"] if i + quality.STRIDE < len(data) else 0
            windows.append(block(i) @ w["near"] + far)
        pooled.append(np.max(windows, axis=0))
    chunks = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:])] or pooled
    hidden = np.maximum(np.array(chunks) @ w["hidden"] + w["hidden_bias"], 0)
    logit = np.concatenate((hidden.mean(axis=0), hidden.max(axis=0))) @ w["out"] + w["out_bias"]
    return float(1 / (1 + np.exp(-logit[0])))


def test_quality_scores_as_the_plain_network(monkeypatch):
    model, rng = quality.QualityModel(seed=4), random.Random(1)
    model.fitted = True
    sizes = [0, 1, *(quality.UNIT * k + d for k in (1, 2, 3, 4, 6) for d in (-5, -4, -3, -1, 0, 1)), 3000]
    texts = ["".join(rng.choices("ab c\n\0", k=n)) for n in sizes]
    wanted = [plain_quality(model, t.encode()) for t in texts]
    assert model.score(pa.array(texts)) == pytest.approx(wanted, abs=1e-5)
    for run in (1, 2, 3, 64):  # the same in runs of units, long and short texts mixed
        monkeypatch.setattr(quality, "RUN", run)
        monkeypatch.setattr(quality, "PIECE", 200)
        assert model.score(pa.array([*texts, None])) == pytest.approx([*wanted, wanted[0]], abs=1e-5)


def test_quality_of_a_very_long_text_in_bounded_memory():
    code = (
        "import resource, numpy as np, pyarrow as pa; from rollsmith.llm.quality import QualityModel; m = QualityModel(seed=4); m.fitted = True; "
        "t = pa.array([b'some words. ' * ((64 << 20) // 12)], pa.large_binary()); "
        "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; s = m.score(t); print(s[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) / 1024)"
    )
    score, more = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert 0 <= score <= 1 and more < 500


def test_quality_gradients():
    model = quality.QualityModel(seed=1)
    layout = quality.Layout(TextBuffer(pa.array(["the cat sat " * 40, "dog!! " * 7, ""])))
    y, w = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    _, g = model.gradients(layout, y, w)
    for name in ("near", "far", "hidden", "out", "embed"):
        a = model.weights[name]
        at = np.unravel_index(np.abs(g[name]).argmax(), a.shape)
        held, step = a[at], 1e-2
        a[at] = held + step
        up, _ = model.gradients(layout, y, w)
        a[at] = held - step
        down, _ = model.gradients(layout, y, w)
        a[at] = held
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=0.15, abs=2e-3)


def test_language_learns_and_rejects(spark):
    rng = random.Random(3)
    kinds = {"xx": ["ba", "do", "lu", "mi"], "yy": ["schr", "ung", "pf", "tz"], "zz": ["ñe", "ció", "íl", "ue"]}
    rows = []
    for i in range(360):
        k = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(kinds[k], k=3)) for _ in range(rng.randint(5, 80))), k))
    extra = [(500, None, "xx"), (501, "", "xx"), (502, "12 34 !!", "yy"), (503, "日本", None), (None, "bado", "xx"), rows[0]]
    docs = spark.createDataFrame([(i, t, lang, 1.0, "p") for i, t, lang in [*rows, *extra]], "doc_id long, text string, lang string, score double, lang_pred string")
    held = F.coalesce(common.id_remainder("doc_id", 4) == 2, F.lit(False))
    model = language.fit_language_model(docs, ~held)
    assert model.languages == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r for r in language.predict_language(docs, model).select("*", held.alias("held")).collect()}
    test = [(i, k) for i, _, k in rows if got[i]["held"]]
    assert len(test) > 50 and sum(got[i]["lang_pred"] == k for i, k in test) / len(test) > 0.97
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[503]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id in (500, 501, 502)").count() == 0
    assert language.predict_language(docs.where("doc_id < 0"), model).count() == 0
    none = language.fit_language_model(docs, F.lit(False))
    assert {r["lang_pred"] for r in language.predict_language(docs, none).collect()} == {"und"}


def test_language_gradients_through_time():
    model = language.LanguageModel(["a", "b"], seed=2)
    rng = np.random.default_rng(0)
    x, label = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 2, 5)
    valid_ = (rng.random((6, 5)) < 0.8).astype(np.float32)
    _, g = model.gradients(x, label, valid_)
    for name, grad in g.items():
        a = model.weights[name]
        at = np.unravel_index(np.abs(grad).argmax(), a.shape)
        held, step = a[at], 1e-2
        a[at] = held + step
        up, _ = model.gradients(x, label, valid_)
        a[at] = held - step
        down, _ = model.gradients(x, label, valid_)
        a[at] = held
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.05, abs=1e-4)


# --- HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=4><li>c<li value=9>d</ol></ul>", "- a\n- b\n  4. c\n  9. d"), ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"), ("<p hidden>a</p><p style='display: none'>b</p>c<script>d</script><style>e</style><!-- f -->", "c"),
        ("<title>t</title><body>b", "b"), ("<pre> a\n  b</pre>", " a\n  b"), ("1 < 2 > 0 &lt;b&gt;", "1 < 2 > 0 <b>"), ("<a href='x>y'>z</a></b></p>", "z"), ("<b>x<p>y</b>z", "x\n\nyz"),
        ("<dl><dt>a<dd>b</dl>", "a\n  b"), ("<script>if (a<b) '</p>'</SCRIPT>x", "x"), ("<!-- open", ""), ("a<!-->b<p>c", "ab\n\nc"), ("a<!--->b<!---->c<!-- x --!>d<!--> -->e", "abcd -->e"), ("a <img src=x> b <unknown>c</unknown>", "a b c"), ("<p>a  \n b\tc</p>", "a b c"),
    ],
)
def test_rendering(page, text):
    assert html.render(page) == text


def test_rendering_keeps_all_visible_text():
    rng = random.Random(6)
    tags = ["p", "div", "ul", "li", "table", "tr", "td", "b", "span", "blockquote", "h1", "dd", "pre", "ol", "section"]
    for _ in range(60):
        parts, n = [], 0
        for _ in range(80):
            kind = rng.random()
            if kind < 0.4:
                parts.append(f" w{n}x ")
                n += 1
            else:
                parts.append(f"<{'/' if kind > 0.75 else ''}{rng.choice(tags)}>")
        text = html.render("".join(parts))
        assert sorted(re.findall(r"w\d+x", text)) == sorted(f"w{i}x" for i in range(n))


def random_markup(rng, depth, words, shown):
    """Markup, with end tags left out where HTML implies them, and in ``words`` the visible ones by a plain walk."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.35 or depth > 6:
            word = f"w{rng.randrange(10**9)}x"
            out.append(f" {word} ")
            words += [word] * shown
        elif kind < 0.45:
            out.append(rng.choice(["<!-- w0x -->", "<!-->", "<!--->", "<script>'w1x<p>'</script>", "<style>w2x</style>", "<br>", "<img alt='w3x' src=a>", "<template><p>w4x</template>", "<input value=w5x>", "<?w6x>", "<!doctype w7x>"]))
        else:
            name = rng.choice(["div", "section", "ul", "table", "span", "b", "blockquote", "p", "dl"])
            hides = rng.random() < 0.15
            attributes = rng.choice([" hidden", " style='color:red; display : NONE'", ' style="visibility:hidden"', " HIDDEN=''"]) if hides else rng.choice(["", " class=a", " title='a > b'", ' style="display:block"'])
            inside = lambda: random_markup(rng, depth + 1, words, shown and not hides)  # noqa: E731, B023
            if name == "ul":
                body = "".join(f"<li>{inside()}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 3)))
            elif name == "dl":
                body = "".join(f"<dt>{inside()}<dd>{inside()}" + rng.choice(["", "</dd>"]) for _ in range(rng.randint(1, 2)))
            elif name == "table":
                body = "".join("<tr>" + "".join(f"<td>{inside()}" + rng.choice(["", "</td>"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "</tr>"]) for _ in range(rng.randint(1, 3)))
            elif name in ("p", "span", "b"):
                word = f"w{rng.randrange(10**9)}x"
                words += [word] * (shown and not hides)
                body = f"a{word}".replace("a", " ", 1)
            else:
                body = inside()
            out.append(f"<{name}{attributes}>{body}</{name}>")
    return "".join(out)


def test_rendering_shows_what_a_plain_walk_shows():
    rng = random.Random(8)
    for _ in range(300):
        words: list[str] = []
        page = random_markup(rng, 0, words, True)
        assert re.findall(r"w\d+x", html.render(page)) == words or sorted(re.findall(r"w\d+x", html.render(page))) == sorted(words), page


def test_deep_nesting_and_table(spark):
    assert html.render("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    df = spark.createDataFrame([(1, "<p>a", 3), (1, "<p>a", 3), (None, None, 4)], "page_id long, html string, text int")
    assert sorted((str(r["page_id"]), r["text"], r["n_lines"]) for r in html.extract_text(df).collect()) == [("1", "a", 1), ("1", "a", 1), ("None", "", 0)]
    assert html.extract_text(df.where("page_id > 5")).count() == 0


# --- SimHash


def brute_fingerprint(text, width=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        out[find(i)].append(k)
    return out


def test_near_duplicates_against_brute_force(spark, docs, empty, monkeypatch):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    parts = brute_components(list(enumerate(f for _, f in rows)))
    wanted = []
    for members in parts.values():
        low = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        wanted += [(str(rows[i][0]), f"{rows[i][1]:016x}", low) for i in members]
    assert got == sorted(wanted)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(parts)


def test_links_lose_nothing(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        chain = b
        for _ in range(12):
            chain ^= sum(1 << x for x in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(chain)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    wanted = brute_components([(i, f) for i, f in enumerate(fps)])
    labels = {r["fp"] % (1 << 64): r["label"] for r in simhash.components(df).collect()}
    assert len(set(labels.values())) == len(wanted)
    for members in wanted.values():
        assert len({labels[fps[i]] for i in members}) == 1


@pytest.mark.parametrize("high", [True, False])
def test_large_groups_are_indexed_again(high, monkeypatch):
    rng = np.random.default_rng(1)
    other = rng.integers(0, 1 << 32, 400, dtype=np.uint64)
    near = other[:150] ^ (np.uint64(1) << rng.integers(0, 32, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 150, dtype=np.uint64))
    half = np.unique(np.concatenate((other, near)))
    values = np.sort((np.uint64(77) << np.uint64(32)) | half if high else (half << np.uint64(32)) | np.uint64(77))

    def parts():
        seen = {}
        for a, b in simhash.group_links(values, high):
            for x, y in zip(a.tolist(), b.tolist()):
                ra, rb = seen.setdefault(x, {x}), seen.setdefault(y, {y})
                if ra is not rb:
                    ra |= rb
                    for m in rb:
                        seen[m] = ra
        return {frozenset(s) for s in seen.values()}

    direct = parts()
    monkeypatch.setattr(simhash, "DIRECT", 8)
    assert parts() == direct and direct


def test_fingerprints_of_long_texts(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abCD", k=rng.randint(1, 6))) for _ in range(400))
    whole = simhash.fingerprint(text.encode())
    assert whole == brute_fingerprint(text)
    for piece in (7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b"one two") == brute_fingerprint("one two")


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 8)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html_of_any_depth():
    from rollsmith.llm.html import render

    deep = "<font>" * 3000
    assert render(f"<body>{deep}<p>one</p><p>two</p><div hidden>secret</div><ul><li>a<li>b</ul>") == "one\n\ntwo\n\n- a\n- b"
    assert render(f"<body><div hidden>{deep}<div>x</div>secret</div>shown") == "shown"
    assert render("<div>" * 3000 + "a<div>b</div>c" + "</div>" * 3000 + "d") == "a\nb\nc\nd"


def test_text_ends_a_head():
    from rollsmith.llm.html import render

    assert render("<html><head><title>T</title> \n Visible text <p>next</p>") == "Visible text\n\nnext"
    assert render("<head> <title>T</title><style>x</style> </head>\n<body>shown") == "shown"
    assert render("<div hidden><head>in</div>out") == "out"


def test_long_and_null_labelled_texts_train(spark, monkeypatch):
    from rollsmith.llm import quality

    seen = []
    monkeypatch.setattr(quality.QualityModel, "fit", lambda self, texts, labels, **k: seen.extend(zip(texts, labels)))
    docs = spark.createDataFrame([(1, "long words " * 2000), (2, "short"), (3, None), (4, "é" * quality.TRAIN_CHARS)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    quality.fit_quality_model(docs, marks, F.lit(True))
    assert sorted((len(t.decode()), k) for t, k in seen) == [(0, 0), (5, 1), (quality.TRAIN_CHARS, 0), (quality.TRAIN_CHARS, 1)]
    assert all(t in b"long words " * 2000 for t, k in seen if k == 0)


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer(tokenizer, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    texts = [r["text"] or "" for r in docs.collect()] + ["".join(map(chr, range(32, 0x250))), "x's 'tis I'll 'LL a'b", "A\xa0B C\x1cD", "naïve,é.É", "..!? -- '' $5.00 x_y"]
    coder = packing.Encoder(tokenizer)
    for _ in range(2):
        ids, bounds = coder.batch(TextBuffer(pa.array([x.encode() for x in texts], pa.large_binary())))
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_as_the_file_has_them(spark, tokenizer, monkeypatch, tmp_path):
    from rollsmith.llm.queries import op8_packing
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    end = t.encode("a b <|endoftext|> c", add_special_tokens=False).ids
    assert end == [320, 321, 49407, 322]
    texts = ["a b <|endoftext|> c", "plain words", "", "x<|startoftext|><|endoftext|>9 É", "<|ENDOFTEXT|>", "7<|ENDOFTEXT|>7", "cut <|endof", "text|> here", "<|endoftext|>", "it's <|endoftext| > 5"]
    wanted = [t.encode(x, add_special_tokens=False).ids for x in texts]
    coder = packing.Encoder(tokenizer, added_tokens=True)
    for part in (texts, texts[:1], texts[6:8], texts[::-1]):
        ids, bounds = coder.batch(TextBuffer(pa.array([x.encode() for x in part], pa.large_binary())))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [wanted[texts.index(x)] for x in part]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_packing(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in rows} == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in enumerate(wanted)}
    monkeypatch.setattr(packing, "SLICE", 16)
    long = "words before <|endoftext|> and after <|endoftext|>" * 5
    assert b"".join(coder.ids(long.encode())) == np.array(t.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_texts_in_pieces(tokenizer, docs, monkeypatch):
    coder = packing.Encoder(tokenizer)
    text = max((r["text"] or "" for r in docs.collect()), key=len).encode()
    whole = b"".join(coder.ids(text))
    monkeypatch.setattr(packing, "SLICE", 512)
    assert b"".join(coder.ids(text)) == whole and whole


@pytest.mark.parametrize("tasks", [1_000_000, 7])
def test_packing(spark, docs, empty, tokenizer, tasks, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PIECES_PER_TASK", tasks)
    got = [r.asDict() for r in packing.pack_documents(docs, tokenizer, capacity=256).collect()]
    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    wanted = []
    for r in docs.collect():
        ids = np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        wanted += [(r["doc_id"], k, k * 256, len(ids[k * 256 : k * 256 + 256]), zlib.crc32(ids[k * 256 : k * 256 + 256].tobytes())) for k in range(-(-len(ids) // 256))]
    assert sorted(map(str, wanted)) == sorted(str((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"])) for g in got)
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * sum(g["length"] for g in got) / 256 + 2
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_the_fullest_bin_closes_first():
    bins = packing.Bins(10, 2, 0)
    first = [bins.put(n) for n in (6, 7, 8)]  # the bin with 7 is fuller and closes
    assert first == [(0, 0), (1, 0), (2, 0)] and bins.put(3) == (0, 6) and bins.put(2) == (2, 8)

