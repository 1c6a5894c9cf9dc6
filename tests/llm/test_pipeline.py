"""The corpus pipeline, stage by stage, against brute force and against its whole run."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def results(spark):
    from rollsmith.llm.common import materialize

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(FOLDER)))
        out.append(docs)
    return out


def test_stages_and_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]
    for r in results[1:-1]:
        assert r.dtypes == results[0].dtypes


def test_filters_keep_clean_documents(spark, results):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, identified, graded = ({r["doc_id"] for r in x.collect()} for x in results[:3])
    assert identified <= before and graded <= identified and len(identified) > 0.97 * len(before)
    good, bad = ({i for i in identified if labels.get(i) == k} for k in (1, 0))
    assert len(good & graded) > 0.95 * len(good) and len(bad & graded) < 0.4 * len(bad)


def alike_groups(texts):
    """The smallest id of each group of texts whose sets of five-word shingles are 0.8 alike, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = t.translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {find(i) for i in ids}


def test_one_document_of_each_group_stays(results):
    """The stage's rule is five words and a similarity of 0.8, not the three words and three bits of the query of operator 7."""
    texts = {r["doc_id"]: r["text"] for r in results[2].collect()}
    kept = {r["doc_id"] for r in results[3].collect()}
    assert kept == alike_groups(texts) and len(kept) < len(texts)


def test_mix_repeats_documents_toward_the_targets(results):
    size = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in results[3].collect()}
    per, most = defaultdict(int), defaultdict(int)
    for s, n in size.values():
        per[s] += n
        most[s] = max(most[s], n)
    copies = Counter(r["doc_id"] for r in results[4].collect())
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    taken = defaultdict(int)
    for i, c in copies.items():
        taken[size[i][0]] += c * size[i][1]
    order = sorted(per)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    level = sum(per.values()) / sum(weight.values())
    for _ in range(50):
        capped = {s for s in order if weight[s] * level > 3 * per[s]}
        level = (sum(per.values()) - sum(3 * per[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
    for s in order:
        assert abs(taken[s] - min(3 * per[s], weight[s] * level)) <= most[s]


def test_packing_places_every_document(results):
    mixed, packed = Counter(r["doc_id"] for r in results[4].collect()), results[5].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    fill = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= 1.1 * sum(fill.values()) / 4096 + 2
    assert np.mean(list(fill.values())) > 3000


def test_run_applies_the_stages(spark, results):
    ours = sorted(map(str, corpus_pipeline.run(spark, str(FOLDER)).drop("sequence_id", "offset").collect()))
    assert ours == sorted(map(str, results[5].drop("sequence_id", "offset").collect()))


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from rollsmith.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    found = corpus_pipeline.run(spark, str(FOLDER))
    assert found.count() and len(list(tmp_path.iterdir())) == 1
    common.release(found)
    assert not list(tmp_path.iterdir())

    @common.tidy
    def fails():
        common.materialize(spark.range(3))
        raise ValueError

    with pytest.raises(ValueError):
        fails()
    assert not list(tmp_path.iterdir())


def test_edge_rows_pass_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing column names; then an empty table."""
    from rollsmith.llm import common

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.where("text is not null and lang is not null").limit(60).collect()
    long = " ".join(r["text"] for r in some if r["lang"] == some[0]["lang"]) * 20
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in some]
    rows += [(9001, None, "en", "s", 1), (9002, "", "en", "s", 1), (9003, " \n ", None, None, None), (None, some[0]["text"], None, None, None), (None, None, None, None, None), (9004, long, some[0]["lang"], "s", 1), rows[1], rows[1], (9005, "1234 !!", "en", "s", 1)]
    clash = ["id", "key", "row", "row_key", "node", "label", "score", "copies", "many", "size", "share", "chunk"]
    made = spark.createDataFrame([(*r, *[7] * len(clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in clash))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, table in (("full", made), ("none", made.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        ids = []
        for stage_name, stage in corpus_pipeline.STAGES:
            kept = common.tidy(stage)(spark, kept, f"{tmp_path}/{name}")
            assert stage_name == "packing" or kept.columns == made.columns
            ids.append({r["doc_id"] for r in kept.select("doc_id").collect()})
        assert not ids[-1] & {9001, 9002, 9003, 9005} and (not any(ids) if name == "none" else 9004 in ids[0] and ids[-1])
