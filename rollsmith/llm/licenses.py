"""License scans by a positional rare-token index.

Templates are word sequences with a label and mandatory key phrases. How rare a word
is (IDF) is counted over all documents. The index holds the postings of every template
word: template, position, and how rare the word is among the template's key words. A
file's licence words are looked up by falling IDF: a template is a candidate of the file
if its rarest key words (``DEPTH`` of them) are all in it. Their lists of places in the
file are then intersected by relative position: the shortest proposes where the template
would start, and a start is kept if every other list holds the place that it asks for, so
cost goes by the places of the word that the file has least of, however common the others
are. What is left is verified: all key phrases have to be in place, and the words in
place (or ``SLACK`` words beside it, within the same text) to hold at least ``ACCEPT`` of the
template's IDF. As whatever stands holds all its key words, no template is missed; a base
phrase is a template whose key phrase is the whole of it, so every place of it is found.
Work is done on the bytes of a batch, without an object for a word.

Words are runs of characters other than ASCII non-alphanumerics, after lower-casing A-Z.

Defined results: a null text is empty: no words, no labels, score 0, null first and
last word; a null id is kept as it is; repeated rows are each reported, and a row's
result does not depend on others but through the IDF; an empty table gives an empty result; texts of any length are scanned
whole; other columns are not read, whatever their names. ``score`` is the largest IDF
share of a standing proposal.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import LOWER, TextBuffer, slices

ACCEPT, SLACK, SLICE = 0.75, 1, 8 << 20
#: Key words of a template, the rarest ones, whose lists are intersected.
DEPTH = 3
#: Proposals that are worked on at once.
AT_ONCE = 1 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # ranges of words that must be in place
    base: bool = False


def template(label: str, text: str, *keys: str, base: bool = False) -> Template:
    """A template from its text; ``keys`` are phrases of it (none: the whole text)."""
    words = tuple(_WORD.findall(text.lower()))
    spans = []
    for key in keys or (text,):
        part = tuple(_WORD.findall(key.lower()))
        spans.append(next((i, i + len(part)) for i in range(len(words)) if words[i : i + len(part)] == part))
    return Template(label, words, tuple(spans), base)


#: The base phrases.
BASE = (
    template("gpl", "gnu general public license", base=True),
    template("apache", "apache license", base=True),
    template("cc-by", "cc by", base=True),
    template("mit", "mit license", base=True),
)
#: The method's own templates: well-known wordings of public licences.
OWN = (
    template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("apache-2.0", "apache license 2 0"),
    template("cc-by-nc", "cc by nc"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
    template("cc-by", "creative commons attribution"),
    template("cc0", "cc0 1 0"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", "obtaining a copy"),
    template("mit", "released under the mit license", "mit license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    template("bsd", "bsd license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software for any purpose"),
    template("mpl", "mozilla public license"),
    template("epl", "eclipse public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    template("all-rights-reserved", "all rights reserved"),
    template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "merge publish distribute sublicense", "above copyright notice and this permission notice",
    ),
    template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "appear in all copies",
    ),
    template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "redistributions of source code must retain", "redistributions in binary form must reproduce",
    ),
    template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "except in compliance with the license",
    ),
    template(
        "gpl",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "terms of the gnu general public license",
    ),
    template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "alter it and redistribute it freely",
    ),
)


class Vocabulary:
    """The template words, found among the words of a buffer by their bytes."""

    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for w in t.words})
        self.number = {w: i for i, w in enumerate(self.words)}
        spelled = [w.encode() for w in self.words]
        self.long = {w: i for i, w in enumerate(spelled) if len(w) > 16}
        self.long_sizes = np.array(sorted(set(map(len, self.long))), np.int64)
        short = np.array([i for i, w in enumerate(spelled) if len(w) <= 16], np.int64)
        pairs = np.frombuffer(b"".join(spelled[i].ljust(16, b"\0") for i in short), "<u8").reshape(-1, 2)
        length = np.array([len(spelled[i]) for i in short], np.uint64)
        keys = self.key(pairs[:, 0], pairs[:, 1], length)
        order = np.argsort(keys)
        self.order = short[order]
        self.keys, self.low, self.high, self.length = keys[order], pairs[order, 0], pairs[order, 1], length[order]

    @staticmethod
    def key(low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ length) * np.uint64(0xD6E8FEB86659FD93)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each word, or -1. ``data`` is followed by 16 spare bytes."""
        found = np.full(len(starts), -1, np.int32)
        for i in np.flatnonzero(np.isin(lengths, self.long_sizes)):
            found[i] = self.long.get(data[starts[i] : starts[i] + lengths[i]].tobytes(), -1)
        if not len(self.keys):
            return found
        short = np.flatnonzero(lengths <= 16)
        view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        at, n = starts[short], lengths[short].astype(np.uint64)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = view[at] & (full >> (np.uint64(8) * (np.uint64(8) - np.minimum(n, np.uint64(8)))))
        more = n > 8
        high = np.zeros(len(at), np.uint64)
        high[more] = view[at[more] + 8] & (full >> (np.uint64(8) * (np.uint64(16) - n[more])))
        keys = self.key(low, high, n)
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = np.flatnonzero(self.keys[slot] == keys)
        s = slot[same]
        same, s = (x[(self.low[s] == low[same]) & (self.high[s] == high[same]) & (self.length[s] == n[same])] for x in (same, s))
        found[short[same]] = self.order[s]
        return found


class Words:
    """The words of a batch of texts: which template word each is, and where each text's words begin."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        buffer = TextBuffer(texts)
        data = np.concatenate((LOWER[buffer.data], np.zeros(16, np.uint8)))
        inside = data[:-16]
        word = (inside >= 0x80) | ((inside >= 0x30) & (inside <= 0x39)) | ((inside >= 0x61) & (inside <= 0x7A))
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        filled = np.diff(buffer.offsets) > 0
        firsts, lasts = buffer.offsets[:-1][filled], buffer.offsets[1:][filled] - 1
        start[firsts], end[lasts] = word[firsts], word[lasts]
        starts = np.flatnonzero(start)
        self.ids = vocabulary.find(data, starts, np.flatnonzero(end) + 1 - starts)
        self.first = np.searchsorted(starts, buffer.offsets)
        self.counts = np.diff(self.first)


class Places:
    """The licence words of each text of a batch, and each one's ascending list of places."""

    def __init__(self, words: Words):
        place = np.flatnonzero(words.ids >= 0)
        owner = np.searchsorted(words.first, place, side="right") - 1
        several = int(words.ids.max(initial=0)) + 1
        key = owner * several + words.ids[place]
        order = np.argsort(key, kind="stable")
        self.place, key = place[order], key[order]
        self.begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.begin, len(key)))
        self.owner, self.word = key[self.begin] // several, key[self.begin] % several
        # Places rise within a list and lists do not mix, so one sorted array answers for all of them.
        self.span = len(words.ids) + 1
        self.sorted = np.repeat(np.arange(len(self.begin)), self.size) * self.span + self.place

    def holds(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a list holds a place, for each pair; a place before the first word is in none."""
        wanted = which * self.span + place
        at = np.minimum(np.searchsorted(self.sorted, wanted), max(len(self.sorted) - 1, 0))
        return (place >= 0) & (place < self.span) & (self.sorted[at] == wanted)


def document_frequencies(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those holding each template word, over all documents.

    The result has one row for each template word at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(templates)
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part.column("text"), vocabulary)
                place = np.flatnonzero(words.ids >= 0)
                owner = np.searchsorted(words.first, place, side="right") - 1
                pairs = np.unique(owner * len(vocabulary.words) + words.ids[place])
                total[:-1] += np.bincount(pairs % len(vocabulary.words), minlength=len(vocabulary.words))
                total[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary.words, None]), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop(None, 0), found


class Index:
    """Postings of all template words by position, with each key word's rank by falling IDF among its template's."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: Vocabulary, idf: dict[str, float]):
        self.templates = templates
        self.numbers = [np.array([vocabulary.number[w] for w in t.words], np.int32) for t in templates]
        self.weights = [np.array([idf[w] for w in t.words]) for t in templates]
        self.sizes = np.array([len(t.words) for t in templates], np.int64)
        keys = [sorted({j for a, b in t.keys for j in range(a, b)}, key=lambda j, t=t: (-idf[t.words[j]], j)) for t in templates]
        self.n_keys = np.array([len(k) for k in keys], np.int64)
        most = int(self.n_keys.max(initial=1))
        self.key_place = np.array([k + [0] * (most - len(k)) for k in keys], np.int64).reshape(len(templates), most)
        self.key_word = np.array([[n[j] for j in k] + [0] * (most - len(k)) for n, k in zip(self.numbers, keys)], np.int32).reshape(len(templates), most)
        # Word, template, position and rank of every place in a template; words that are no key come last.
        rows = [(n[j], t, j, ranks.get(n[j], most) if first.get(n[j]) == j else most) for t, (n, k) in enumerate(zip(self.numbers, keys)) for ranks, first in [self._ranked(n, k)] for j in range(len(n))]
        cells = np.array(sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])), np.int64).reshape(-1, 4)
        self.word, self.template, self.position, self.rank = cells.T
        self.asked = np.minimum(np.array([len({n[j] for j in k}) for n, k in zip(self.numbers, keys)], np.int64), DEPTH)
        numbers = np.arange(len(vocabulary.words))
        deep = self.word * (most + 1) + self.rank
        self.begin = np.searchsorted(self.word, numbers)
        self.leading = np.searchsorted(deep, numbers * (most + 1) + min(DEPTH, most)) - self.begin  # postings among the rarest of a template

    @staticmethod
    def _ranked(numbers: np.ndarray, keys: list[int]) -> tuple[dict[int, int], dict[int, int]]:
        """The distinct key words' ranks, and the key position that stands for each."""
        first: dict[int, int] = {}
        for j in keys:
            first.setdefault(numbers[j], j)
        return {w: r for r, w in enumerate(first)}, first

    def _candidates(self, lists: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text and template of each candidate, and for its ranks the list of the text (-1: none) and the position in the template."""
        n = self.leading[lists.word]
        which = np.repeat(np.arange(len(n)), n)
        row = np.repeat(self.begin[lists.word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        t, rank, pair = self.template[row], self.rank[row], lists.owner[which] * len(self.templates) + self.template[row]
        found, at, met = np.unique(pair, return_inverse=True, return_counts=True)
        full = met == self.asked[found % len(self.templates)]
        place = np.cumsum(full) - 1
        kept = full[at]
        which, row, rank, at = which[kept], row[kept], rank[kept], place[at[kept]]
        held, position = (np.full((int(full.sum()), DEPTH), -1, np.int64) for _ in range(2))
        held[at, rank], position[at, rank] = which, self.position[row]
        return found[full] // len(self.templates), found[full] % len(self.templates), held, position

    def proposals(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Template, start and text of each proposal whose key phrases are all in place."""
        lists = Places(words)
        if not len(lists.word) or not len(self.templates):
            return
        owners, templates, held, position = self._candidates(lists)
        if not len(owners):
            return
        sizes = np.where(held >= 0, lists.size[held], np.iinfo(np.int64).max)
        lead = sizes.argmin(axis=1)
        row = np.arange(len(lead))
        made = np.cumsum(sizes[row, lead])
        cuts = np.searchsorted(made, np.arange(AT_ONCE, made[-1] + AT_ONCE, AT_ONCE), side="right")
        for part in np.split(row, cuts[:-1]):
            if not len(part):
                continue
            shortest = held[part, lead[part]]
            n = lists.size[shortest]
            own = np.repeat(part, n)
            at = lists.place[np.repeat(lists.begin[shortest] - np.cumsum(n) + n, n) + np.arange(n.sum())] - position[own, lead[own]]
            t, owner = templates[own], owners[own]
            fits = (at >= words.first[owner]) & (at + self.sizes[t] <= words.first[owner + 1])
            own, at, t, owner = own[fits], at[fits], t[fits], owner[fits]
            for r in range(DEPTH):
                other = np.flatnonzero((held[own, r] >= 0) & (lead[own] != r))
                met = np.ones(len(own), bool)
                met[other] = lists.holds(held[own[other], r], at[other] + position[own[other], r])
                own, at, t, owner = own[met], at[met], t[met], owner[met]
            for r in range(self.key_place.shape[1]):
                if not len(t):
                    break
                place = np.minimum(at + self.key_place[t, r], len(words.ids) - 1)
                met = (r >= self.n_keys[t]) | (words.ids[place] == self.key_word[t, r])
                t, at, owner = t[met], at[met], owner[met]
            if len(t):
                yield t, at, owner

    def share(self, t: int, words: Words, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """What of a template's IDF is in place, or ``SLACK`` words beside it in the same text."""
        if self.templates[t].base:
            return np.ones(len(at))
        total = np.zeros(len(at))
        low, high = words.first[owner], words.first[owner + 1]
        for j, (number, weight) in enumerate(zip(self.numbers[t], self.weights[t])):
            near = np.zeros(len(at), bool)
            for d in range(-SLACK, SLACK + 1):
                place = at + (j + d)
                inside = (place >= low) & (place < high)
                near |= inside & (words.ids[np.where(inside, place, at)] == number)
            total += weight * near
        return np.minimum(total / self.weights[t].sum(), 1.0)


def _scan(words: Words, index: Index) -> dict[str, list]:
    """Per text: places of base phrases, labels, and the best share of a standing proposal."""
    n = len(words.counts)
    base, first, last, score = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n)
    names = sorted({t.label for t in index.templates})
    number = {name: i for i, name in enumerate(names)}
    given = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # text and label: of all templates, of base ones
    for which, starts, owners in index.proposals(words):
        for k in np.unique(which):
            t = index.templates[k]
            mine = which == k
            at, owner = starts[mine], owners[mine]
            share = index.share(k, words, at, owner)
            good = share >= ACCEPT
            at, owner, share = at[good], owner[good], share[good]
            np.maximum.at(score, owner, share)
            for kind in given[: 1 + t.base]:
                kind.append(np.unique(owner) * len(names) + number[t.label])
            if t.base:
                inside = at - words.first[owner]
                np.add.at(base, owner, 1)
                np.minimum.at(first, owner, inside)
                np.maximum.at(last, owner, inside)
    some = base > 0

    def joined(kind: list[np.ndarray]) -> list[str]:
        out = [""] * n
        for key in np.unique(np.concatenate(kind)).tolist():  # by text, then by label
            i, name = key // len(names), names[key % len(names)]
            out[i] = f"{out[i]},{name}" if out[i] else name
        return out

    return {
        "n_words": words.counts.astype(np.int64), "n_base": base, "first_word": [int(x) if y else None for x, y in zip(first, some)], "last_word": [int(x) if y else None for x, y in zip(last, some)],
        "base_labels": joined(given[1]), "labels": joined(given[0]), "score": score,
    }


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN) -> DataFrame:
    """One row per document: words, places of base phrases, labels and score, over its whole text."""
    templates = tuple(base) + tuple(own)
    total, df = document_frequencies(docs, text_col, templates)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1 for t in templates for w in t.words}
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(templates)
        index = Index(templates, vocabulary, idf)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = _scan(Words(part.column("text"), vocabulary), index)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[n], arrow[k]) for n, k in kinds.items())], names=["id", *kinds])

    shape = f"id {kept.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in kinds.items())
    return kept.mapInArrow(run, shape).withColumnRenamed("id", id_col)
