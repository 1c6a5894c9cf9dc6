"""Properties that hold for any input."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest
import xxhash

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from rollsmith.llm import html, mixing, packing, simhash  # noqa: E402
from rollsmith.llm.common import TextBuffer  # noqa: E402


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 6))
def test_bins_never_overflow_and_stay_bounded(lengths, most):
    bins, fill = packing.Bins(40, most, 0), {}
    for n in lengths:
        number, offset = bins.put(n)
        assert offset == fill.get(number, 0)
        fill[number] = offset + n
        assert fill[number] <= 40 and bins.open <= most
    assert all(fill[number] == used for number, used in bins.left())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "<table>", "</table>", "<ul>", "<li>", "</li>", "<b", ">", "&amp;", "<!--", "-->", "<script>", "</script>", "w", " ", "\n", '"', "<br/>", "é"]), max_size=40))
def test_rendering_never_fails(parts):
    text = html.render("".join(parts))
    assert not text.startswith("\n") and not text.endswith("\n")
    if "<br/>" not in parts:
        assert "\n\n\n" not in text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0b\x0c\r\xa0é", max_size=30)), max_size=8))
def test_words_are_counted(texts):
    got = mixing.count_words(TextBuffer(pa.array(texts, pa.string())))
    assert got.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n", max_size=60), st.integers(1, 4))
def test_fingerprints(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if x]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    assert simhash.fingerprint(text.encode(), width) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
