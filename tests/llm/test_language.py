"""The recurrent network against a plain one that reads a byte at a time, in both directions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from rollsmith.llm import language
from rollsmith.llm.common import TextBuffer


def plain_states(model, data, way):
    """The state after each byte, from the first on or from the last on."""
    h, table, loop = language.HIDDEN, model.weights[f"table_{way}"].astype(float), model.weights[f"loop_{way}"].astype(float)
    state, out = [0.0] * h, [None] * len(data)
    gate = lambda v: (math.tanh(v) + 1) / 2
    for t in range(len(data)) if way == "left" else reversed(range(len(data))):
        heard = [sum(loop[k][j] * state[j] for j in range(h)) for k in range(3 * h)]
        take = [gate(table[k][data[t]] + heard[k]) for k in range(h)]
        reset = [gate(table[h + k][data[t]] + heard[h + k]) for k in range(h)]
        fresh = [math.tanh(table[2 * h + k][data[t]] + reset[k] * heard[2 * h + k]) for k in range(h)]
        state = [s + z * (c - s) for s, z, c in zip(state, take, fresh)]
        out[t] = state
    return out


def plain_score(model, text):
    """The mean over a text's bytes of what each is labelled, in windows that begin anew."""
    total, n = np.zeros(len(model.languages)), len(text)
    for a in range(0, n, language.WINDOW):
        piece = text[a : a + language.WINDOW]
        data = piece + bytes(language.WINDOW - len(piece))
        left, right = plain_states(model, data, "left"), plain_states(model, data, "right")
        for t in range(len(piece)):
            logits = [sum(w * x for w, x in zip(row, left[t] + right[t])) + b[0] for row, b in zip(model.weights["out"].astype(float), model.weights["bias"].astype(float))]
            weights = [math.exp(v - max(logits)) for v in logits]
            total += np.array(weights) / sum(weights)
    return total / max(n, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_of_a_plain_network(seed):
    model = language.LanguageModel(["de", "en", "fr"], seed=seed)
    rng = np.random.default_rng(seed)
    for name in model.weights:
        model.weights[name] = rng.normal(0, 0.6, model.weights[name].shape).astype(np.float32)
    texts = ["a", "", "Über alles, naïve é", "x" * 128, "the quick brown fox " * 14, "é" * 100]
    got = model.score(TextBuffer(pa.array(texts)))
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_score(model, text.encode()), abs=2e-5)
