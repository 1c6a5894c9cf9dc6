"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads bytes, labels every byte position with a distribution over the
learned languages, and a document's probabilities are the mean over its positions.
Training is backpropagation through time in numpy on a bounded sample of labelled
windows (``SAMPLE_PER_LANGUAGE`` documents a language, ``SLICES`` windows each);
scoring covers every byte of every text, in Arrow batches, with no state between rows.
Both directions begin anew every ``WINDOW`` bytes, also inside a character, so a text of any
length is read whole in bounded memory.

Defined results: a null text or one without a letter gets ``und`` and score 0; a
null id never trains and is not held out; an empty table gives an empty result;
with no labelled row at all every text is ``und``. Repeated rows are scored alike; of
equally likely languages the first by name is taken. Windows are scored ``BATCH`` at a
time, of very long texts too. Other columns are not read, whatever their names;
``keep_identified`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import TextBuffer, frugal, slices

UNDETERMINED = "und"
#: Bound of the training sample: documents of each language, windows of each document, characters of a window.
SAMPLE_PER_LANGUAGE, SLICES, SLICE_CHARS = 1000, 2, 300
HIDDEN, WINDOW, BATCH = 12, 128, 2048
STEPS, TRAIN_BATCH, RATE, SEED = 350, 128, 0.02, 7


class LanguageModel:
    """Weights of both directions; columns of ``table`` are what each byte adds to the gates."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, n = list(languages), max(1, len(languages))
        self.weights: dict[str, np.ndarray] = {}
        for way in ("left", "right"):
            self.weights[f"table_{way}"] = rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
            self.weights[f"loop_{way}"] = rng.normal(0, 0.5 / np.sqrt(HIDDEN), (3 * HIDDEN, HIDDEN)).astype(np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (n, 2 * HIDDEN)).astype(np.float32)
        self.weights["bias"] = np.zeros((n, 1), np.float32)

    def states(self, x: np.ndarray, way: str, keep: dict | None = None) -> np.ndarray:
        """States (time, hidden, batch) of one direction over bytes ``x`` (time, batch)."""
        table, loop = self.weights[f"table_{way}"], self.weights[f"loop_{way}"]
        steps, batch = x.shape
        rows = np.ascontiguousarray(table.T)
        out = np.empty((steps, HIDDEN, batch), np.float32)
        state = np.zeros((HIDDEN, batch), np.float32)
        gathered, gates = np.empty((batch, 3 * HIDDEN), np.float32), np.empty((3 * HIDDEN, batch), np.float32)
        recurrent, reset = np.empty_like(gates), np.empty((HIDDEN, batch), np.float32)
        for t in range(steps) if way == "left" else range(steps - 1, -1, -1):
            np.take(rows, x[t], axis=0, out=gathered, mode="clip")
            np.copyto(gates, gathered.T)
            np.matmul(loop, state, out=recurrent)
            both = gates[: 2 * HIDDEN]
            both += recurrent[: 2 * HIDDEN]
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            new = gates[2 * HIDDEN :]
            np.multiply(both[HIDDEN:], recurrent[2 * HIDDEN :], out=reset)
            new += reset
            np.tanh(new, out=new)
            if keep is not None:
                keep[t] = (gates.copy(), recurrent[2 * HIDDEN :].copy(), state)
            new -= state
            new *= both[:HIDDEN]
            np.add(state, new, out=out[t])
            state = out[t]
        return out

    def probabilities(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Distribution over languages at each position: (time, language, batch)."""
        logits = np.matmul(self.weights["out"][:, :HIDDEN], left) + np.matmul(self.weights["out"][:, HIDDEN:], right) + self.weights["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, label: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the valid positions, and its gradient through time."""
        kept = {"left": {}, "right": {}}
        states = {way: self.states(x, way, kept[way]) for way in kept}
        p = self.probabilities(states["left"], states["right"])
        steps, n, batch = p.shape
        columns = np.arange(batch)
        count = max(1.0, float(valid.sum()))
        loss = -float((np.log(p[:, label, columns] + 1e-9) * valid).sum()) / count
        delta = p
        delta[:, label, columns] -= 1
        delta *= (valid / count)[:, None, :]
        grads = {"bias": delta.sum(axis=(0, 2))[:, None]}
        wide = np.concatenate((states["left"], states["right"]), axis=1)
        grads["out"] = np.einsum("tnb,thb->nh", delta, wide, optimize=True)
        for k, way in enumerate(("left", "right")):
            loop = self.weights[f"loop_{way}"]
            from_out = np.matmul(self.weights["out"][:, k * HIDDEN : (k + 1) * HIDDEN].T, delta)
            moved, d_loop = np.empty((steps, 3 * HIDDEN, batch), np.float32), np.zeros_like(loop)
            carry = np.zeros((HIDDEN, batch), np.float32)
            for t in range(steps - 1, -1, -1) if way == "left" else range(steps):
                gates, recurrent, before = kept[way][t]
                z, r, c = gates[:HIDDEN], gates[HIDDEN : 2 * HIDDEN], gates[2 * HIDDEN :]
                dh = from_out[t] + carry
                dc = dh * z * (1 - c * c)
                d = moved[t]
                d[:HIDDEN] = dh * (c - before) * (2 * z * (1 - z))
                d[HIDDEN : 2 * HIDDEN] = dc * recurrent * (2 * r * (1 - r))
                d[2 * HIDDEN :] = dc
                through = d.copy()
                through[2 * HIDDEN :] *= r
                d_loop += through @ before.T
                carry = dh * (1 - z) + loop.T @ through
            grads[f"loop_{way}"] = d_loop
            flat, seen = moved.transpose(1, 0, 2).reshape(3 * HIDDEN, -1), x.reshape(-1)
            grads[f"table_{way}"] = np.stack([np.bincount(seen, weights=row, minlength=256) for row in flat]).astype(np.float32)
        return loss, grads

    def fit(self, texts: list[bytes], labels: list[int], seed: int = SEED) -> float:
        """Adam over random windows; returns the last smoothed loss."""
        rng = np.random.default_rng(seed)
        groups = [[t for t, y in zip(texts, labels) if y == k and t] for k in range(len(self.languages))]
        present = [k for k, g in enumerate(groups) if g]
        if not present:
            return 0.0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        smoothed = 0.0
        for step in range(1, STEPS + 1):
            label = rng.choice(present, TRAIN_BATCH)
            x, valid = np.zeros((WINDOW, TRAIN_BATCH), np.uint8), np.zeros((WINDOW, TRAIN_BATCH), np.float32)
            for b, k in enumerate(label):
                text = groups[k][rng.integers(len(groups[k]))]
                length = WINDOW if rng.random() < 0.8 else int(rng.integers(1, WINDOW + 1))
                at = int(rng.integers(max(1, len(text) - length + 1)))
                piece = np.frombuffer(text[at : at + length], np.uint8)
                x[: len(piece), b], valid[: len(piece), b] = piece, 1
            loss, grads = self.gradients(x, label, valid)
            smoothed = loss if step == 1 else 0.95 * smoothed + 0.05 * loss
            rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
            for name, g in grads.items():
                np.clip(g, -1, 1, out=g)
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                step_size = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                self.weights[name] -= (step_size * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
        return smoothed

    def score(self, buffer: TextBuffer) -> np.ndarray:
        """Mean distribution over all byte positions of each text: (texts, languages)."""
        lengths = np.diff(buffer.offsets)
        windows = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(lengths)), windows)
        ordinal = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = buffer.offsets[owner] + ordinal * WINDOW
        valid = np.minimum(WINDOW, lengths[owner] - ordinal * WINDOW)
        padded = np.concatenate((buffer.data, np.zeros(WINDOW, np.uint8)))
        totals = np.zeros((len(lengths), len(self.languages)))
        within = np.arange(WINDOW)
        for a in range(0, len(owner), BATCH):
            at, n = starts[a : a + BATCH], valid[a : a + BATCH]
            inside = within[:, None] < n[None, :]
            x = np.where(inside, padded[at[None, :] + within[:, None]], 0).astype(np.uint8)
            p = self.probabilities(self.states(x, "left"), self.states(x, "right"))
            p *= inside[:, None, :]
            np.add.at(totals, owner[a : a + BATCH], p.sum(axis=0).T)
        return totals / np.maximum(lengths, 1)[:, None]


def has_letter(buffer: TextBuffer) -> np.ndarray:
    """Whether each text holds a character of a Unicode letter category."""
    data = buffer.data
    found = buffer.sums(((data | 32) >= 97) & ((data | 32) <= 122)) > 0
    for i in np.flatnonzero(~found):
        piece = data[buffer.offsets[i] : buffer.offsets[i + 1]].tobytes()
        found[i] = any(map(str.isalpha, piece.decode("utf-8", "replace")))
    return found


def fit_language_model(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Train on a bounded sample of the rows for which ``train`` holds and the language is known.

    The sample takes, for each language, about ``per_language`` rows by hash of the
    id, and from each of them ``SLICES`` windows at hashed places.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    model = LanguageModel(languages)
    if not languages:
        return model
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, int(min(1.0, per_language / counts[k]) * (1 << 20)))])
    place = [F.pmod(F.xxhash64(F.col(id_col), F.lit(20 + k)), F.greatest(F.length(text_col) - SLICE_CHARS, F.lit(0)) + 1) + 1 for k in range(SLICES)]
    sample = (
        rows.where(draw < F.try_element_at(share, F.col(lang_col)))
        .select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(12)).alias("at"), F.array(*[F.col(text_col).substr(p.cast("int"), F.lit(SLICE_CHARS)) for p in place]).alias("pieces"))
        .orderBy("at", "lang")
        .limit(2 * per_language * len(languages))
        .collect()
    )
    number = {k: i for i, k in enumerate(languages)}
    texts = [(p.encode(), number[r["lang"]]) for r in sample for p in r["pieces"]]
    model.fit([t for t, _ in texts], [y for _, y in texts])
    return model


def _scored(model: LanguageModel, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    buffer = TextBuffer(texts)
    known = has_letter(buffer) & np.asarray(texts.is_valid()) & bool(model.languages)
    p = model.score(buffer) if len(buffer) and model.languages else np.zeros((len(buffer), 1))
    best = p.argmax(axis=1) if len(buffer) else np.zeros(0, int)
    names = np.array(model.languages or [UNDETERMINED], dtype=object)
    score = np.where(known, np.minimum(p.max(axis=1, initial=0), 1.0), 0.0)
    return pa.array(np.where(known, names[best], UNDETERMINED), pa.string()), pa.array(score, pa.float64())


def predict_language(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``lang_pred`` and ``score``, over its whole text."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lang, score = _scored(model, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), lang, score], names=["id", "lang_pred", "score"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(frugal(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language is determined with at least ``min_score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                lang, score = _scored(model, part.column(text_col))
                keep = pc.and_(pc.not_equal(lang, UNDETERMINED), pc.greater_equal(score, min_score))
                yield part.filter(keep)

    return docs.mapInArrow(frugal(run), docs.schema)
