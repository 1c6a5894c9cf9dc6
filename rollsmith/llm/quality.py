"""Quality classifier: a convolutional network over bytes, written in numpy.

Bytes are embedded; filters of ``2 * STRIDE`` bytes slide over the whole text by
``STRIDE``. Chunks of two units overlap by one unit. Each chunk's filter outputs
are max-pooled, a small layer reads every chunk, and the mean and the maximum of
the chunks give the document's probability. Nothing of a text is left out.

Training takes a bounded sample: at most ``SAMPLE`` labelled documents of each
class, chosen by hash of the id; of a longer text than ``TRAIN_CHARS`` characters
so many from a hashed place on. A null text trains as an empty one.

Defined results: a null text counts as empty, and an empty one is scored like any
other (on one chunk of padding); a null id is neither held out nor learned from;
without labelled rows of both classes every score is the known share of label 1
(0.5 if there is none); an empty table gives an empty result; repeated rows are each
scored, and count once for each row in training; a text of any length is scored whole
in bounded memory; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsmith.llm.common import TextBuffer, frugal, slices

#: Bound of the training sample, documents of each class, and the longest text in it.
SAMPLE, TRAIN_CHARS = 3000, 8000
EMBED, STRIDE, FILTERS, UNIT, HIDDEN = 8, 4, 32, 128, 16
STEPS, TRAIN_BATCH, RATE, SEED = 800, 32, 0.01, 5
BLOCK = EMBED * STRIDE
#: Bytes of texts worked on at once, and units of a longer text.
PIECE, RUN = 1 << 20, 4096


class Layout:
    """Texts padded to whole units: their bytes, and which unit and chunk belongs to which text."""

    def __init__(self, buffer: TextBuffer):
        lengths = np.diff(buffer.offsets)
        self.units = -(-(lengths + STRIDE) // UNIT)  # at least one block of padding ends each text
        ends = np.cumsum(self.units * UNIT)
        starts = ends - self.units * UNIT
        self.bytes = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        shift = np.repeat(starts - buffer.offsets[:-1], lengths)
        self.bytes[np.arange(len(buffer.data)) + shift] = buffer.data
        self.last_block = ends // STRIDE - 1
        self.chunks = np.maximum(self.units - 1, 1)
        self.chunk_owner = np.repeat(np.arange(len(lengths)), self.chunks)
        ordinal = np.arange(len(self.chunk_owner)) - np.repeat(np.cumsum(self.chunks) - self.chunks, self.chunks)
        self.first_unit = np.repeat(starts // UNIT, self.chunks) + ordinal
        self.second_unit = self.first_unit + (self.units[self.chunk_owner] > 1)
        self.chunk_start = np.cumsum(self.chunks) - self.chunks


class QualityModel:
    def __init__(self, seed: int = SEED, share: float = 0.5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(0, 1, shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        self.fitted, self.share = False, share
        self.weights = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "near": normal(2 * BLOCK, FILTERS)[:BLOCK], "far": normal(2 * BLOCK, FILTERS)[:BLOCK],
            "hidden": normal(FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, 1) * 0.3, "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, layout: Layout, keep: dict | None = None) -> np.ndarray:
        w = self.weights
        blocks = w["embed"][layout.bytes].reshape(-1, BLOCK)
        conv = blocks @ w["near"]
        far = blocks @ w["far"]
        conv[:-1] += far[1:]
        edge = layout.last_block
        inner = edge[edge + 1 < len(blocks)]
        conv[inner] -= far[inner + 1]  # a text's last window reads padding, not the next text
        conv = conv.reshape(-1, UNIT // STRIDE, FILTERS)
        unit = conv.max(axis=1)
        first, second = unit[layout.first_unit], unit[layout.second_unit]
        pooled = np.maximum(first, second)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
        mean = np.add.reduceat(hidden, layout.chunk_start) / layout.chunks[:, None]
        top = np.maximum.reduceat(hidden, layout.chunk_start)
        both = np.concatenate((mean, top), axis=1)
        logit = (both @ w["out"] + w["out_bias"])[:, 0]
        if keep is not None:
            keep |= {"blocks": blocks, "arg": conv.argmax(axis=1), "first": first >= second, "pooled": pooled, "hidden": hidden, "top": top, "both": both}
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, layout: Layout, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, k = self.weights, {}
        p = self.forward(layout, k)
        loss = -float((weight * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum() / weight.sum())
        d = ((p - label) * weight / weight.sum()).astype(np.float32)[:, None]
        g = {"out": k["both"].T @ d, "out_bias": d.sum(axis=0)}
        d_both = d @ w["out"].T
        owner = layout.chunk_owner
        d_hidden = d_both[owner, :HIDDEN] / layout.chunks[owner][:, None]
        is_top = k["hidden"] >= k["top"][owner]
        ties = np.add.reduceat(is_top.astype(np.float32), layout.chunk_start)
        d_hidden = (d_hidden + is_top * (d_both[:, HIDDEN:] / ties)[owner]) * (k["hidden"] > 0)
        g |= {"hidden": k["pooled"].T @ d_hidden, "hidden_bias": d_hidden.sum(axis=0)}
        d_pooled = d_hidden @ w["hidden"].T
        unit = np.where(k["first"], layout.first_unit[:, None], layout.second_unit[:, None])
        column = np.broadcast_to(np.arange(FILTERS), unit.shape)
        d_unit = np.zeros((len(layout.bytes) // UNIT, FILTERS), np.float32)
        np.add.at(d_unit, (unit, column), d_pooled)
        position = (np.arange(len(d_unit)) * (UNIT // STRIDE))[:, None] + k["arg"]
        d_conv = np.zeros((len(k["blocks"]), FILTERS), np.float32)
        d_conv[position, np.broadcast_to(np.arange(FILTERS), position.shape)] = d_unit
        d_far = np.zeros_like(d_conv)
        d_far[1:] = d_conv[:-1]
        starts = layout.last_block[:-1] + 1
        d_far[starts] = 0
        g |= {"near": k["blocks"].T @ d_conv, "far": k["blocks"].T @ d_far}
        d_bytes = (d_conv @ w["near"].T + d_far @ w["far"].T).reshape(-1, EMBED)
        g["embed"] = np.stack([np.bincount(layout.bytes, weights=d_bytes[:, e], minlength=256) for e in range(EMBED)], axis=1).astype(np.float32)
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], seed: int = SEED) -> None:
        y = np.array(labels, dtype=np.float32)
        if not len(y) or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        kinds = [np.flatnonzero(y == k) for k in (0, 1)]
        orders: list[list[int]] = [[], []]
        weight = np.ones(TRAIN_BATCH, np.float32)
        for step in range(1, STEPS + 1):
            rows: list[int] = []
            for k, members in enumerate(kinds):  # both classes alike, each text once before any comes again
                while len(orders[k]) < TRAIN_BATCH // 2:
                    orders[k] += rng.permutation(members).tolist()
                rows += orders[k][: TRAIN_BATCH // 2]
                del orders[k][: TRAIN_BATCH // 2]
            _, grads = self.gradients(Layout(TextBuffer(pa.array([texts[i] for i in rows], pa.large_binary()))), y[rows], weight)
            rate = RATE * min(1.0, step / 20) * (1 - step / (STEPS + 1))
            for name, g in grads.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.005 * (g * g - second[name])
                size = rate * np.sqrt(1 - 0.995**step) / (1 - 0.9**step)
                self.weights[name] -= (size * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
        self.fitted = True

    def forward_long(self, data: np.ndarray) -> float:
        """The probability of one text of any length: runs of units, and what its chunks add up to so far."""
        w = self.weights
        units = -(-(len(data) + STRIDE) // UNIT)
        before, total, top = None, np.zeros(HIDDEN), np.full(HIDDEN, -np.inf, np.float32)
        for u in range(0, units, RUN):
            here = min(RUN, units - u)
            piece = data[u * UNIT : (u + here) * UNIT + STRIDE]
            ahead = STRIDE if u + here < units else 0  # the last window of a run reads the next run's first block
            piece = np.concatenate((piece, np.zeros(here * UNIT + ahead - len(piece), np.uint8)))
            blocks = w["embed"][piece].reshape(-1, BLOCK)
            conv = blocks[: here * UNIT // STRIDE] @ w["near"]
            far = blocks[1:] @ w["far"]
            conv[: len(far)] += far
            unit = conv.reshape(here, UNIT // STRIDE, FILTERS).max(axis=1)
            joined = unit if before is None else np.concatenate((before, unit))
            before = unit[-1:]
            pooled = np.maximum(joined[:-1], joined[1:]) if units > 1 else joined
            if len(pooled):
                hidden = np.maximum(pooled @ w["hidden"] + w["hidden_bias"], 0)
                total += hidden.sum(axis=0, dtype=float)
                top = np.maximum(top, hidden.max(axis=0))
        both = np.concatenate(((total / max(units - 1, 1)).astype(np.float32), top))
        logit = float((both @ w["out"] + w["out_bias"])[0])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probabilities of texts; a text longer than ``PIECE`` bytes is worked on in runs, so memory does not grow with it."""
        if not self.fitted:
            return np.full(len(texts), self.share)
        buffer = TextBuffer(texts)
        long = np.diff(buffer.offsets) > PIECE
        if not long.any():
            return self.forward(Layout(buffer)).astype(float) if len(buffer) else np.zeros(0)
        out = np.zeros(len(buffer))
        for i in np.flatnonzero(long):
            out[i] = self.forward_long(buffer.data[buffer.offsets[i] : buffer.offsets[i + 1]])
        if not long.all():
            out[~long] = self.score(texts.filter(pa.array(~long)))
        return out


def fit_quality_model(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Train on at most ``2 * sample`` labelled rows for which ``train`` holds (a condition on the id)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & train)
    counts = {r[0]: r[1] for r in known.groupBy(label_col).count().collect()}
    if not counts:
        return QualityModel()
    model = QualityModel(share=counts.get(1, 0) / sum(counts.values()))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(31)), F.lit(1 << 20))
    part = {k: int(min(1.0, sample / n) * (1 << 20)) for k, n in counts.items()}
    # The ids are a bounded sample by construction; the limit states the bound.
    ids = known.where(draw < F.when(F.col(label_col) == 1, part.get(1, 0)).otherwise(part.get(0, 0))).groupBy(id_col).agg(F.min(label_col).alias("label")).orderBy(F.xxhash64(F.col(id_col), F.lit(32)), id_col).limit(3 * sample)
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(34)), F.greatest(F.length(text) - TRAIN_CHARS, F.lit(0)) + 1)
    rows = docs.select(id_col, F.substring(text, start.cast("int"), F.lit(TRAIN_CHARS)).alias("text")).join(F.broadcast(ids), id_col).select("text", "label", F.xxhash64(F.col(id_col), F.lit(33)).alias("at")).orderBy("at", "text").limit(3 * sample).collect()
    model.fit([r["text"].encode() for r in rows], [r["label"] for r in rows])
    return model


def predict_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: the id, ``score`` and ``predicted``, over its whole text."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                score = model.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())], names=["id", "score", "predicted"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(frugal(run), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, PIECE):
                yield part.filter(pa.array(model.score(part.column(text_col)) >= threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
