"""Quality of whole texts by attention over their passages (multiple-instance learning).

A text is cut into passages of ``PASSAGE`` words, to its end.  Each passage is
encoded: the mean of hashed word embeddings plus a projection of style marks goes
through tanh.  Gated attention weighs the encoded passages (softmax over the text of
w . (tanh(V h) * sigmoid(U h))), and a logistic layer scores their weighted sum.
Everything is learned in numpy from labels of whole documents, on a bounded sample
(``PER_CLASS`` of each label); the score is calibrated to a probability on rows kept
apart.  Scoring runs in Arrow batches.

Null and empty texts count as one passage without words.  Repeated rows are scored
alike, an empty table gives no rows, other columns are ignored.  Without labels of
both kinds every text gets the share of label 1, or 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.labelled import held_out, labelled_sample
from tillscope.llm.quality_rules import calibrate
from tillscope.llm.style import marks, repeated_lines, row_of
from tillscope.llm.texts import Words, bare, map_batches, split_words, text_slices, word_hashes

PER_CLASS = 1500
THRESHOLD = 0.7
PASSAGE = 64
BUCKETS = 1 << 14
DIMENSIONS = 16
ATTENTION = 8
STYLE = 9
EPOCHS = 8


class Passages(NamedTuple):
    """Word slots, the passage of each word, style of each passage, first passage of each row."""

    slots: np.ndarray
    passage: np.ndarray
    words: np.ndarray
    style: np.ndarray
    starts: np.ndarray


def cut_passages(texts: pa.Array, words: Words) -> Passages:
    rows = row_of(words)
    lengths = np.diff(words.starts)
    number = np.maximum(-(-lengths // PASSAGE), 1)
    starts = np.concatenate([[0], np.cumsum(number)])
    place = np.arange(len(rows)) - words.starts[:-1][rows]
    passage = starts[:-1][rows] + place // PASSAGE
    total = int(starts[-1])
    found = marks(words)
    size = np.bincount(passage, minlength=total)
    # Different words per passage, by one sort of (passage, word).
    key = np.sort(passage * max(1, len(words.vocabulary)) + words.codes)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    different = np.bincount(key[new] // max(1, len(words.vocabulary)), minlength=total)

    def share(values):
        return np.bincount(passage, values, total) / np.maximum(size, 1)

    codes = words.codes
    points = np.maximum(found.points, 1)
    style = np.stack(
        [
            share(np.minimum(found.symbols[codes], 3)),
            share(found.upper[codes]),
            share(found.repeated),
            share(found.same_as_last),
            share((found.letters / points)[codes]),
            share(np.minimum(found.points, 30)[codes]) / 10,
            1 - different / np.maximum(size, 1),
            np.log1p(size) / 4,
            np.repeat(np.minimum(np.log1p(repeated_lines(texts)), 4), number) / 4,
        ],
        axis=1,
    )
    hashes = word_hashes([bare(w) for w in words.vocabulary])
    slots = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    return Passages(slots, passage, codes, style, starts)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Parameters, and scores of the rows of a slice."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, DIMENSIONS))
        self.style = draw.normal(0, 0.5, (STYLE, DIMENSIONS))
        self.bias = np.zeros(DIMENSIONS)
        self.v = draw.normal(0, 0.3, (DIMENSIONS, ATTENTION))
        self.u = draw.normal(0, 0.3, (DIMENSIONS, ATTENTION))
        self.w = draw.normal(0, 0.3, ATTENTION)
        self.out = draw.normal(0, 0.3, DIMENSIONS)
        self.level = np.zeros(1)
        self.slope, self.offset = 1.0, 0.0

    def encode(self, slots, passage, style) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages, and the number of words in each."""
        total = len(style)
        size = np.maximum(np.bincount(passage, minlength=total), 1)
        # One dimension at a time, so that a very long text needs a few numbers per word.
        mean = np.stack([np.bincount(passage, c[slots], total) for c in np.ascontiguousarray(self.table.T)], axis=1)
        mean = mean / size[:, None]
        return np.tanh(mean + style @ self.style + self.bias), size

    def attend(self, hidden, starts):
        """Weights of the passages, and what their gradients need."""
        a, b = np.tanh(hidden @ self.v), _sigmoid(hidden @ self.u)
        energy = (a * b) @ self.w
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        top = np.maximum.reduceat(energy, starts[:-1])
        power = np.exp(energy - top[row])
        return power / np.add.reduceat(power, starts[:-1])[row], a, b, row

    def logits(self, part: Passages) -> np.ndarray:
        hidden, _ = self.encode(part.slots[part.words], part.passage, part.style)
        weight, *_ = self.attend(hidden, part.starts)
        return np.add.reduceat(weight * (hidden @ self.out), part.starts[:-1]) + self.level[0]

    def score(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logits + self.offset)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> AttentionModel:
    """Learn from four fifths of the texts, calibrate on the rest with the weights of the classes."""
    arrow = pa.array(texts, pa.string())
    words = split_words(arrow)
    part = cut_passages(arrow, words)
    model, draw = AttentionModel(seed), np.random.default_rng(seed)
    apart = np.arange(len(texts)) % 5 == 4
    learned = [model.style, model.bias, model.v, model.u, model.w, model.out, model.level]
    history = [np.full(p.shape, 1e-4) for p in learned]
    table_history = np.full(model.table.shape, 1e-4)
    for _ in range(EPOCHS):
        for chosen in np.array_split(draw.permutation(np.flatnonzero(~apart)), max(1, (~apart).sum() // 64)):
            place = np.concatenate([np.arange(words.starts[r], words.starts[r + 1]) for r in chosen]).astype(np.int64)
            own = np.concatenate([np.arange(part.starts[r], part.starts[r + 1]) for r in chosen]).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(np.diff(part.starts)[chosen])])
            renumber = np.zeros(int(part.starts[-1]), np.int64)
            renumber[own] = np.arange(len(own))
            slots, passage = part.slots[part.words[place]], renumber[part.passage[place]]
            style = part.style[own]
            hidden, size = model.encode(slots, passage, style)
            weight, a, b, row = model.attend(hidden, starts)
            value = hidden @ model.out
            logit = np.add.reduceat(weight * value, starts[:-1]) + model.level[0]
            off = (_sigmoid(logit) - labels[chosen]) / len(chosen)

            grad_energy = weight * (value - (logit - model.level[0])[row]) * off[row]
            grad_a = grad_energy[:, None] * b * model.w * (1 - a * a)
            grad_b = grad_energy[:, None] * a * model.w * b * (1 - b)
            grad_hidden = (off[row] * weight)[:, None] * model.out + grad_a @ model.v.T + grad_b @ model.u.T
            inner = grad_hidden * (1 - hidden * hidden)
            grads = [
                style.T @ inner,
                inner.sum(axis=0),
                hidden.T @ grad_a,
                hidden.T @ grad_b,
                ((a * b) * grad_energy[:, None]).sum(axis=0),
                ((off[row] * weight)[:, None] * hidden).sum(axis=0),
                np.array([off.sum()]),
            ]
            for parameter, seen, grad in zip(learned, history, grads, strict=True):
                seen += grad * grad
                parameter -= 0.05 * grad / np.sqrt(seen)
            used, local = np.unique(slots, return_inverse=True)
            grad = np.zeros((len(used), DIMENSIONS))
            np.add.at(grad, local, (inner / size[:, None])[passage])
            table_history[used] += grad * grad
            model.table[used] -= 0.05 * grad / np.sqrt(table_history[used])
    logits = model.logits(part)
    model.slope, model.offset = calibrate(logits[apart], labels[apart], weights[apart])
    return model


def fit_passages(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """A model from at most ``per_class`` rows of each label (None without both), and the share of label 1."""
    sample, counts = labelled_sample(documents, labels, "quality", per_class)
    rows = sorted((r["doc_id"], r["label"], r["text"]) for r in sample.collect())
    y = np.array([label for _, label, _ in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None, float(y.mean()) if len(y) else 0.0
    weights = np.array([counts[int(v)] / (y == v).sum() for v in y])
    order = np.random.default_rng(1).permutation(len(rows))
    return train([rows[i][2] for i in order], y[order], weights[order]), float(np.average(y, weights=weights))


def score_passages(documents: DataFrame, model: AttentionModel | None, share: float) -> DataFrame:
    """doc_id, score in 0..1 and predicted (score >= 0.7) of every row."""
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]
    )

    def score(batches):
        for batch in text_slices(batches, "text"):
            if model is None:
                answer = np.full(batch.num_rows, share)
            else:
                texts = batch.column("text")
                answer = model.score(model.logits(cut_passages(texts, split_words(texts))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(answer, pa.float64())], names=["doc_id", "score"]
            )

    scored = map_batches(documents.select("doc_id", "text"), score, schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def passage_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model, share = fit_passages(documents, labels, per_class)
    scored = score_passages(documents, model, share)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
