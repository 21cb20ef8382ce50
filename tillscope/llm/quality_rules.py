"""Quality rules: counted base rules and a hashed n-gram regression for the verdict.

The base rules count words, symbols, repeated lines and repeated word windows of the
whole text.  The method is a logistic regression over hashed words, word pairs and
three-letter pieces of words (their shares of the text) and a few signals of style,
trained on a bounded sample of labelled rows (``PER_CLASS`` of each label).  Its
answer is calibrated to a probability on rows kept apart and compared with the
fixed threshold ``KEEP``.  Scoring runs in Arrow batches.

Null texts have no words; texts without words, or with fewer than 50, fail the base
rules.  Without labels of both kinds the base rules decide alone.  Repeated rows
are judged alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillscope.llm.labelled import labelled_sample
from tillscope.llm.style import Marks, marks, repeated_lines
from tillscope.llm.texts import Words, bare, map_batches, mix, split_words, sums, text_slices, word_hashes

PER_CLASS = 1500
KEEP = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50
BUCKETS = 1 << 16
EPOCHS = 6
SIGNALS = 7
SCALE = 10.0


class Parts(NamedTuple):
    """Hash slots of a slice: per word, per word pair, and letter pieces per vocabulary word."""

    word: np.ndarray
    pair: np.ndarray
    piece: np.ndarray
    piece_ends: np.ndarray


def hash_parts(words: Words) -> Parts:
    mask = np.uint64(BUCKETS - 1)
    hashes = word_hashes([bare(w) for w in words.vocabulary])
    word = (hashes & mask).astype(np.int64)
    own = hashes[words.codes]
    pair = np.zeros(len(own), np.int64)
    pair[1:] = (mix(own[:-1] * np.uint64(3) + own[1:]) & mask).astype(np.int64)
    # Letter pieces keep case and punctuation, with a mark at each end of the word.
    text = "".join([f" {w} " for w in words.vocabulary])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words.vocabulary), np.int64, len(words.vocabulary))
    ends = np.concatenate([[0], np.cumsum(length)])
    inside = np.arange(ends[-1]) + np.repeat(2 * np.arange(len(length)), length)
    packed = (points[inside] << np.uint64(42)) ^ (points[inside + 1] << np.uint64(21)) ^ points[inside + 2]
    return Parts(word, pair, (mix(packed) & mask).astype(np.int64), ends)


def signals(words: Words, found: Marks, lines: np.ndarray) -> np.ndarray:
    """A few shares that describe the style of each text."""
    n = np.maximum(np.diff(words.starts), 1)[:, None]
    per_word = np.stack(
        [
            np.minimum(found.symbols[words.codes], 3),
            found.upper[words.codes],
            found.repeated,
            found.same_as_last,
            found.points[words.codes] / 10,
        ],
        axis=1,
    ).astype(np.float64)
    shares = sums(per_word, words.starts) / n
    return np.concatenate([shares, np.log1p(n) / 10, np.minimum(lines[:, None] / 10, 2)], axis=1)


class Regression:
    """Weights of the hashed parts and of the signals, and the calibration."""

    def __init__(self):
        self.word, self.pair, self.piece = (np.zeros(BUCKETS) for _ in range(3))
        self.signal = np.zeros(SIGNALS)
        self.level = 0.0
        self.slope, self.offset = 1.0, 0.0

    def logits(self, words: Words, parts: Parts, style: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(words.starts), 1)
        by_word = sums(self.piece[parts.piece], parts.piece_ends) / np.maximum(np.diff(parts.piece_ends), 1)
        per_word = (self.word[parts.word] + by_word)[words.codes] + self.pair[parts.pair]
        return SCALE * sums(per_word, words.starts) / n + style @ self.signal + self.level

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))





def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Regression:
    """Fit on four fifths of the texts, calibrate on the rest with the weights of the classes."""
    arrow = pa.array(texts, pa.string())
    words = split_words(arrow)
    parts, found = hash_parts(words), marks(words)
    style = signals(words, found, repeated_lines(arrow))
    model, draw = Regression(), np.random.default_rng(seed)
    apart = np.arange(len(texts)) % 5 == 4
    tables = [model.word, model.pair, model.piece]
    history = [np.full(BUCKETS, 1e-4) for _ in tables]
    signal_history, level_history = np.full(SIGNALS, 1e-4), 1e-4
    lengths = np.diff(words.starts)
    piece_count = np.maximum(np.diff(parts.piece_ends), 1)
    for _ in range(EPOCHS):
        for chosen in np.array_split(draw.permutation(np.flatnonzero(~apart)), max(1, (~apart).sum() // 64)):
            places = np.concatenate([np.arange(words.starts[r], words.starts[r + 1]) for r in chosen]).astype(np.int64)
            row = np.repeat(np.arange(len(chosen)), lengths[chosen])
            share = SCALE / np.maximum(lengths[chosen], 1)[row]
            code = words.codes[places]
            used, local = np.unique(code, return_inverse=True)
            take = np.concatenate([np.arange(parts.piece_ends[c], parts.piece_ends[c + 1]) for c in used] or [[]])
            take = take.astype(np.int64)
            own = np.repeat(np.arange(len(used)), np.diff(parts.piece_ends)[used])
            by_word = np.bincount(own, model.piece[parts.piece[take]], len(used)) / piece_count[used]
            per_word = model.word[parts.word[code]] + by_word[local] + model.pair[parts.pair[places]]
            logit = np.bincount(row, per_word * share, len(chosen)) + style[chosen] @ model.signal + model.level
            off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]) / len(chosen)
            pull = off[row] * share
            pull_word = np.bincount(local, pull, len(used))
            pull_piece = (pull_word / piece_count[used])[own]
            slots = [parts.word[code], parts.pair[places], parts.piece[take]]
            for table, seen, slot, grad in zip(tables, history, slots, [pull, pull, pull_piece], strict=True):
                total = np.bincount(slot, grad, BUCKETS)
                seen += total * total
                table -= 0.1 * total / np.sqrt(seen) + 1e-4 * table
            grad = style[chosen].T @ off
            signal_history += grad * grad
            model.signal -= 0.2 * grad / np.sqrt(signal_history)
            level_history += off.sum() ** 2
            model.level -= 0.2 * off.sum() / np.sqrt(level_history)
    logits = model.logits(words, parts, style)
    model.slope, model.offset = calibrate(logits[apart], labels[apart], weights[apart])
    return model


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by damped Newton steps on softened labels."""
    if not len(logits) or labels.min() == labels.max():
        return 1.0, 0.0
    positive = (weights * labels).sum()
    negative = (weights * (1 - labels)).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    fit = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        gradient = x.T @ (weights * (p - target))
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        fit -= np.clip(np.linalg.solve(curve, gradient), -1, 1)
    return float(max(fit[0], 1e-3)), float(fit[1])


def fit_quality(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Regression | None:
    """Train on at most ``per_class`` labelled rows of each label; None without both labels."""
    sample, counts = labelled_sample(documents, labels, "quality", per_class)
    rows = sorted((r["doc_id"], r["label"], r["text"]) for r in sample.collect())
    y = np.array([label for _, label, _ in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    weights = np.array([counts[int(v)] / (y == v).sum() for v in y])
    order = np.random.default_rng(1).permutation(len(rows))
    return train([rows[i][2] for i in order], y[order], weights[order])


def judge_batches(batches, model: Regression | None):
    """The counts, the base verdict, the probability and the verdict of each row."""
    for batch in text_slices(batches, "text"):
        texts = batch.column("text")
        words = split_words(texts)
        found, lines = marks(words), repeated_lines(texts)
        n_words = np.diff(words.starts)
        columns = [
            sums(found.points[words.codes], words.starts),
            sums(found.symbols[words.codes], words.starts),
            lines,
            sums(found.repeated.astype(np.int64), words.starts),
        ]
        failed = (n_words < LEAST_WORDS) | (100 * columns[3] > MOST_REPEATED * n_words)
        if model is None:
            chance = np.where(failed, 0.0, 1.0)
        else:
            chance = model.probability(model.logits(words, hash_parts(words), signals(words, found, lines)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in [n_words, *columns]),
                pa.array(failed),
                pa.array(~failed & (chance >= KEEP)),
                pa.array(chance, pa.float64()),
            ],
            names=["doc_id", *COLUMNS],
        )


COLUMNS = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(),
    "kept": T.BooleanType(),
    "probability": T.DoubleType(),
}


def judge(documents: DataFrame, model: Regression | None) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType)])
    for name, kind in COLUMNS.items():
        schema = schema.add(name, kind)
    return map_batches(documents.select("doc_id", "text"), lambda batches: judge_batches(batches, model), schema)


def quality_rules(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, counts, base_failed, kept and the probability for every document."""
    return judge(documents, fit_quality(documents, labels, per_class))


def keep_good(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the rules keep, all columns as they are.

    The verdict is taken from the row's own text inside one pass, so rows that share
    an id are judged one by one.
    """
    model = fit_quality(documents, labels, per_class)

    def keep(batches):
        for batch in text_slices(batches, "text"):
            verdict = next(judge_batches([batch.select(["doc_id", "text"])], model))
            yield batch.filter(verdict.column("kept"))

    return map_batches(documents, keep, documents.schema)
