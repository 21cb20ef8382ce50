"""Toxicity of whole texts: a convolutional classifier over hashed word embeddings.

Words are lower-cased and stripped of punctuation; the word, its first five and its
first three letters are hashed into three embedding tables whose rows are added, so
inflected and compound forms share what was learned.  Filters of one, two and three words slide
over the whole text, each keeps its highest answer, and a logistic layer weighs
them.  All labelled rows are learned from: their words are hashed once and stored,
counts of buckets are summed over them, and in each of ``EPOCHS`` rounds every task
descends over its own rows from the common network; Spark averages the changes, row of
a table by row.  The driver holds one network, never rows.  Labels weigh alike.

The threshold of each language is fitted on a fifth of the rows, kept apart from training, and
mapped onto one common threshold, so that one limit serves all languages.  The
language is judged by function words of the text; no other column is read.

Null and empty texts have no words and get the score of an empty text.  Repeated
rows are scored alike, an empty table gives no rows, extra columns are ignored.
Without labels of both kinds every text gets the share of label 1, or 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.labelled import held_out, labelled, labelled_texts
from tillscope.llm.texts import Words, bare, map_batches, split_words, sums, text_slices, word_hashes
from tillscope.session import scratch_path

THRESHOLD = 0.3
BUCKETS = 1 << 16
# Letters of a word that each table goes by; None is all of them.
STEMS = (None, 5, 3)
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
# Positions whose answers are held at once.
POSITIONS = 1 << 17

# Function words that tell four languages apart; anything else is "other".
FUNCTION_WORDS = {
    "en": "the of and to is that it with was this by are from be".split(),
    "de": "der die und das ist nicht von zu mit den ein eine auf dem sich".split(),
    "fr": "le les et des est une du dans pour qui sur pas avec au".split(),
    "es": "el los y del las por con una para se su al lo como".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_LANGUAGE_OF = {word: i for i, words in enumerate(FUNCTION_WORDS.values()) for word in words}


def hashed_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of each vocabulary word, and the language (index) of each row."""
    plain = [bare(word) for word in words.vocabulary]
    marks = np.zeros((len(plain) + 1, len(LANGUAGES) - 1))
    for i, word in enumerate(plain):
        if word in _LANGUAGE_OF:
            marks[i, _LANGUAGE_OF[word]] = 1
    votes = sums(marks[words.codes], words.starts)
    language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES) - 1)
    hashes = [word_hashes(plain if stem is None else [w[:stem] for w in plain]) for stem in STEMS]
    return (np.stack(hashes, axis=1) & np.uint64(BUCKETS - 1)).astype(np.int64), language


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Network:
    """Parameters, and answers for a slice of words."""

    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.tables = [draw.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32) for _ in STEMS]
        self.filters = [draw.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.uniform(0.2, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.level = np.full(1, -2, np.float32)

    def dense(self) -> list[np.ndarray]:
        """All but the embedding tables."""
        return [*self.filters, self.bias, self.out, self.level]

    def flat(self) -> np.ndarray:
        """A copy of all parameters, tables first, in rows as wide as an embedding."""
        dense = np.concatenate([p.ravel() for p in self.dense()])
        room = np.zeros(-len(dense) % DIMENSIONS, np.float32)
        return np.concatenate([*self.tables, np.concatenate([dense, room]).reshape(-1, DIMENSIONS)])

    def copy(self, flat: np.ndarray | None = None) -> Network:
        """A network of its own with the same parameters, or with those of ``flat``."""
        flat = self.flat() if flat is None else flat
        other = object.__new__(Network)
        other.tables = [t.copy() for t in np.split(flat[: len(STEMS) * BUCKETS], len(STEMS))]
        parts, at = [], 0
        dense = flat[len(STEMS) * BUCKETS :].ravel()
        for own in self.dense():
            parts.append(dense[at : at + own.size].reshape(own.shape).copy())
            at += own.size
        *other.filters, other.bias, other.out, other.level = parts
        return other

    def embed(self, slots: np.ndarray) -> np.ndarray:
        pad = np.zeros((1, DIMENSIONS), np.float32)
        return np.concatenate([sum(t[own] for t, own in zip(self.tables, slots.T, strict=True)), pad])

    def steps(self, embedded: np.ndarray) -> list[list[np.ndarray]]:
        """What each word adds to each filter, by width and place in the filter."""
        return [[embedded @ matrix for matrix in filters] for filters in self.filters]

    def answers(self, steps: list[list[np.ndarray]], codes: np.ndarray) -> np.ndarray:
        """Filter answers at every position of a padded stream of codes."""
        n = len(codes) - max(WIDTHS) + 1
        parts = [sum(step[codes[k : k + n]] for k, step in enumerate(own)) for own in steps]
        return np.concatenate(parts, axis=1) + self.bias

    def pooled(self, slots: np.ndarray, words: Words) -> np.ndarray:
        """Highest answers per row, taken block by block along the stream."""
        codes, starts = padded(words, len(slots))
        steps, reach = self.steps(self.embed(slots)), max(WIDTHS) - 1
        highest = np.full((len(starts), len(self.bias)), -np.inf, np.float32)
        for at in range(0, len(codes) - reach, POSITIONS):
            end = min(at + POSITIONS, len(codes) - reach)
            first = int(np.searchsorted(starts, at, side="right")) - 1
            last = int(np.searchsorted(starts, end, side="left"))
            cuts = np.maximum(starts[first:last] - at, 0)
            top = np.maximum.reduceat(self.answers(steps, codes[at : end + reach]), cuts, axis=0)
            highest[first:last] = np.maximum(highest[first:last], top)
        return highest

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.level


def padded(words: Words, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with room for the widest filter after every row, and each row's start."""
    gap = max(WIDTHS)
    rows = len(words.starts) - 1
    lengths = np.diff(words.starts)
    starts = words.starts[:-1] + gap * np.arange(rows)
    codes = np.full(len(words.codes) + gap * rows + gap, pad, np.int64)
    codes[np.arange(len(words.codes)) + gap * np.repeat(np.arange(rows), lengths)] = words.codes
    return codes, starts


# Fixed-point steps in which sums travel, so that they do not depend on the order of tasks.
UNIT = 2.0**32
BROADCAST_ROWS = 1_000_000
# Logits of the rows kept apart are counted in steps of one 256th.
STEP = 256
VALUES = [f"_{i}" for i in range(2 * DIMENSIONS)]


def hashed_rows(rows: DataFrame) -> DataFrame:
    """doc_id, label, language and the table slots of every word (three 16-bit numbers each), row by row."""
    kind = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("label", T.IntegerType()),
            T.StructField("language", T.IntegerType()),
            T.StructField("slots", T.BinaryType()),
        ]
    )

    def hash_slices(batches):
        for batch in text_slices(batches, "text"):
            words = split_words(batch.column("text"))
            slots, language = hashed_words(words)
            own = slots.astype(np.uint16)
            packed = [own[words.codes[a:b]].tobytes() for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(language, pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "label", "language", "slots"],
            )

    return map_batches(rows.select("doc_id", "label", "text"), hash_slices, kind)


def _unpacked(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of each row, and the labels."""
    slots = [np.frombuffer(v.as_buffer(), np.uint16).reshape(-1, len(STEMS)) for v in batch.column("slots")]
    return slots, batch.column("label").to_numpy().astype(np.int64)


def _as_words(rows: list[np.ndarray]) -> tuple[Words, np.ndarray]:
    """Rows as codes of their different words, and the slots of these."""
    flat = np.concatenate([*rows, np.zeros((0, len(STEMS)), np.uint16)]).astype(np.int64)
    keys, codes = np.unique(flat[:, 0] << 32 | flat[:, 1] << 16 | flat[:, 2], return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return Words(codes, starts, []), np.stack([keys >> 32, keys >> 16 & 0xFFFF, keys & 0xFFFF], axis=1)


def _counted(hashed: DataFrame) -> np.ndarray:
    """Texts of each label (0, 1) that hold the words of each bucket, tables one after another."""

    def count(batches):
        counts = np.zeros((2, len(STEMS) * BUCKETS), np.int64)
        for batch in batches:
            for slots, label in zip(*_unpacked(batch), strict=True):
                for i, column in enumerate(slots.T):
                    counts[label, i * BUCKETS + np.unique(column).astype(np.int64)] += 1
        met = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[0, met]), pa.array(counts[1, met])], names=["key", "clean", "toxic"])

    found = map_batches(hashed.select("label", "slots"), count, "key long, clean long, toxic long")
    sums = found.groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, len(STEMS) * BUCKETS))
    key = sums.column("key").to_numpy()
    counts[0, key], counts[1, key] = sums.column("clean").to_numpy(), sums.column("toxic").to_numpy()
    return counts


def _start_from_odds(network: Network, counts: np.ndarray, size: np.ndarray) -> None:
    """First embedding dimension: how much oftener texts of label 1 hold the words of a bucket."""
    rate = np.log((counts + 1) / (size[:, None] + 2))
    odds = np.where(counts.sum(axis=0) > 0, rate[1] - rate[0], 0)
    for table, own in zip(network.tables, np.split(odds, len(STEMS)), strict=True):
        table[:, 0] = np.clip(own, -2, 8) / 4
    for filters in network.filters:
        filters[0, 0, :] = np.abs(filters[0, 0, :]) + 0.3
    network.bias -= 0.8


def learn(network: Network, history: Network, rows: list[np.ndarray], labels: np.ndarray, balance: np.ndarray) -> None:
    """One step of gradient descent, each parameter at its own pace; ``balance`` weighs the labels."""
    words, slots = _as_words(rows)
    lengths = np.diff(words.starts)
    codes, starts = padded(words, len(slots))
    embedded = network.embed(slots)
    answers = network.answers(network.steps(embedded), codes)
    best = np.stack([s + answers[s : s + max(1, n)].argmax(axis=0) for s, n in zip(starts, lengths, strict=True)])
    top = np.take_along_axis(answers, best, axis=0)
    p = 1 / (1 + np.exp(-np.clip(network.logits(top), -30, 30)))
    off = (balance[labels] * (p - labels) / len(rows)).astype(np.float32)
    grad_top = off[:, None] * network.out * (top > 0)
    grad_embedded = np.zeros_like(embedded)
    grads = []
    for i, filters in enumerate(network.filters):
        columns = slice(i * FILTERS, (i + 1) * FILTERS)
        g, at = grad_top[:, columns], best[:, columns]
        grad = np.zeros_like(filters)
        for k in range(len(filters)):
            here = codes[at + k]
            grad[k] = np.einsum("bf,bfd->df", g, embedded[here])
            np.add.at(grad_embedded, here, g[:, :, None] * filters[k].T)
        grads.append(grad)
    grads += [grad_top.sum(axis=0), np.maximum(top, 0).T @ off, off.sum(keepdims=True)]
    for parameter, seen, grad in zip(network.dense(), history.dense(), grads, strict=True):
        seen += grad * grad
        parameter -= 0.05 * grad / np.sqrt(seen)
    touched = np.flatnonzero(grad_embedded[:-1].any(axis=1))
    for table, seen, slot in zip(network.tables, history.tables, slots[touched].T, strict=True):
        own, where = np.unique(slot, return_inverse=True)
        grad = np.zeros((len(own), DIMENSIONS), np.float32)
        np.add.at(grad, where, grad_embedded[touched])
        seen[own] += grad * grad
        table[own] -= 0.05 * grad / np.sqrt(seen[own])


def _one_round(hashed: DataFrame, network: Network, history: Network, balance: np.ndarray, seed: int):
    """Every task learns from all its rows, from the same start; their changes are averaged.

    A row of a table changes by the average over the tasks that changed it.
    """

    def descend(batches):
        own, seen = network.copy(), history.copy()
        draw, any_rows = np.random.default_rng(seed), False
        for batch in batches:
            slots, labels = _unpacked(batch)
            order, any_rows = draw.permutation(len(labels)), any_rows or len(labels) > 0
            for chosen in np.array_split(order, max(1, len(order) // 64)) if len(order) else []:
                learn(own, seen, [slots[r] for r in chosen], labels[chosen], balance)
        if any_rows:
            change = np.concatenate([own.flat() - network.flat(), seen.flat() - history.flat()], axis=1)
            key = np.flatnonzero(change.any(axis=1))
            whole = np.round(change[key].astype(np.float64) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c) for c in whole.T)], names=["key", *VALUES])

    kind = "key long, " + ", ".join(f"{name} long" for name in VALUES)
    changes = map_batches(hashed.select("label", "slots"), descend, kind)
    # At most one row per row of the tables, whatever the number of documents.
    means = changes.groupBy("key").agg(*(F.sum(v).alias(v) for v in VALUES), F.count("*").alias("n")).toArrow()
    key, n = means.column("key").to_numpy(), means.column("n").to_numpy()
    change = np.stack([means.column(v).to_numpy() / (UNIT * n) for v in VALUES], axis=1).astype(np.float32)
    after = []
    for model, own in ((network, change[:, :DIMENSIONS]), (history, change[:, DIMENSIONS:])):
        flat = model.flat()
        flat[key] += own
        after.append(model.copy(flat))
    return after


def _thresholds(apart: DataFrame, network: Network) -> np.ndarray:
    """The best limit of each language over all rows kept apart; languages with few take that of all."""

    def count(batches):
        for batch in batches:
            words, slots = _as_words(_unpacked(batch)[0])
            logits = np.clip(network.logits(network.pooled(slots, words)), -100, 100)
            yield pa.RecordBatch.from_arrays(
                [batch.column("language"), batch.column("label"), pa.array(np.floor(logits * STEP).astype(np.int64))],
                names=["language", "label", "place"],
            )

    found = map_batches(apart.select("language", "label", "slots"), count, "language int, label int, place long")
    # A bounded number of places, whatever the number of documents.
    rows = np.array([tuple(r) for r in found.groupBy("language", "label", "place").count().collect()], np.int64).reshape(-1, 4)
    everyone = _best_threshold(rows)
    limits = np.full(len(LANGUAGES), everyone)
    for i in range(len(LANGUAGES)):
        own = rows[rows[:, 0] == i]
        if min(own[own[:, 1] == v, 3].sum() for v in (0, 1)) >= 20:
            limits[i] = _best_threshold(own)
    return limits


def _best_threshold(rows: np.ndarray) -> float:
    """Middle of the widest best gap: the limit with the highest F1, from (language, label, place, number)."""
    if len(set(rows[:, 1].tolist())) < 2:
        return 0.0
    place, where = np.unique(rows[:, 2], return_inverse=True)
    number, hits = np.zeros(len(place)), np.zeros(len(place))
    np.add.at(number, where, rows[:, 3])
    np.add.at(hits, where, rows[:, 3] * rows[:, 1])
    place, number, hits = place[::-1], number[::-1], hits[::-1]
    best = int((2 * np.cumsum(hits) / (np.cumsum(number) + hits.sum())).argmax())
    below = place[best + 1] if best + 1 < len(place) else place[best] - STEP
    return float((place[best] + below + 1) / 2 / STEP)


def fit_toxicity(documents: DataFrame, labels: DataFrame, seed: int = 0):
    """Learn from all labelled rows, a fifth of them kept apart for the thresholds; None without both labels."""
    spark = documents.sparkSession
    known, counts = labelled(labels, "toxic")
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    # Narrow rows; so few of them are sent to the texts, and only texts with a label are shuffled.
    rows = labelled_texts(documents, F.broadcast(known) if total <= BROADCAST_ROWS else known)
    path = scratch_path(spark, "toxicity")
    # Dealt by a hash of the id, so that every file is a fair part of all rows.
    hashed_rows(rows).withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 4).sortWithinPartitions(
        F.xxhash64("doc_id"), "doc_id"
    ).write.option("compression", "zstd").parquet(path)
    hashed = spark.read.parquet(path)
    size = np.zeros((2, 2))
    for row in hashed.groupBy("apart", "label").count().collect():
        size[int(row["apart"]), row["label"]] = row["count"]
    if not size.sum(axis=0).all():
        return None, float(size[:, 1].sum() / size.sum()) if size.sum() else 0.0
    learned, apart = hashed.where("NOT apart"), hashed.where("apart")
    network = Network(seed)
    history = network.copy(np.full_like(network.flat(), 1e-3))
    _start_from_odds(network, _counted(learned), size[0])
    balance = size[0].sum() / (2 * np.maximum(size[0], 1))
    for turn in range(EPOCHS):
        network, history = _one_round(learned, network, history, balance, seed + turn)
    return (network, _logit(THRESHOLD) - _thresholds(apart, network)), share


def score_toxicity(documents: DataFrame, model, share: float) -> DataFrame:
    """doc_id, score in 0..1 and predicted (score >= 0.3) of every row."""
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]
    )

    def score(batches):
        for batch in text_slices(batches, "text"):
            if model is None:
                answer = np.full(batch.num_rows, share)
            else:
                network, shift = model
                words = split_words(batch.column("text"))
                slots, language = hashed_words(words)
                logits = network.logits(network.pooled(slots, words)) + shift[language]
                answer = 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(answer, pa.float64())], names=["doc_id", "score"]
            )

    scored = map_batches(documents.select("doc_id", "text"), score, schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model, share = fit_toxicity(documents, labels)
    scored = score_toxicity(documents, model, share)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
