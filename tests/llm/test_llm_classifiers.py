"""Quality rules, toxicity, passage quality: counts against plain Python, accuracy on rows kept apart."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillscope.llm import passage_quality, quality_rules, toxicity
from tillscope.llm.texts import bare, split_words, word_hashes

LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


ODD = [
    None, "", " \n\t\r\x0b\x0c", "a b c a b c a b c", "a\n a\na\n\n\n|\n|", "é🙂 ## <b>", "x " * 120, "a b a b a",
    "word\x85word\xa0word word word", "a b c\nd e f\na b c\n",
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")


@pytest.fixture(scope="module")
def rules(tables):
    return quality_rules.fit_quality(*tables)


def test_base_counts(spark, tables, rules):
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")
    table = tables[0].select("doc_id", "text").unionByName(odd)
    found = {r["doc_id"]: r for r in quality_rules.judge(table, rules).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for row in table.collect():
        got = found[row["doc_id"]]
        assert tuple(got[n] for n in names) == counts(row["text"]), row
        assert not (got["kept"] and got["base_failed"])
        assert got["kept"] == (not got["base_failed"] and got["probability"] >= quality_rules.KEEP)


def test_verdict_follows_labels(tables):
    judged = quality_rules.quality_rules(*tables).join(tables[1], "doc_id").where("not base_failed")
    # Rows whose remainder is 2 were not learned from.
    rows = judged.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"]]) > 0.97


def test_keep_good_keeps_columns(spark, rules):
    good = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, "short", "a"), (1, good, "b"), (None, good, None), (2, None, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    keep = quality_rules.judge_batches([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [good]})], rules)
    expected = 2 if next(keep).column("kept")[0].as_py() else 0
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    kept = quality_rules.keep_good(table, labels)
    assert kept.columns == table.columns
    # Without labels the base rules decide alone.
    assert sorted(r["kept"] or "" for r in kept.collect()) == ["", "b"] and expected in (0, 2)
    assert quality_rules.keep_good(table.limit(0), labels).collect() == []


def area(score, label):
    order = np.argsort(np.argsort(score)) + 1
    label = np.array(label) == 1
    return (order[label].sum() - label.sum() * (label.sum() + 1) / 2) / (label.sum() * (~label).sum())


def test_passage_quality_on_rows_kept_apart(tables):
    scored = passage_quality.passage_quality(*tables)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == tables[0].count()
    rows = scored.join(tables[1], "doc_id").where("held_out").collect()
    assert area([r["score"] for r in rows], [r["quality"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def plain_passage_score(model, text):
    """One text passage by passage, number by number; only its style marks come from the library."""
    own = pa.array([text], pa.string())
    style = passage_quality.cut_passages(own, split_words(own)).style
    words = WORD.findall(text or "")
    passages = [words[i : i + passage_quality.PASSAGE] for i in range(0, len(words), passage_quality.PASSAGE)] or [[]]
    assert len(passages) == len(style)
    hidden, energy = [], []
    for passage, marked in zip(passages, style, strict=True):
        slots = [int(h) % passage_quality.BUCKETS for h in word_hashes([bare(w) for w in passage])]
        h = [
            math.tanh(
                sum(model.table[s][d] for s in slots) / max(1, len(slots))
                + sum(m * model.style[i][d] for i, m in enumerate(marked))
                + model.bias[d]
            )
            for d in range(passage_quality.DIMENSIONS)
        ]
        hidden.append(h)
        energy.append(
            sum(
                model.w[k]
                * math.tanh(sum(x * model.v[d][k] for d, x in enumerate(h)))
                / (1 + math.exp(-sum(x * model.u[d][k] for d, x in enumerate(h))))
                for k in range(passage_quality.ATTENTION)
            )
        )
    share = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
    pooled = [sum(w * h[d] for w, h in zip(share, hidden, strict=True)) for d in range(passage_quality.DIMENSIONS)]
    logit = sum(x * o for x, o in zip(pooled, model.out, strict=True)) + model.level[0]
    return 1 / (1 + math.exp(-(model.slope * logit + model.offset)))


def test_passage_scores_equal_plain_attention(spark):
    rng = np.random.default_rng(8)
    model = passage_quality.AttentionModel(3)
    model.table[:] = rng.normal(0, 1, model.table.shape)
    model.bias[:], model.level[:] = rng.normal(0, 1, model.bias.shape), 0.3
    model.slope, model.offset = 1.7, -0.2
    vocabulary = ["alpha", "Beta,", "gamma!", "x1", "#", "and", "and"]
    sizes = [1, 63, 64, 65, 128, 129, 700, 5000]
    texts = [*ODD, *(" ".join(rng.choice(vocabulary, n)) for n in sizes), "alpha\nBeta,\nalpha\n" * 50]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in passage_quality.score_passages(table, model, 0.0).collect()}
    for i, text in enumerate(texts):
        assert got[i]["score"] == pytest.approx(plain_passage_score(model, text), abs=1e-9)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert len({round(r["score"], 6) for r in got.values()}) > 10


def test_toxicity_on_rows_kept_apart(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    some = documents.join(labels, "doc_id")
    scored = toxicity.toxicity(some.select("doc_id", "text", "lang"), labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert area([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.93
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.02 and np.mean(caught) > 0.75


@pytest.mark.parametrize(
    ("score", "fit", "label"),
    [
        (toxicity.toxicity, toxicity.fit_toxicity, "toxic"),
        (passage_quality.passage_quality, passage_quality.fit_passages, "quality"),
    ],
)
def test_edge_cases(spark, score, fit, label):
    rows = [(1, None, "x"), (1, "", "y"), (None, "some words", "z"), (2, "long " * 30_000, None), (2, "long " * 30_000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    kind = "doc_id long, quality long, toxic long"
    nothing = spark.createDataFrame([], kind)
    found = score(table, nothing).collect()
    assert len(found) == 5 and {r["score"] for r in found} == {0.0}
    assert score(table.limit(0), nothing).collect() == []
    texts = [(i, f"plain words number {i}" if i % 2 else f"awful stuff {i}", "") for i in range(200)]
    more = spark.createDataFrame(texts, "doc_id long, text string, score string").unionByName(table)
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in [*range(200), 7, 7]] + [(None, 1, 1), (3, None, None)], kind)
    found = score(more, marks).collect()
    assert len(found) == 205 and all(0 <= r["score"] <= 1 for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r["doc_id"], []).append(r["score"])
    assert by_text[2].count(by_text[2][-1]) >= 2


def test_convolution_in_blocks(monkeypatch):
    draw = np.random.default_rng(0)
    texts = [" ".join(draw.choice(list("abcdefghij"), n)) for n in draw.integers(0, 40, 200)] + ["", None, "a " * 3000]
    words = split_words(pa.array(texts, pa.string()))
    slots, _ = toxicity.hashed_words(words)
    network = toxicity.Network(3)
    whole = network.pooled(slots, words)
    monkeypatch.setattr(toxicity, "POSITIONS", 77)
    assert (network.pooled(slots, words) == whole).all() and np.isfinite(whole).all()
    # Against a window by window count of one text.
    own = network.embed(slots)
    line = [own[c] for c in words.codes[words.starts[0] : words.starts[1]]] + [np.zeros(toxicity.DIMENSIONS)] * 3
    n = words.starts[1] - words.starts[0]
    for i, filters in enumerate(network.filters):
        best = max(tuple(sum(line[p + k] @ filters[k] for k in range(len(filters)))) [0] for p in range(n))
        assert abs(best + network.bias[i * toxicity.FILTERS] - whole[0, i * toxicity.FILTERS]) < 1e-5


def test_attention_weights_sum_to_one():
    model = passage_quality.AttentionModel(1)
    texts = pa.array(["word " * 200, None, "a b c"], pa.string())
    part = passage_quality.cut_passages(texts, split_words(texts))
    assert part.starts.tolist() == [0, 4, 5, 6]
    hidden, size = model.encode(part.slots[part.words], part.passage, part.style)
    weight, *_ = model.attend(hidden, part.starts)
    assert np.allclose(np.add.reduceat(weight, part.starts[:-1]), 1) and size.tolist() == [64, 64, 64, 8, 1, 3]


def test_toxicity_learns_from_every_labelled_row(spark):
    rows = [(i, f"own{i} {'awful' if i % 40 == 0 else 'plain'} words", int(i % 40 == 0)) for i in range(3400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic long").repartition(3)
    (network, shift), share = toxicity.fit_toxicity(table.select("doc_id", "text"), table)
    marked = table.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 4
    taught = [r["doc_id"] for r in marked.where(~F.col("held_out") & ~apart).collect()]
    kept = marked.where(~F.col("held_out")).collect()
    assert share == pytest.approx(np.mean([r["toxic"] for r in kept]))
    # A word that was never met starts at 0 in the first dimension; each row has a word of its own.
    slots = word_hashes([f"own{i}" for i in taught]) & np.uint64(toxicity.BUCKETS - 1)
    assert len(taught) > 1500 and (network.tables[0][slots.astype(np.int64), 0] != 0).all()
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table, (network, shift), share).collect()}
    assert np.mean([scored[i] == toxic for i, _, toxic in rows]) > 0.99
