"""Language models against every segmentation, held-out accuracy, and edge cases."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tillscope.llm import language_id

PIECES = sorted(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"])


def every_way(word, table):
    """Sum over all ways to cut a word, tried one by one."""
    if not word:
        return np.ones(table.shape[1])
    total = table[-1] * every_way(word[1:], table)
    for i, piece in enumerate(PIECES):
        if word.startswith(piece):
            total = total + table[i] * every_way(word[len(piece) :], table)
    return total


def test_forward_sums_all_segmentations():
    table = np.random.default_rng(1).random((len(PIECES) + 1, 3))
    words = ["a", "ab", "abab", "babba", "xyz", "aXb", ""]
    got = language_id.Segmenter(PIECES).likelihood(words, table)
    assert np.allclose(np.exp(got), [every_way("▁" + w, table) for w in words])


def in_logarithms(word, table):
    """Log of the sum over all ways to cut a word, letter by letter with logaddexp."""
    logs = np.full((len(word) + 1, table.shape[1]), -np.inf)
    logs[0] = 0
    for end in range(1, len(word) + 1):
        logs[end] = logs[end - 1] + np.log(table[-1])
        for i, piece in enumerate(PIECES):
            if word.startswith(piece, end - len(piece)) and len(piece) <= end:
                logs[end] = np.logaddexp(logs[end], logs[end - len(piece)] + np.log(table[i]))
    return logs[-1]


@pytest.mark.parametrize("stretch", [16, 48, 4096])
def test_long_words_are_summed_whole(stretch, monkeypatch):
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    table = rng.random((len(PIECES) + 1, 3)) / 10
    table[-1] = language_id.UNKNOWN
    words = ["".join(rng.choice(list("abx"), n)) for n in (5, 6, 7, 8, 39, 40, 41, 60, 200, 201, 900)] + ["a", "x" * 300]
    got = language_id.Segmenter(PIECES).likelihood(words, table)
    assert np.allclose(got, [in_logarithms("▁" + w, table) for w in words], rtol=1e-12)


def test_unknown_letters_without_end_stay_finite():
    table = np.full((len(PIECES) + 1, 2), [0.1, 0.2])
    table[-1] = language_id.UNKNOWN
    got = language_id.Segmenter(PIECES).likelihood(["x" * 100_000], table)
    assert np.allclose(got, 100_000 * np.log(language_id.UNKNOWN) + np.log([0.1, 0.2]))


def test_expected_uses_of_long_words():
    table = np.random.default_rng(4).random((len(PIECES) + 1, 2)) / 10
    word = "abxaab" * 30
    uses = language_id.Segmenter(PIECES).expected([word], np.ones((1, 2)), table)
    letters = np.array([[len(p)] for p in PIECES] + [[1]])
    assert np.allclose((uses * letters).sum(axis=0), len(word) + 1)
    up = table.copy()
    up[PIECES.index("ab")] *= 1 + 1e-6
    slope = (in_logarithms("▁" + word, up) - in_logarithms("▁" + word, table)) / 1e-6
    assert np.allclose(slope, uses[PIECES.index("ab")], atol=1e-2)


def test_expected_uses_follow_the_likelihood():
    # The derivative of the log-likelihood by a log-probability is the expected number of uses.
    table = np.random.default_rng(2).random((len(PIECES) + 1, 2))
    words, counts = ["abab", "ba", "aab"], np.array([[2.0, 1.0], [1.0, 3.0], [0.0, 1.0]])
    segmenter = language_id.Segmenter(PIECES)
    uses = segmenter.expected(words, counts, table)
    for i in range(len(table)):
        up = table.copy()
        up[i] *= 1 + 1e-6
        slope = ((segmenter.likelihood(words, up) - segmenter.likelihood(words, table)) * counts).sum(axis=0) / 1e-6
        assert np.allclose(slope, uses[i], atol=1e-3)


def test_accuracy_on_rows_kept_apart(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_language(documents)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == documents.count()
    rows = found.where("held_out").join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the and of", None), (None, "le la les", "fr"),
        (5, "x" * 100_000, None), (5, "x" * 100_000, None), (6, "日本 語", "ja"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_edge_cases(spark, odd):
    texts = {"en": "the of and that with from this", "fr": "le la les des une avec dans pour"}
    rows = [(100 + i, texts["en" if i % 2 else "fr"], "en" if i % 2 else "fr") for i in range(60)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = learned.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    found = language_id.identify_language(table).collect()
    assert len(found) == 68
    by_id = {r["doc_id"]: r for r in found}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by_id[1]["score"] == 0
    assert by_id[4]["lang_pred"] == "en" and by_id[None]["lang_pred"] == "fr"
    assert by_id[5]["lang_pred"] in {"en", "fr", "ja"} and not by_id[None]["held_out"]
    assert language_id.identify_language(table.limit(0)).collect() == []


def test_nothing_to_learn_from(odd):
    found = language_id.identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def test_language_columns_are_no_input(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = documents.withColumn("lang", F.when(apart, F.lit("xx")).otherwise(F.col("lang")))
    one, two = (sorted(map(tuple, language_id.identify_language(d).collect())) for d in (documents, changed))
    assert one == two


def test_pieces_are_a_fixed_public_vocabulary():
    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(pieces) == len(set(pieces)) > 10_000 and all(p == p.lower() for p in pieces)
