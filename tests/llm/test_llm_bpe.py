"""The encoder against the public tokenizers library, and its edge cases."""

import hashlib
import pickle
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tillscope.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def odd_texts():
    draw = random.Random(7)
    signs = "abcdefgh  \n\t<|>'!?ΣσςİıÉé́̀  ​\x1c\x85\x0012٣½日本語한e🙂ﬃNK"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(draw.choice("abeinrstoth") for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    return [
        *texts, "", None, "a" * 5000, "it's ΑΣ ΣΑ'S we'll", "<|startoftext|>x<|endoftext|> y<|startoftext|", "\n \t",
    ]


def test_equals_the_library(vocabulary, library):
    texts = odd_texts()
    encoder = bpe.Encoder(vocabulary)
    for part in (texts, texts[::-1]):  # the second time from what is remembered
        ids, starts = encoder.encode(pa.array(part, pa.string()))
        decoded = encoder.decode(ids, starts)
        for i, text in enumerate(part):
            own = ids[starts[i] : starts[i + 1]].tolist()
            assert (own, decoded[i].decode()) == expected(library, text), repr(text)


def test_forgets_when_full(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(vocabulary)
    for text in ["one two three four five six seven eight nine ten eleven twelve", "twelve one thirteen", "one two"]:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == expected(library, text)[0]


def test_whole_table(spark, folder, vocabulary, library):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r for r in bpe.encoding_digests(documents, vocabulary).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids, decoded = expected(library, row["text"])
        got = found[row["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_nulls_repeats_and_extra_columns(spark, vocabulary):
    rows = [(1, None, "x"), (1, "Hello there", "y"), (1, "Hello there", "y"), (None, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in bpe.encode_texts(table, vocabulary).collect())
    assert [f[0] for f in found] == [0, 1, 1, 1]
    assert found[0][1:] == ([], "") and found[1][1:] == ([], "")
    assert found[2] == found[3] and found[2][2] == "hello</w> there</w>"
    assert bpe.encode_texts(table.limit(0), vocabulary).collect() == []
    both = bpe.encode_with_digests(table, vocabulary).collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in both)


def random_words(n, seed=5):
    draw = random.Random(seed)
    return ["".join(draw.choices("abdeilnorst", k=8)) + draw.choice(["", ",", "."]) for _ in range(n)]


def test_keeps_what_it_meets_again(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    encoder = bpe.Encoder(vocabulary)
    learned = []
    learn = encoder._learn
    encoder._learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    words = random_words(2000)
    for start in range(0, 2000, 40):
        text = " ".join(["Usual", "words,", *words[start : start + 40]])
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == expected(library, text)[0]
        assert len(encoder.rows) < 250
    assert learned.count("Usual") == learned.count("words,") == 1


def test_memory_of_an_encoder(vocabulary):
    """The worker of each core holds a vocabulary and what was remembered."""
    parts = [pa.array([" ".join(random_words(15000, seed))]) for seed in range(10)]
    stored = pickle.dumps(vocabulary)
    held = []
    tracemalloc.start()
    encoder = bpe.Encoder(pickle.loads(stored))
    for part in parts:
        encoder.encode(part)
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(held) < 60 << 20
